import numpy as np
import pytest

from quillgrove.llm import ann


def test_chi2_quantile():
    assert ann.chi2_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert ann.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def recall(got, ids, x, k, asked=None):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(x)) if asked is None or ids[i] in asked for j in np.argsort(d[i], kind="stable")[:k]}
    return len(want & got) / len(want)


@pytest.mark.parametrize("cell", [4096, 64])
def test_recall_over_all_queries(spark, cell):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((300, 32)), rng.standard_normal((200, 32)) * 0.2 + 2]).astype(np.float32)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<float>")
    for odd_sizes in ({}, {"block": 30, "queries": 20}):
        rows = ann.neighbours(d, 10, cell=cell, **odd_sizes).collect()
        assert len(rows) == 5000
        assert recall({(r["query_id"], r["neighbour_id"]) for r in rows}, np.arange(500), x.astype(float), 10) >= 0.9


def test_query_recall(spark, data):
    from quillgrove.llm import common

    e = common.read(spark, data, "embeddings").toPandas()
    x, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
    got = {(r["query_id"], r["neighbour_id"]) for r in ann.op7_neighbours(spark, data).collect()}
    asked = ids[ids % 20 == 0]
    assert {q for q, _ in got} == set(asked.tolist()) and len(got) == 10 * len(asked)
    assert recall(got, ids, x, 10, asked) >= 0.9


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 1.0], 9), (1, [0.0, 1.0], 9), (2, [0.0, 1.0], None), (3, [1.0, 1.0], 1), (4, None, 1), (5, [], 1), (6, [1.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (None, [0.0, 1.0], 1), (9, [0.0, 3.0], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long")
    out = ann.neighbours(d, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["neighbour_id"], r["distance"]) for r in out if r["query_id"] in (1, 9)] == [(1, 2, 0.0), (1, 3, 1.0), (9, 1, 2.0), (9, 2, 2.0)]
    assert len(out) == 8
    assert ann.neighbours(d.where("false")).count() == 0
    assert ann.neighbours(d.where("vec_id = 3")).count() == 0


def test_ties_go_to_the_lesser_id_in_a_group_of_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    copies = rng.permutation(400)[:150]
    x[copies] = x[copies[0]]
    d = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(400)], "vec_id long, embedding array<float>").repartition(4)
    want = {}
    for i in copies.tolist():
        want[i] = [int(j) for j in sorted(copies) if j != i][:10]
    for cell in (4096, 64):
        got = {}
        for r in ann.neighbours(d, 10, cell=cell, sample=300, block=90).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["neighbour_id"])
        assert {i: got[i] for i in want} == want

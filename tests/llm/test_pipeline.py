"""Each stage against brute force over what the stage before it left."""

import corpus_pipeline
from test_linededup import brute as lines_by_hand
from test_simhash import brute as groups_by_hand

from quillgrove.llm import common, simhash, toxicity

D = "/root/testdata/sf0.01"


def test_stages_by_brute_force(spark):
    docs = common.read(spark, D, "documents")
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    model = toxicity.fit(docs, common.read(spark, D, "labels"))
    scores = model.lookup()
    clean = [(r["doc_id"], r["text"]) for r in docs.collect() if toxicity.judge(r["text"], r["lang"], model, scores)[0] > 3e-3]
    a = common.written(names["toxicity"](spark, docs, D), "a")
    assert sorted((r["doc_id"], r["text"]) for r in a.collect()) == sorted(clean)
    b = common.written(names["line_dedup"](spark, a, D), "b")
    got = {r["doc_id"]: r["text"] for r in b.collect()}
    assert got == {k: t for k, (t, _) in lines_by_hand(clean).items()}
    c = common.written(names["simhash"](spark, b, D), "c")
    left = {r["doc_id"] for r in c.collect()}
    ids = sorted(got)
    was = {r["doc_id"]: r["text"] for r in docs.collect()}
    # near as they are, or as they were
    links = {}
    for texts in (got, was):
        sig, some = simhash.signatures([texts[i] for i in ids])
        for i, g in groups_by_hand([i for i, s in zip(ids, some) if s], sig[some]).items():
            links.setdefault(i, set()).add(g)
            links.setdefault(g, set()).add(i)
    gone = set()
    seen = set()
    for i in sorted(links):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for x in links[todo.pop()] - group:
                    group.add(x)
                    todo.append(x)
            seen |= group
            gone |= group - {min(group)}
    assert set(got) - left <= gone and len(set(got) - left) >= 0.97 * len(gone)
    # of documents that were near copies in the table, one of each group is left
    sig, some = simhash.signatures([was[i] for i in ids])
    near = groups_by_hand([i for i, s in zip(ids, some) if s], sig[some])
    copies = {i for i, g in near.items() if i != g}
    assert copies and len(copies & left) <= 0.03 * len(copies)
    d = common.written(names["mixing"](spark, c, D), "d")
    assert b.columns == c.columns == d.columns == docs.columns
    n = lambda t: len(t.split())
    mixed = [r["text"] for r in d.collect()]
    total = sum(n(r["text"]) for r in c.collect())
    assert 0.45 * total < sum(map(n, mixed)) <= 0.5 * total
    e = names["packing"](spark, d, D).toPandas()
    assert e.n_tokens.sum() == sum(map(n, mixed))
    assert e.groupby("bin_id").n_tokens.sum().max() <= 2048


def test_odd_rows(spark, odd, none, tmp_path):
    """Every stage over nulls, empty and long texts, repeats and clashing columns, and over an empty table."""
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", odd), ("none", none)):
        at = f"{tmp_path}/{name}"
        rows.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        docs = common.read(spark, at, "documents")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = common.written(stage(spark, docs, at), step)
            assert out.columns == odd.columns
            if name == "odd" and step in ("toxicity", "line_dedup", "simhash"):
                assert {2, 3, 4} <= {r["doc_id"] for r in out.collect()}
            docs = out
        places = corpus_pipeline.STAGES[-1][1](spark, docs, at).count()
        assert places == corpus_pipeline.run(spark, at).count() and (places > 0) == (name == "odd")


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0

import hashlib

from compare import same

from quillgrove.llm import mixing


def test_oracle(spark, duck, data):
    same(mixing.op9_mixing(spark, data), duck, mixing.ORACLE)


def test_weights_by_brute_force(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)]
    weights = {"a": 3.0, "b": 1.0, "c": 0.0}
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums, timed = {}, []
    for i, t, s in sorted(rows, key=lambda r: (r[2], hashlib.md5(f"mix-{r[0]}".encode()).hexdigest(), r[0])):
        if weights[s]:
            sums[s] = sums.get(s, 0) + len(t.split())
            timed.append((sums[s] / weights[s], s, hashlib.md5(f"mix-{i}".encode()).hexdigest(), i, len(t.split())))
    want, total = [], 0
    for f, s, h, i, n in sorted(timed):
        total += n
        if total > 400:
            break
        want.append(i)
    got = [r["doc_id"] for r in mixing.mix(d, weights, budget=400).collect()]
    assert got == want
    tokens = {s: sum(len(t.split()) for i, t, x in rows if x == s and i in set(got)) for s in "ab"}
    assert abs(tokens["a"] / tokens["b"] - 3) < 0.2


def test_many_buckets_and_spans(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 9 == 0]) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = [r["doc_id"] for r in mixing.mix(d).collect()]
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    assert [r["doc_id"] for r in mixing.mix(d).collect()] == few


def test_odd_rows(odd, none):
    out = mixing.mix(odd, budget_share=1.0)
    assert out.columns == odd.columns and out.count() == odd.count()
    # only documents without tokens cost nothing, and only before their source's first token
    assert all(not (r["text"] or "").split() for r in mixing.mix(odd, budget=0).collect())
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, {"a": 0.0, "b": 0.0, "c": 0.0, "": 0.0}).count() == 0

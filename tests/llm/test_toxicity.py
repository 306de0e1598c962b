import math
import random
import re

import numpy as np

from quillgrove.llm import common, toxicity


def brute(scores):
    """Maximal segments by their definition: recursively the best segment, then what is left and right of it."""
    if not len(scores):
        return []
    total = np.concatenate(([0], np.cumsum(scores)))
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(scores[j:])]


def test_segments_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        s = np.array([rng.choice([-3.1, -1.7, -0.6, 0.0, 0.9, 2.3, 4.7]) * rng.uniform(0.9, 1.1) for _ in range(rng.randint(1, 25))])
        ours = sorted((a, b) for a, b, _ in toxicity.segments(s))
        score = lambda spans: sorted(round(float(s[a:b].sum()), 9) for a, b in spans)
        assert score(ours) == score(brute(s))


def best_first(scores):
    """(start, end, score) of the maximal segments, from the segments of positive scores by the quadratic definition."""
    out = []
    todo = [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        total = np.concatenate(([0], np.cumsum(scores[a:b])))
        # the greatest end minus the least beginning before it
        low = np.minimum.accumulate(total)
        j = int(np.argmax(total - low))
        if total[j] - low[j] <= 0:
            continue
        i = max(k for k in range(j) if total[k] == low[j])
        out.append((a + i, a + j, float(total[j] - low[j])))
        todo += [(a, a + i), (a + j, b)]
    return sorted(out, key=lambda x: (-x[2], x[0]))


def test_query_by_brute_force(spark, data):
    """Segments by their definition and p-values from factorials, over the whole table."""
    docs, labels = (common.read(spark, data, t) for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    want = []
    for r in docs.collect():
        words = [(x.start(), x.end(), common.lowered(x.group())) for x in re.finditer(r"[^\W_]+", r["text"])]
        if not words:
            continue

        def score(w):
            for t in [w] + [w[:k] + "*" for k in (7, 6, 5, 4) if len(w) > k]:
                if t in m.known:
                    return m.known[t] if m.known[t] > 0 else -m.drift
            return -m.drift

        found = best_first(np.array([score(w) for _, _, w in words]))
        lam, k = m.calibration.get(r["lang"], m.calibration[""])
        normal, p, total = [lam * s - math.log(k * len(words)) for _, _, s in found], 1.0, 0.0
        for n, x in enumerate(normal, 1):
            total += x
            if total <= 0:
                break
            tail = 1 - math.exp(-math.exp(-total)) if n == 1 else math.exp(-total) * total ** (n - 1) / math.factorial(n) / math.factorial(n - 1)
            p = min(p, 2**n * tail)
        if p <= 3e-3:
            want += [(r["doc_id"], words[a][0], words[b - 1][1], round(s, 6)) for i, (a, b, s) in enumerate(found) if i == 0 or k * len(words) * math.exp(-lam * s) <= 0.5]
    got = [(r["doc_id"], r["start_char"], r["end_char"], round(r["score"], 6)) for r in toxicity.op1_toxicity(spark, data).collect()]
    assert sorted(got) == sorted(want) and got


def test_positions_are_those_of_the_text(spark):
    m = toxicity.Model(known={"gamma": 9.0}, calibration={"": (1.0, 0.01)})
    text = "İİİİ alpha Gamma İ"
    r = toxicity.toxic_passages(spark.createDataFrame([(1, text, "xx")], "doc_id long, text string, lang string"), m).first()
    assert text[r["start_char"] : r["end_char"]] == "Gamma"


def test_the_fit_is_bounded_in_rows_and_bytes(spark, data):
    docs, labels = (common.read(spark, data, t) for t in ("documents", "labels"))
    assert toxicity.fit(docs, labels).known
    assert not toxicity.fit(docs, labels, fit_bytes_per_class=0).known
    assert not toxicity.fit(docs, labels, fit_rows_per_class=0).known


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = common.read(spark, d, "documents").join(common.read(spark, d, "labels"), "doc_id").select("doc_id", "text", "lang", "toxic").toPandas().sort_values("doc_id")
    m = toxicity.fit_rows(rows[rows.doc_id % 2 == 0])
    test, scores = rows[rows.doc_id % 2 == 1], m.lookup()
    found = np.array([toxicity.judge(t, g, m, scores)[0] <= 3e-3 for t, g in zip(test.text, test.lang)])
    toxic = test.toxic.to_numpy() == 1
    assert found[toxic].mean() > 0.8 and found[~toxic].mean() < 0.005


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    for m in (toxicity.fit(odd, labels), toxicity.fit(none, labels), toxicity.Model()):
        assert toxicity.toxic_passages(odd, m).count() >= 0
        left = toxicity.drop_toxic(odd, m)
        assert left.columns == odd.columns
        assert toxicity.toxic_passages(none, m).count() == toxicity.drop_toxic(none, m).count() == 0
    m = toxicity.Model(known={"gamma": 9.0}, calibration={"": (1.0, 0.01)})
    left = [r["doc_id"] for r in toxicity.drop_toxic(odd, m).collect()]
    assert sorted(x for x in left if x is not None) == [2, 3, 4, 5, 6, 7, 8] and None in left
    assert sorted(r["doc_id"] for r in toxicity.toxic_passages(odd, m).collect()) == [1, 1]

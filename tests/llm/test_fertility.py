import math
from collections import Counter

import numpy as np
import pytest

from quillgrove.llm import common, fertility


def test_entropy_by_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 255, 256, 300, 512, 1000):
        ids = rng.integers(0, 30, n)
        k = max(1, n // 256)
        windows = [ids[i * 256 : (i + 1) * 256 if i < k - 1 else n] for i in range(k)]
        want = [-sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w.tolist()).values()) / math.log2(len(w)) if len(w) > 1 else 1.0 for w in windows]
        assert fertility.entropy(ids) == pytest.approx(sum(want) / k)


def test_measures():
    n, rate, share, h = fertility.measure("plain words in a row")
    assert n == 5 and rate == 4.0 and share == 0.0 and h == 1.0
    assert fertility.measure("ᾞᾞ\U0001f9ff")[2] > 0.5
    assert fertility.measure("a" * 100_000)[3] < 0.05
    assert fertility.measure("\ud800 lone")[0] > 0


def test_query_by_brute_force(spark, data):
    """Bands from sorted measures, over the whole table."""
    docs = common.read(spark, data, "documents").collect()
    rows = [(r["doc_id"], r["lang"], *fertility.measure(r["text"])) for r in docs if r["text"]]
    cls = lambda n: 0 if n < 8 else 1 if n < 16 else 2 if n < 32 else 3 if n < 64 else 4
    sets, want = {}, set()
    for _, lang, n, *m in rows:
        for key in ((lang, cls(n)), (None, cls(n))):
            sets.setdefault(key, []).append(m)
    for i, lang, n, *m in rows:
        own = sets[lang, cls(n)]
        own = own if len(own) >= 30 else sets[None, cls(n)]
        ok = True
        for j, floor in enumerate((0.5, 0.02, 0.06)):
            v = sorted(x[j] for x in own)
            a, b = v[math.ceil(0.25 * len(v)) - 1], v[math.ceil(0.75 * len(v)) - 1]
            wide = max(floor * (64 / (4, 8, 16, 32, 64)[cls(n)]) ** 0.5, 4 * (b - a))
            room = 3 * ((max(b + wide, 0) + 0.01) / n) ** 0.5 if j == 1 else 0
            ok &= a - wide - room <= m[j] <= b + wide + room
        if ok:
            want.add(i)
    assert {r["doc_id"] for r in fertility.op6_fertility(spark, data).collect()} == want and len(want) < len(rows)


def test_short_junk_goes(spark):
    rows = [(i, f"these are the plain words of text number {i} and no more", "en") for i in range(60)]
    rows += [(100, "ᾞ\U0001f9ffᾞ\U0001f9ffᾞ", "en")]
    assert {fertility.measure(t)[0] // 8 for _, t, _ in rows} == {1}
    out = {r["doc_id"] for r in fertility.kept(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(range(60)) <= out and 100 not in out


def test_clean_stays_and_junk_goes(spark):
    d = "/root/testdata/sf0.1"
    keep = {r["doc_id"] for r in fertility.op6_fertility(spark, d).select("doc_id").collect()}
    labels = common.read(spark, d, "labels").collect()
    share = lambda q: np.mean([r["doc_id"] in keep for r in labels if r["quality"] == q])
    assert share(1) > 0.995 and share(0) < 0.4


def test_odd_rows(odd, none):
    ids = [r["doc_id"] for r in fertility.kept(odd).collect()]
    assert sorted(ids) == [1, 1, 4, 5, 6, 7, 8]
    assert fertility.kept(none).count() == 0

import tracemalloc

import numpy as np
import pandas as pd

from quillgrove.llm import common, simhash


def brute(ids, sig, words=24, pairs=32, total=52):
    """group_id by id, from all pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        one = np.bitwise_count(sig[i, :2] ^ sig[i + 1 :, :2]).sum(1)
        two = np.bitwise_count(sig[i, 2:] ^ sig[i + 1 :, 2:]).sum(1)
        for j in np.flatnonzero((one <= words) & (two <= pairs) & (one.astype(int) + two <= total)):
            a, b = find(ids[i]), find(ids[i + 1 + int(j)])
            root[max(a, b)] = min(a, b)
    group = {i: find(i) for i in ids}
    return {i: g for i, g in group.items() if sum(x == g for x in group.values()) > 1}


def test_groups_by_brute_force(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()
    sig, some = simhash.signatures([r["text"] for r in docs])
    want = brute([r["doc_id"] for r in docs if r["text"]], sig[some])
    got = {r["doc_id"]: r["group_id"] for r in simhash.op8_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert set(got.items()) <= set(want.items())
    assert len(got) >= 0.98 * len(want)


def test_long_texts_are_signed_within_bounded_memory():
    texts = [" ".join(f"w{j}" for j in np.random.default_rng(i).integers(0, 9973, 30_000).tolist()) for i in range(60)] + ["", "a few words", "--"]
    ids = np.arange(len(texts))
    tracemalloc.start()
    got = pd.concat(simhash.sign(iter([pd.DataFrame({"_id": ids, "_text": texts})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sig, some = simhash.signatures(texts)
    assert (got.doc_id.to_numpy() == ids[some]).all()
    assert (got[["s0", "s1", "s2", "s3"]].to_numpy().view(np.uint64) == sig[some]).all()
    # all at once hold some 80 MB
    assert peak < 40e6


def test_majority_of_long_runs():
    h = simhash._mix(np.arange(200_000, dtype=np.uint64))
    got = simhash._majority([h, h[:5], h[:0]])
    for k, part in enumerate((h, h[:5])):
        bits = ((part[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) * 2 > len(part)
        assert got[k, 0] == sum(1 << i for i in range(64) if bits[i])
    assert not got[2].any()


def test_oversized_buckets_are_split_and_nothing_is_skipped():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4).astype(np.uint64)
    sig = np.repeat(base[None], 500, axis=0)
    for i in range(1, 500):
        sig[i, 0] ^= np.uint64(1) << np.uint64(i % 40)
        sig[i, 2] ^= np.uint64(1) << np.uint64(i % 61)
    sig = np.unique(sig, axis=0)
    ids = np.arange(len(sig))
    rows, bucket = simhash._split(sig, np.zeros(len(sig), dtype=np.int64), 50)
    assert np.bincount(bucket).max() <= 62
    assert (np.bincount(rows, minlength=len(sig)) == simhash.ways(4)).all()
    a, b = simhash.forest(ids, sig, np.zeros(len(sig), dtype=np.int64), 24, 32, 52)
    assert len(a) == len(sig) - 1


def flipped(sig, rng, n):
    """Copies of signatures with n of their word bits flipped."""
    out = sig.copy()
    for i in range(len(out)):
        for bit in rng.choice(128, n, replace=False).tolist():
            out[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


def test_pairs_meet_as_often_as_planned_in_split_buckets_too():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    sig = np.concatenate([base, flipped(base, rng, simhash.DESIGN)])
    k, tables = simhash.plan(len(sig))

    def met(deep, cap):
        pairs = set()
        for rows, b, _ in simhash.buckets(sig, k, tables, deep):
            if len(rows):
                own, bucket = simhash._split(sig[rows], b, cap)
                at = {}
                for r, x in zip(rows[own].tolist(), bucket.tolist()):
                    at.setdefault(x, set()).add(r % 400 if r < 400 else r)
                pairs |= {r for rs in at.values() for r in rs if r < 400 and r + 400 in rs}
        return len(pairs) / 400

    # the tables draw from the same coordinates, so they are not quite independent
    assert met({}, 1000) > 0.9
    # all in one bucket of few coordinates, split before and in the task
    k, tables = 0, 1
    assert met({}, 50) > 0.9
    deep = {int(b): 3 for _, bs, _ in simhash.buckets(sig, k, tables, {}) for b in np.unique(bs)}
    assert met(deep, 10_000) > 0.9


def test_large_buckets_are_split_before_they_are_gathered(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    want = set(map(tuple, simhash.groups(docs).collect()))
    signed = simhash.signed(docs).dropDuplicates(["s0", "s1", "s2", "s3"])
    deep = simhash._deep(signed, 4, 3, 40)
    assert deep and max(deep.values()) <= 44
    few = set(map(tuple, simhash.groups(docs, limit=100, cap=40).collect()))
    assert few <= want and len(few) >= 0.97 * len(want)


def test_texts_as_they_were_count_too(spark):
    words = [f"word{i}" for i in range(200)]
    was = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "one", "two", "three"])), (3, "other text by itself"), (9, " ".join(words))], "doc_id long, text string")
    now = spark.createDataFrame([(1, " ".join(words)), (2, "one two three"), (3, "other text by itself")], "doc_id long, text string")
    assert simhash.groups(now).count() == 0
    assert sorted(map(tuple, simhash.groups(now, before=was).collect())) == [(1, 1), (2, 1)]
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(now, was).collect()) == [1, 3]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["doc_id"]: r["group_id"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert common.components(edges.where("false")).count() == 0


def test_odd_rows(odd, none):
    assert sorted(map(tuple, simhash.groups(odd).collect())) == [(5, 5), (6, 5)]
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 1, 2, 3, 4, 5, 7, 8] and None in ids
    assert simhash.drop_near_copies(none).count() == 0

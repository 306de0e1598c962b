import numpy as np
from compare import same

from quillgrove.llm import linededup


def test_cuckoo():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    f = linededup.Cuckoo.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 1e-3
    f.delete(keys[:25_000])
    assert f.contains(keys[25_000:]).all() and f.contains(keys[:25_000]).mean() < 1e-3
    f.delete(keys[25_000:])
    assert not f.slots.any()
    assert not linededup.Cuckoo(np.zeros((4, 4), dtype=np.uint16)).insert(keys[:40])


def brute(rows, seen=()):
    """Documents (id, text) in order of id, without lines seen before."""
    seen, out = set(seen), {}
    for i, t in sorted(rows):
        kept, gone = [], 0
        for x in t.split("\n"):
            if x.strip(" ") and x.strip(" ") in seen:
                gone += 1
            else:
                kept.append(x)
                seen.add(x.strip(" "))
        if not gone or any(x.strip(" ") for x in kept):
            out[i] = ("\n".join(kept), gone)
    return out


A = [(1, "one\ntwo\n\nthree"), (2, "two\nfour\ntwo"), (3, "one\n two "), (4, "five")]
B = [(10, "five\nsix"), (11, "six\nseven\none"), (12, "eight")]


def rows(df):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in df.collect()}


def state(index):
    return sorted(map(tuple, index.refs.collect())), {r["shard"]: (r["n"], sorted(x for x in np.frombuffer(r["slots"], dtype=np.uint16).tolist() if x)) for r in index.filters.collect()}


def test_insert_and_delete_are_reversible(spark):
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (A, B))
    kept, index = linededup.insert(a)
    assert rows(kept) == brute(A)
    more, both = linededup.insert(b, index)
    seen = {x.strip(" ") for _, t in A for x in t.split("\n")} - {""}
    assert rows(more) == brute(B, seen)
    back, again = linededup.delete(b, both)
    assert state(again) == state(index) and back.count() == 0
    # those that aren't in, any more or ever, change nothing
    other = spark.createDataFrame([(1, "one\ntwo"), (99, "one")], "doc_id long, text string")
    for d in (b, other):
        assert state(linededup.delete(d, again)[1]) == state(index)
    # with a gone too, nothing is known
    back, empty = linededup.delete(a, again)
    assert empty.refs.count() == 0 and back.count() == 0
    assert rows(linededup.insert(b, empty)[0]) == brute(B)


def test_lines_of_deleted_documents_go_back(spark):
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (A, B))
    _, index = linededup.insert(a)
    _, index = linededup.insert(b, index)
    for gone in ([1], [2, 4, 10], [1, 2, 3]):
        out = spark.createDataFrame([x for x in A + B if x[0] in gone], "doc_id long, text string")
        back, after = linededup.delete(out, index)
        # by hand: each line that is left belongs to the first document by batch and id
        owner = lambda docs: {x.strip(" "): (i, n) for i, t in sorted(docs, reverse=True) for n, x in reversed(list(enumerate(t.split("\n")))) if x.strip(" ")}
        before, now = owner(A + B), owner([x for x in A + B if x[0] not in gone])
        assert {(r["doc_id"], r["pos"]) for r in back.collect()} == {p for x, p in now.items() if before[x] != p}
        # and later documents are judged as if the deleted had never come
        c = spark.createDataFrame([(20, "one\ntwo\nfive\nsix\nnine")], "doc_id long, text string")
        assert rows(linededup.insert(c, after)[0]) == brute([(20, "one\ntwo\nfive\nsix\nnine")], now)


def test_keys_are_independent(spark):
    """The second hash isn't what xxhash64 makes of the first."""
    lines = spark.createDataFrame([("one",), ("two",), ("a longer line of words",)], "line string")
    one, two = linededup._keys(linededup.F.col("line"))
    r = lines.select(one, two, linededup.F.xxhash64("line", linededup.F.lit(1)).alias("folded")).collect()
    assert all(x["k1"] not in (x["k0"], x["folded"]) for x in r)
    assert [chained(x["k0"]) for x in r] == [x["folded"] for x in r]
    assert all(chained(x["k0"]) != x["k1"] for x in r)


def chained(seed):
    """xxHash64 of the integer 1 from a seed, by its public definition."""
    full, p = 2**64 - 1, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
    h = ((seed + p[3] + 4) & full) ^ p[0]
    h = ((h << 23 | h >> 41) * p[1] + p[2]) & full
    h = (h ^ h >> 33) * p[1] & full
    h = (h ^ h >> 29) * p[2] & full
    h ^= h >> 32
    return h - 2**64 if h >> 63 else h


def test_runs_and_shards_are_merged(spark, monkeypatch):
    monkeypatch.setattr(linededup, "RUNS", 2)
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 3)
    docs = [(i, f"line {i}\nline {i % 4}\nshared") for i in range(12)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got, index = linededup.insert(frame(docs[:2]))
    out = rows(got)
    for at in (2, 5):
        more, index = linededup.insert(frame(docs[at : at + 3] if at == 2 else docs[5:]), index)
        out |= rows(more)
    assert out == brute(docs) and len(index.runs) <= 2 and index.shards > 2
    _, index = linededup.delete(frame(docs[1:]), index)
    assert state(index)[0] == state(linededup.insert(frame(docs[:1]))[1])[0]


def test_delete_odd_rows(spark, odd, none):
    _, index = linededup.insert(odd)
    back, same_ = linededup.delete(none, index)
    assert back.count() == 0 and state(same_) == state(index)
    _, empty = linededup.delete(odd.unionByName(odd), index)
    assert empty.refs.count() == 0
    assert linededup.insert(odd, empty)[0].count() == linededup.insert(odd)[0].count()


def test_a_full_filter_is_built_anew(spark):
    small = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    big = spark.createDataFrame([(2, "\n".join(f"line {i}" for i in range(2000)))], "doc_id long, text string")
    _, index = linededup.insert(small)
    _, index = linededup.insert(big, index)
    assert linededup.insert(big, index)[0].count() == 0
    assert linededup.insert(small, index)[0].count() == 0


def test_odd_rows(spark, odd, none):
    out, index = linededup.insert(odd)
    r = out.toPandas()
    assert [c for c in out.columns if c != "n_removed"] == [c for c in odd.columns if c != "n_removed"]
    ids = sorted(x for x in r.doc_id if x == x)
    # the null id comes first and owns its line; rows of one doc_id and text are one document; 6 is a copy of 5
    assert ids == [1, 1, 2, 3, 4, 5, 7, 8]
    assert set(r[r.doc_id == 1].text) == {"alpha beta gamma delta"} and set(r[r.doc_id == 1].n_chars) == {22}
    assert linededup.insert(none)[0].count() == 0
    assert linededup.insert(none, index)[0].count() == 0
    assert linededup.insert(odd, linededup.insert(none)[1])[0].count() == 9


def test_oracle(spark, duck, data):
    same(linededup.op4_line_dedup(spark, data), duck, linededup.ORACLE)

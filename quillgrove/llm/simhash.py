"""Near-duplicates by SimHash and random bit sampling.

1. Sign: every text gets 256 bits, 128 over its distinct words and 128 over its distinct word pairs
   (Charikar 2002). This is a map over the documents; only ids and signatures leave it.
2. Documents of equal signatures collapse into the one of the least doc_id, so thousands of exact
   copies cost one row afterwards.
3. Sample: each of several tables groups the distinct signatures by ``k`` coordinates drawn from the
   word bits. Both grow with the logarithm of the signatures: k keeps buckets small, and the number
   of tables keeps the chance that a pair at ``design`` bits meets at ``recall``. A bucket over
   ``cap`` is split by further coordinates, in so many different ways that a pair at ``design`` bits
   still meets in one with the same chance; none is skipped. Buckets too large for a task are counted
   and split so before they are gathered.
4. Verify: all pairs of a bucket are compared by both distances. Of the pairs found only a spanning
   forest leaves the task, so a group of n copies costs n rows and not n squared.
5. Connected components of these edges are the groups; each goes by its least doc_id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common

BITS = 128
#: A pair of signatures at DESIGN of the 128 word bits meets with the chance RECALL; nearer ones more surely.
DESIGN, RECALL = 22, 0.95
WORD = re.compile(r"\w+")
SIGNATURE = "s0 long, s1 long, s2 long, s3 long"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
#: A nibble's bits as four 16-bit lanes.
_LANES = np.array([sum(((x >> b) & 1) << (16 * b) for b in range(4)) for x in range(16)], dtype=np.uint64)
_BLOCK = 65535


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of each run of hashes have each of the 64 bits; no run is longer than _BLOCK."""
    out = np.empty((len(starts), 64), dtype=np.int64)
    for k in range(16):
        lanes = np.add.reduceat(_LANES[((h >> np.uint64(4 * k)) & np.uint64(15)).astype(np.intp)], starts)
        for b in range(4):
            out[:, 4 * k + b] = ((lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
    return out


class Words(dict):
    """Hash of a word, kept after its first use."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        b = word.encode("utf-8", "surrogatepass")
        self[word] = h = zlib.crc32(b) | zlib.adler32(b) << 32
        return h


def _majority(parts: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes, its 128 majority bits as two words; zeros for an empty one."""
    out = np.zeros((len(parts), 2), dtype=np.uint64)
    full = [i for i, p in enumerate(parts) if len(p)]
    if not full:
        return out
    h = np.concatenate([parts[i] for i in full])
    starts, runs = [], []
    at = 0
    for r, i in enumerate(full):
        for s in range(0, len(parts[i]), _BLOCK):
            starts.append(at + s)
            runs.append(r)
        at += len(parts[i])
    size = np.array([len(parts[i]) for i in full])
    first = np.searchsorted(np.array(runs), np.arange(len(full)))
    for word in range(2):
        counts = np.add.reduceat(_bit_counts(h if word == 0 else _mix(h + _NEXT), np.array(starts)), first, axis=0)
        bits = counts * 2 > size[:, None]
        out[full, word] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def signatures(texts: list[str], words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as four 64-bit words a text, and which texts have any word."""
    words = Words() if words is None else words
    ones, pairs = [], []
    for text in texts:
        found = WORD.findall(text.lower())
        h = _mix(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)))
        ones.append(np.unique(h))
        pairs.append(np.unique(_mix(h[:-1] * np.uint64(31) + h[1:])) if len(h) > 1 else _mix(h * np.uint64(31)))
    return np.hstack([_majority(ones), _majority(pairs)]), np.array([len(x) > 0 for x in ones], dtype=bool)


def parts(texts: list[str], most: int = 200, chars: int = 2_000_000) -> Iterator[slice]:
    """Runs of at most ``most`` texts and ``chars`` characters; a longer text is a run of its own."""
    at = held = 0
    for i, text in enumerate(texts):
        if i > at and (i - at == most or held + len(text) > chars):
            yield slice(at, i)
            at, held = i, 0
        held += len(text)
    if texts:
        yield slice(at, len(texts))


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id and signature of rows (_id, _text) with any word; the hashes of one of ``parts`` are held at a time."""
    words = Words()
    for batch in batches:
        ids, texts = batch["_id"].to_numpy(), batch["_text"].tolist()
        for part in parts(texts):
            sig, some = signatures(texts[part], words)
            s = sig[some].view(np.int64)
            yield pd.DataFrame({"doc_id": ids[part][some]} | {f"s{i}": s[:, i] for i in range(4)})


def signed(docs: DataFrame) -> DataFrame:
    """doc_id and signature of each document with an id and any word."""
    some = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    return some.mapInPandas(sign, f"doc_id long, {SIGNATURE}")


def plan(n: int, design: int = DESIGN, recall: float = RECALL, bucket: int = 64, least_k: int = 14) -> tuple[int, int]:
    """Sampled coordinates and tables for n distinct signatures."""
    k = max(least_k, math.ceil(math.log2(max(n, 2) / bucket)))
    return k, ways(k, design, recall)


def ways(k: int, design: int = DESIGN, recall: float = RECALL) -> int:
    """In how many independent draws of k coordinates a pair at ``design`` bits has the chance ``recall`` to agree once."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-((1 - design / BITS) ** k)))) if k else 1


def _coordinates(table: int) -> np.ndarray:
    """The table's order of the coordinates; its first k make the buckets."""
    return np.random.default_rng(7919 + table).permutation(BITS)


def _further(table: int, way: int, k: int) -> np.ndarray:
    """One order of the coordinates that the table hasn't used."""
    return np.random.default_rng([7919, table, way]).permutation(_coordinates(table)[k:])


def _key(sig: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Up to 63 coordinates of each signature, as a number."""
    key = np.zeros(len(sig), dtype=np.int64)
    for b in bits.tolist():
        key = key << 1 | ((sig[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64)
    return key


def _hashed(key: np.ndarray, salt: int) -> np.ndarray:
    return _mix(key.view(np.uint64) + np.uint64((salt + 1) * int(_NEXT) % 2**64))


def buckets(sig: np.ndarray, k: int, tables: int, deep: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, buckets, buckets of the table they come from) of signatures, for each table and each way to split the buckets in ``deep`` by so many further coordinates."""
    for t in range(tables):
        base = _hashed(_key(sig, _coordinates(t)[:k]), t).view(np.int64)
        more = np.array([deep.get(x, 0) for x in base.tolist()]) if deep else np.zeros(len(base), dtype=np.int64)
        rows = np.flatnonzero(more == 0)
        yield rows, base[rows], base[rows]
        for d in np.unique(more[more > 0]).tolist():
            rows = np.flatnonzero(more == d)
            for way in range(ways(d)):
                key = _key(sig[rows], _further(t, way, k)[:d])
                yield rows, (_hashed(key, way).view(np.int64) ^ base[rows] * 31), base[rows]


def _split(sig: np.ndarray, bucket: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, buckets) after every bucket over cap was split by further coordinates, in as many ways as make up for those; until it is small enough or the coordinates end."""
    bucket = np.unique(bucket, return_inverse=True)[1].reshape(-1)
    size = np.bincount(bucket)
    rows = [np.flatnonzero(size[bucket] <= cap)]
    out = [bucket[rows[0]]]
    at = len(size)
    for b in np.flatnonzero(size > cap).tolist():
        own = np.flatnonzero(bucket == b)
        # coordinates that all share split nothing
        differ = np.bitwise_or.reduce(sig[own] ^ sig[own[0]], axis=0)
        free = np.array([x for x in range(BITS) if differ[x // 64] >> np.uint64(x % 64) & np.uint64(1)], dtype=np.int64)
        for way in range(ways(math.ceil(math.log2(len(own) / cap)))):
            order = np.random.default_rng([way, len(own)]).permutation(free)
            part = np.zeros(len(own), dtype=np.int64)
            for bit in order.tolist():
                over = np.bincount(part) > cap
                if not over.any():
                    break
                one = (sig[own, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64)
                part = np.unique(part * 2 + np.where(over[part], one, 0), return_inverse=True)[1].reshape(-1)
            rows.append(own)
            out.append(part + at)
            at += int(part.max()) + 1
    return np.concatenate(rows), np.concatenate(out)


def _near(sig: np.ndarray, a: np.ndarray, b: np.ndarray, words: int, pairs: int, total: int) -> np.ndarray:
    one = np.bitwise_count(sig[a, 0] ^ sig[b, 0]).astype(np.int16) + np.bitwise_count(sig[a, 1] ^ sig[b, 1])
    ok = np.flatnonzero(one <= words)
    x, y = a[ok], b[ok]
    two = np.bitwise_count(sig[x, 2] ^ sig[y, 2]).astype(np.int16) + np.bitwise_count(sig[x, 3] ^ sig[y, 3])
    return ok[(two <= pairs) & (one[ok] + two <= total)]


def forest(ids: np.ndarray, sig: np.ndarray, bucket: np.ndarray, words: int, pairs: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs within buckets, as pairs of ids."""
    order = np.argsort(bucket, kind="stable")
    ids, sig, bucket = ids[order], sig[order], bucket[order]
    root = np.arange(len(ids))
    left: list[int] = []
    right: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = np.arange(len(ids))
    step = 1
    while True:
        rows = rows[rows < len(ids) - step]
        rows = rows[bucket[rows] == bucket[rows + step]]
        if not len(rows):
            break
        for at in range(0, len(rows), 1 << 18):
            a = rows[at : at + (1 << 18)]
            hit = a[_near(sig, a, a + step, words, pairs, total)]
            if len(hit):
                while not np.array_equal(root, flat := root[root]):
                    root[:] = flat
                hit = hit[root[hit] != root[hit + step]]
                for i in hit.tolist():
                    x, y = find(i), find(i + step)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        left.append(i)
                        right.append(i + step)
        step += 1
    return ids[left], ids[right]


def _deep(distinct: DataFrame, k: int, tables: int, limit: int, most: int = 44) -> dict[int, int]:
    """The buckets of more than limit signatures, and by how many further coordinates to split each; all signatures are counted."""
    deep: dict[int, int] = {}
    while True:

        def count(batches: Iterator[pd.DataFrame], known: dict[int, int] = deep) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sig = batch[["s0", "s1"]].to_numpy(dtype=np.int64).view(np.uint64)
                for _, b, base in buckets(sig, k, tables, known):
                    yield pd.DataFrame({"b": b, "base": base})

        found = distinct.select("s0", "s1").mapInPandas(count, "b long, base long").groupBy("b", "base").count().where(F.col("count") > limit).groupBy("base").agg(F.max("count").alias("n")).toPandas()
        again = {int(b): min(most, deep.get(int(b), 0) + max(1, math.ceil(math.log2(n / limit)))) for b, n in zip(found["base"], found["n"]) if deep.get(int(b), 0) < most}
        if not again:
            return deep
        deep = deep | again


def groups(docs: DataFrame, words: int = 24, pairs: int = 32, total: int = 52, cap: int = 1000, signatures_per_shard: int = 20_000, rows_per_task: int = 80_000, limit: int = 200_000, before: DataFrame | None = None) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the group's least doc_id.

    ``before`` are the same documents as they were, by doc_id: two are near, too, if the texts were
    that they had there. Of its rows only those count whose doc_id docs has.

    Two documents are near if at most ``words`` of the 128 word bits and ``pairs`` of the 128 pair
    bits differ, ``total`` of both; groups are the connected components. Null and wordless texts, and rows without a
    doc_id, are in no group. Rows that share a doc_id are one document; repeated rows give one row.
    Ties go to the least doc_id. Texts of any length are signed whole. Extra columns are ignored, whatever their names; an empty table gives no group.
    """
    all_ = common.written(signed(docs), "signatures")
    if before is not None:
        then = signed(before).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        all_ = common.written(all_.unionByName(then).distinct(), "signatures", (all_,))
    distinct = common.written(all_.groupBy("s0", "s1", "s2", "s3").agg(F.min("doc_id").alias("id")), "distinct")
    n = distinct.count()
    k, tables = plan(n)
    shards = max(1, math.ceil(n * tables / signatures_per_shard))

    # a bucket that many tasks' rows would fall into; there are at most n * tables / limit
    deep = _deep(distinct, k, tables, limit) if n > limit else {}

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = batch[["s0", "s1"]].to_numpy(dtype=np.int64).view(np.uint64)
            for rows, b, _ in buckets(sig, k, tables, deep):
                if len(rows):
                    yield batch.iloc[rows].assign(shard=(b.view(np.uint64) % np.uint64(shards)).astype(np.int32), bucket=b)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sig = np.ascontiguousarray(part[["s0", "s1", "s2", "s3"]].to_numpy(dtype=np.int64)).view(np.uint64)
        rows, bucket = _split(sig, part["bucket"].to_numpy(), cap)
        a, b = forest(part["id"].to_numpy()[rows], sig[rows], bucket, words, pairs, total)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    edges = distinct.mapInPandas(sample, f"{SIGNATURE}, id long, shard int, bucket long")
    # tasks of one size, however many there are
    edges = edges.repartition(max(1, math.ceil(n * tables / rows_per_task)), "shard").groupBy("shard").applyInPandas(compare, "a long, b long")
    same = all_.join(distinct, ["s0", "s1", "s2", "s3"]).where(F.col("doc_id") != F.col("id")).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    return common.components(edges.unionByName(same))


def drop_near_copies(docs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """docs with one document of each group, the one of the least doc_id; all columns are kept. ``before`` as in groups.

    Rows without a doc_id, and null or wordless texts, stay. The ids to drop are few beside the
    texts; they are joined by doc_id, as a broadcast where Spark finds them small enough.
    """
    gone = groups(docs, before=before).where(F.col("doc_id") != F.col("group_id")).select(F.col("doc_id").alias("_gone"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return row.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id) of all documents that have a near copy; odd rows as in groups."""
    return groups(common.read(spark, sf_dir, "documents"))

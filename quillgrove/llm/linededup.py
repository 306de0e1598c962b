"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

An index holds, for every line that any inserted document has, how often it was inserted (the exact
table ``refs``) and, for each shard of the keys, a cuckoo filter of the lines whose count is above
zero. Inserting documents probes the filters first: a line that no filter knows is new, and only
the others are looked up in the table. A batch adds a run to the table, its own counts, so inserting
costs what the batch has and not what the index has; many runs are merged into one.

Deleting documents adds their counts with a minus; a line at zero leaves its filter, so the index
then answers as if the documents had never come. The index also keeps which document has which line,
by key: where a line stood in a deleted document and was taken out of later ones, deleting says
which of these it goes back to.

The lines of a batch are counted by hash with map-side combination, so a line that every document
has costs one row a task. The texts themselves are shuffled once, to meet the positions to drop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common

KEYS_PER_SHARD = 400_000
#: So many runs of counts are merged into one.
RUNS = 16
FILTERS = "shard int, n long, slots binary"


class Cuckoo:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket (Fan et al. 2014), worked on in whole arrays."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n: int) -> "Cuckoo":
        return cls(np.zeros((1 << max(2, math.ceil(math.log2(max(n, 1) / 3.2))), 4), dtype=np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995) & (len(self.slots) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a = self._places(keys)
        return (self.slots[a] == p[:, None]).any(1) | (self.slots[self._other(p, a)] == p[:, None]).any(1)

    def _fill(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts what finds a free slot at its place; which did not."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.slots[b] == 0
        fits = rank < free.sum(1)
        slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
        self.slots[b[fits], slot[fits]] = prints[order[fits]]
        return np.sort(order[~fits])

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; then it is to be built anew, larger."""
        p, a = self._places(keys)
        rest = self._fill(p, a)
        p, a = p[rest], self._other(p[rest], a[rest])
        for turn in range(500):
            rest = self._fill(p, a)
            p, a = p[rest], a[rest]
            if not len(p):
                return True
            first = np.unique(a, return_index=True)[1]
            slot = (p[first].astype(np.int64) * 31 + turn) % 4
            out = self.slots[a[first], slot]
            self.slots[a[first], slot] = p[first]
            p[first], a[first] = out, self._other(out, a[first])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint a key; the keys must be in."""
        p, a = self._places(keys)
        b = self._other(p, a)
        while len(p):
            at = np.where((self.slots[a] == p[:, None]).any(1), a, b)
            first = np.unique(at, return_index=True)[1]
            hit = self.slots[at[first]] == p[first][:, None]
            found = hit.any(1)
            self.slots[at[first][found], hit.argmax(1)[found]] = 0
            rest = np.ones(len(p), dtype=bool)
            rest[first] = False
            p, a, b = p[rest], a[rest], b[rest]


@dataclass
class Index:
    """What was inserted, all of it written.

    runs: (k0, k1, n), whose sums by key are the reference counts; lines (doc_id, dh, pos, k0, k1,
    batch) of all documents; gone (doc_id, dh, batch), the deleted ones and how many batches there
    were by then; filters (shard, n, slots) of the keys; shards and batches are their numbers.
    """

    runs: tuple[DataFrame, ...]
    lines: tuple[DataFrame, ...]
    gone: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    batches: int

    @property
    def refs(self) -> DataFrame:
        """(k0, k1, n): the lines that some document has, and how often."""
        return _all(self.runs).groupBy("k0", "k1").agg(F.sum("n").alias("n")).where("n > 0")

    def counted(self, keys: DataFrame) -> DataFrame:
        """(k0, k1, n) of those of the keys that some document has."""
        return _all(self.runs).join(keys.select("k0", "k1"), ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.sum("n").alias("n")).where("n > 0")

    def alive(self) -> DataFrame:
        """The lines of the documents that weren't deleted."""
        if not self.gone:
            return _all(self.lines)
        g = _all(self.gone).groupBy(F.col("doc_id").alias("_doc"), F.col("dh").alias("_dh")).agg(F.max("batch").alias("_until"))
        return _all(self.lines).join(g, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("dh").eqNullSafe(F.col("_dh")) & (F.col("batch") < F.col("_until")), "left_anti")


def _all(parts: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _keys(line: Column) -> list[Column]:
    """Two hashes of the line. The second starts from another seed: xxhash64(line, 1) would be a function of the first."""
    return [F.xxhash64(line).alias("k0"), F.xxhash64(F.lit(1), line).alias("k1")]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, dh, pos, k0, k1) of every line that isn't blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("doc_id", "dh", "pos", *_keys(F.trim("line")))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k0"), F.lit(shards)).cast("int")


def _updated(changes: DataFrame, index: Index | None, refs: DataFrame, shards: int) -> DataFrame:
    """The filters after keys came in (d = 1) or went out (d = -1); one that is too full is built anew from the exact keys refs."""

    def build(keys: np.ndarray) -> Cuckoo:
        n = len(keys)
        while not (f := Cuckoo.sized(n)).insert(keys):
            n = max(8, n * 2)
        return f

    def fresh(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["k0"].to_numpy().astype(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": part["shard"].iloc[:1].to_numpy(), "n": [len(keys)], "slots": [build(keys).slots.tobytes()]})

    def change(key: tuple, old: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        keys, d = part["k0"].to_numpy().astype(np.int64).view(np.uint64), part["d"].to_numpy()
        if not len(old):
            f, n = Cuckoo.sized(len(keys)), 0
        else:
            f, n = Cuckoo(np.frombuffer(old["slots"].iloc[0], dtype=np.uint16).reshape(-1, 4).copy()), int(old["n"].iloc[0])
        f.delete(keys[d < 0])
        n += int(d.sum())
        ok = n <= 3.8 * len(f.slots) and f.insert(keys[d > 0])
        return pd.DataFrame({"shard": [int(key[0])], "n": [n], "slots": [f.slots.tobytes() if ok else b""]})

    if index is None:
        return changes.groupBy("shard").applyInPandas(fresh, FILTERS)
    done = common.written(index.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, FILTERS), "filters")
    full = done.where(F.length("slots") == 0).select("shard")
    again = refs.withColumn("shard", _shard(shards)).join(F.broadcast(full), "shard").groupBy("shard").applyInPandas(fresh, FILTERS)
    return done.where(F.length("slots") > 0).unionByName(again)


def _known(keys: DataFrame, index: Index) -> DataFrame:
    """Of keys, those in the index: what the filters can't rule out, looked up in the exact table."""

    def probe(key: tuple, old: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(old):
            return part.iloc[:0][["k0", "k1"]]
        f = Cuckoo(np.frombuffer(old["slots"].iloc[0], dtype=np.uint16).reshape(-1, 4))
        return part[f.contains(part["k0"].to_numpy().astype(np.int64).view(np.uint64))][["k0", "k1"]]

    maybe = index.filters.groupBy("shard").cogroup(keys.select("k0", "k1", _shard(index.shards).alias("shard")).groupBy("shard")).applyInPandas(probe, "k0 long, k1 long")
    return index.counted(maybe).select("k0", "k1")


def _started(counts: DataFrame, lines: DataFrame) -> Index:
    shards = max(1, math.ceil(counts.count() / KEYS_PER_SHARD))
    changes = counts.select("k0", _shard(shards).alias("shard"))
    return Index((counts,), (lines,), (), common.written(_updated(changes, None, counts, shards), "filters"), shards, 1)


def _changed(index: Index, run: DataFrame, changes: DataFrame) -> Index:
    """The index with one more run, and its filters after changes (k0, k1, d). They get more shards when these have grown fourfold."""
    index = replace(index, runs=(*index.runs, run))
    if len(index.runs) > RUNS:
        index = replace(index, runs=(common.written(index.refs, "refs"),))
    filters = common.written(_updated(changes.select("k0", "d", _shard(index.shards).alias("shard")), index, index.refs, index.shards), "filters")
    n = filters.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n > 4 * KEYS_PER_SHARD * index.shards:
        shards = math.ceil(n / KEYS_PER_SHARD)
        filters = common.written(_updated(index.refs.select("k0", _shard(shards).alias("shard")), None, index.refs, shards), "filters")
        index = replace(index, shards=shards)
    return replace(index, filters=filters)


def delete(docs: DataFrame, index: Index) -> tuple[DataFrame, Index]:
    """Lines that go back, and the index without documents that were inserted before.

    Documents are known by doc_id and hash of the text, as they were inserted; all rows of a document
    go. Those that the index doesn't have, and null, empty and blank texts, change nothing; so does an empty table.
    Repeated rows are one document. Extra columns are ignored, whatever their names; texts of any length are taken whole.

    The first result is (doc_id, dh, pos): a line that a deleted document had kept, and that was
    taken out of others, goes back to the first of these by (batch, doc_id, hash, position), at line
    number pos of its text as it was inserted. An insert from then on gives what it would
    if the deleted documents had never come.
    """
    out = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("dh")).distinct()
    out = common.written(out.withColumn("batch", F.lit(index.batches)), "gone")
    alive, after = index.alive(), replace(index, gone=(*index.gone, out))
    lost = alive.join(out.select(F.col("doc_id").alias("_doc"), F.col("dh").alias("_dh")), F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("dh").eqNullSafe(F.col("_dh")), "left_semi")
    run = common.written(lost.groupBy("k0", "k1").agg((-F.count("*")).alias("n")), "refs")
    left = replace(index, runs=(*index.runs, run)).counted(run)
    zero = run.join(left, ["k0", "k1"], "left_anti")
    place = F.struct("batch", "doc_id", "dh", "pos")
    shared = alive.join(left, ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.min(place).alias("before"))
    then = after.alive().join(left, ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.min(place).alias("now"))
    back = then.join(shared, ["k0", "k1"]).where("not (now <=> before)").select("now.doc_id", "now.dh", "now.pos")
    return back, _changed(after, run, zero.withColumn("d", F.lit(-1)))


def insert(docs: DataFrame, index: Index | None = None) -> tuple[DataFrame, Index]:
    """docs with each line that was seen before taken out, and the index with docs in it.

    A line is seen before if the index has it, or if it stands earlier in docs by (doc_id, hash of
    the text, position), null ids first. Lines are equal if they are after trimming blanks; blank
    lines always stay. A document of which nothing is left is dropped; null, empty and blank texts
    have no lines and stay as they are. n_chars, where docs has it, is set anew for changed texts;
    the column n_removed counts the lines taken out. Rows that share doc_id and text are one document:
    each gets the same result. Extra columns are kept, whatever their names; texts of any length are taken whole. An empty table gives an
    empty result and leaves the index as it is.
    """
    occ = common.written(occurrences(docs), "lines")
    keys = common.written(occ.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "dh", "pos")).alias("first")), "keys")
    twice = keys.where("n > 1").select("k0", "k1", F.col("first"))
    if index is not None:
        known = common.written(_known(keys, index), "known").withColumn("known", F.lit(True))
        twice = keys.join(known, ["k0", "k1"], "left").where("known or n > 1").select("k0", "k1", F.when(F.col("known"), F.lit(None)).otherwise(F.col("first")).alias("first"))
    first = F.struct("doc_id", "dh", "pos")
    gone = occ.join(twice, ["k0", "k1"]).where(F.col("first").isNull() | ~first.eqNullSafe(F.col("first")))
    words = gone.groupBy("doc_id", "dh", F.expr("pos div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    masks = words.groupBy(F.col("doc_id").alias("_doc"), F.col("dh").alias("_dh")).agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("_map"), F.max("w").alias("_top"), F.sum(F.bit_count("bits")).alias("_n"))
    masks = masks.select("_doc", "_dh", "_n", F.expr("transform(sequence(0, _top), i -> coalesce(try_element_at(_map, i), 0L))").alias("_mask"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    met = row.join(masks, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_dh")), "left")
    # of the kept lines: null where the mask has no bit for them
    kept = F.expr("filter(split(_row.text, '\\n', -1), (x, i) -> (coalesce(get(_mask, int(i div 64)), 0L) & shiftleft(1L, i % 64)) = 0)")
    met = met.withColumn("_kept", F.when(F.col("_n") > 0, kept))
    met = met.where(F.col("_n").isNull() | F.exists("_kept", lambda x: F.trim(x) != ""))
    text = F.when(F.col("_n").isNull(), F.col("_row.text")).otherwise(F.array_join("_kept", "\n"))
    changed = {"text": text, "n_chars": F.when(F.col("_n").isNull(), F.col("_row.n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    out = met.select(*[(changed[c] if changed.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c != "n_removed"], F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))
    counts = keys.select("k0", "k1", "n")
    if index is None:
        return out, _started(counts, occ.withColumn("batch", F.lit(0)))
    index = replace(index, lines=(*index.lines, occ.withColumn("batch", F.lit(index.batches))), batches=index.batches + 1)
    return out, _changed(index, counts, keys.join(known, ["k0", "k1"], "left_anti").withColumn("d", F.lit(1)))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs up to the median doc_id, and beyond it; null ids belong to the first."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    upper = F.coalesce(F.col("doc_id") > F.lit(middle).cast("long"), F.lit(False))
    return docs.where(~upper), docs.where(upper)


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the lines that stand earlier, as insert gives them; the second half by doc_id goes through an index of the first."""
    low, high = halves(docs)
    first, index = insert(low)
    return first.unionByName(insert(high, index)[0])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through an index, the lower half by doc_id and then the upper; the upper half is deleted and inserted again.

    The rows are those of insert over the whole table at once: the filters and the table decide on
    every line of the upper half, twice, and must know the lower half's lines and have forgotten the
    upper's. Null ids belong to the lower half.
    """
    docs = common.read(spark, sf_dir, "documents")
    low, high = halves(docs)
    first, index = insert(low)
    _, index = insert(high, index)
    _, index = delete(high, index)
    second, _ = insert(high, index)
    return first.unionByName(second)


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, line, pos, trim(line) = '' AS blank, row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) AS nth FROM l
), g AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE blank OR nth = 1) AS kept,
         count(*) FILTER (WHERE NOT blank AND nth > 1) AS n_removed, count(*) FILTER (WHERE NOT blank AND nth = 1) AS n_kept
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN g.n_removed > 0 THEN g.kept ELSE d.text END AS text, d.lang, d.source,
       CASE WHEN g.n_removed > 0 THEN CAST(length(g.kept) AS BIGINT) ELSE d.n_chars END AS n_chars, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
WHERE coalesce(g.n_removed, 0) = 0 OR g.n_kept > 0
"""

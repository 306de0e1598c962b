"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish time is its source's
tokens up to and with it, divided by the source's weight; the documents of least finish time make
the mix, up to the total budget. A source that runs out leaves its share to the others.

Only keys are worked on; texts of documents beyond the budget are left out where they are read, as
the budget ends each source's order of hashes at one place. The others are shuffled to their bucket
of hashes, for their finish time, and into the order of the result.

No source is ever sorted as a whole: its hashes are cut into even buckets, whose sums give each
bucket's start. The budget's end is found the same way, over even spans of finish time: at most the
weights' sum of tokens falls into a unit of it, so the spans are bounded. Only the span in which the
budget ends is looked at row by row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.llm import common

ROWS_PER_BUCKET = 5_000
BUDGET_SHARE = 0.5
#: The weights of op9_mixing; sources that aren't named have 1.
WEIGHTS = {"src0": 0.5, "src1": 3.0, "src2": 2.0, "src3": 4.0, "src4": 0.25, "src5": 1.5}
#: Up to so many sources, the ends of their orders are a broadcast of some 10 MB.
FEW_SOURCES = 100_000
_ORDER = ["_finish", "_source", "_hash", "_id", "_dh"]


def _keyed(docs: DataFrame, seed: str, *keep: Column) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(*keep, source.alias("_source"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_dh"), common.word_count(F.col("text")).alias("_tokens"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_hash"))


class Mix:
    """Finish times of all documents, and which are in the mix.

    The texts are read once, for their lengths; all else works on keys, which are written.
    """

    def __init__(self, docs: DataFrame, weights: Mapping[str, float] | None, budget_share: float, budget: int | None, seed: str):
        self.weight = F.lit(1.0)
        for name, w in (weights or {}).items():
            self.weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(self.weight)
        keys = common.written(_keyed(docs, seed), "keys")
        n, total = keys.agg(F.count("*"), F.coalesce(F.sum("_tokens"), F.lit(0))).first()
        self.digits = max(0, math.ceil(math.log(max(n, 1) / ROWS_PER_BUCKET, 16)))
        sums = keys.groupBy("_source", self.bucket()).agg(F.sum("_tokens").alias("t"))
        self.before = common.written(sums.select("_source", "_b", (F.sum("t").over(Window.partitionBy("_source").orderBy("_b")) - F.col("t")).alias("_before")), "before")
        self.times = common.written(self.finished(keys), "times")
        self.limit = math.floor(budget_share * total) if budget is None else budget
        self.inside = self.condition()

    def bucket(self) -> Column:
        return F.substring("_hash", 1, self.digits).alias("_b")

    def finished(self, rows: DataFrame) -> DataFrame:
        """Rows with keys, and their finish time."""
        within = Window.partitionBy("_source", "_b").orderBy("_hash", "_id", "_dh").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.where(self.weight > 0).withColumn("_b", self.bucket()).join(self.before, ["_source", "_b"])
        return rows.withColumn("_finish", (F.col("_before") + F.sum("_tokens").over(within)) / self.weight).drop("_b", "_before")

    def condition(self) -> Column:
        """Of a row with finish time, whether it's in the mix."""
        most, n = self.times.agg(F.max("_finish"), F.count("*")).first()
        if most is None:
            return F.lit(True)
        width = most / max(1, math.ceil(n / ROWS_PER_BUCKET)) or 1.0
        span = F.floor(F.col("_finish") / F.lit(width))
        spans = self.times.groupBy(span.alias("_span")).agg(F.sum("_tokens").alias("t"))
        spans = spans.withColumn("upto", F.sum("t").over(Window.orderBy("_span")))
        over = spans.where(F.col("upto") > self.limit).orderBy("_span").select("_span", (F.col("upto") - F.col("t")).alias("before")).limit(1).collect()
        if not over:
            return F.lit(True)
        last = self.times.where(span == over[0]["_span"]).withColumn("upto", over[0]["before"] + F.sum("_tokens").over(Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)))
        kept = last.where(F.col("upto") <= self.limit).agg(F.max(F.struct(*_ORDER)).alias("m")).first()["m"]
        if kept is None:
            return span < over[0]["_span"]
        return F.struct(*_ORDER) <= F.struct(*[F.lit(kept[c]).cast(self.times.schema[c].dataType).alias(c) for c in _ORDER])


    def cut(self, rows: DataFrame) -> DataFrame:
        """Of rows with keys, those in the mix: up to the last one of their source that is."""
        order = F.struct("_hash", "_id", "_dh")
        ends = common.written(self.times.where(self.inside).groupBy(F.col("_source").alias("_of")).agg(F.max(order).alias("_end")), "ends")
        few = ends.count() <= FEW_SOURCES
        return rows.join(F.broadcast(ends) if few else ends, F.col("_source") == F.col("_of")).where(order <= F.col("_end")).drop("_of", "_end")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget_share: float = BUDGET_SHARE, budget: int | None = None, seed: str = "mix-") -> DataFrame:
    """docs of the mix in order of finish time, all columns kept.

    ``weights`` by source, 1 where none is given; sources of weight 0 or less are left out. The
    budget in tokens (words between white space) is ``budget``, or ``budget_share`` of all tokens;
    the mix ends before the first document that would exceed it. Null sources are the source "".
    Documents without tokens cost nothing and stand where their hash puts them. Ties go by source,
    hash, doc_id and text; repeated rows are documents of their own. Texts of any length are counted
    and kept whole, and columns may have any name. An empty table gives an empty mix.
    """
    m = Mix(docs, weights, budget_share, budget, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return m.finished(m.cut(_keyed(docs, seed, row))).orderBy(*_ORDER).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by WEIGHTS within half of all tokens: (doc_id, source, n_tokens, finish) in order of finish time; rows as in mix."""
    m = Mix(common.read(spark, sf_dir, "documents"), WEIGHTS, BUDGET_SHARE, None, "mix-")
    return m.times.where(m.inside).orderBy(*_ORDER).select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_finish").alias("finish"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, {common.WORD_COUNT_SQL} AS n_tokens, md5('mix-' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), f AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 1.0 END AS DOUBLE) AS finish FROM d
), u AS (
  SELECT *, sum(n_tokens) OVER (ORDER BY finish, source, h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT doc_id, source, n_tokens, finish FROM u WHERE upto <= (SELECT floor({BUDGET_SHARE} * sum(n_tokens)) FROM d)
"""

"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove import registry
from quillgrove.sources import files

SPACE = "[ \\t\\n\\r\\f]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory."""
    return registry.table(spark, sf_dir, table)


def lowered(text: str) -> str:
    """text in lower case, each character at its place: of the few whose lower case is longer, the first of it."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def word_count(text: Column) -> Column:
    """Words between white space, as long; 0 for null and blank texts.

    Each word becomes one letter, whose number is the result: a split would make a string of each.
    """
    x = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE[:-1]}*+[^{SPACE[1:-2]}]++{SPACE[:-1]}*+", "x")
    return F.when(x.startswith("x"), F.length(x)).otherwise(0).cast("long")


#: The same in DuckDB.
WORD_COUNT_SQL = "CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS BIGINT)"


def written(df: DataFrame, name: str, after: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df, written as Parquet in the shared folder and read again; ``after`` are written ones that nothing needs any more."""
    path = files.scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written = path
    for x in after:
        drop(x)
    return out


def drop(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for df, if it did."""
    if path := getattr(df, "_written", None):
        files.remove(df.sparkSession, path)


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the connected components of edges (a, b); group_id is the least doc_id.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is one aggregation over
    edges whose number never grows. Each round is written to the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("m"), "a", "b")
        star = small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = written(star, "edges", (edges,))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("group_id")).unionByName(edges.select(F.col("a").alias("doc_id"), F.col("a").alias("group_id")).distinct())

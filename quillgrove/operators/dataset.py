"""Dataset operations: deduplication, unions, caches, fingerprints, quotas and overlaps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.functions import text as T
from quillgrove.sources.files import written


def keep(rows: DataFrame, key: Sequence[str] | str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order; a null key is a key."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def keep_first(lists: Sequence[DataFrame], key: Sequence[str], rank: str) -> DataFrame:
    """Ranked lists one after the other, each key where it comes first."""
    both = None
    for i, d in enumerate(lists):
        d = d.withColumn("list_ord", F.lit(i))
        both = d if both is None else both.unionByName(d, allowMissingColumns=True)
    return keep(both, key, [F.col("list_ord"), F.col(rank)])


def update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; columns that one lacks are null."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep(both, key, [F.desc("_new")]).drop("_new")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows, how many keys, and the difference."""
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), (F.count("*") - F.countDistinct(key)).alias("n_duplicates"))


def fingerprint(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The first 16 digits of the md5 of the sorted keys, by group."""
    ids = F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "|")
    return rows.groupBy(*by).agg(F.substring(F.md5(ids), 1, 16).alias("fingerprint"))


def merkle_fingerprint(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The first 16 digits of a digest that is built in two steps, for groups of any size.

    Keys are spread by the first four digits of their md5; the digest of a group is the md5 of the
    digests of its 65,536 parts, each that of its sorted keys. It isn't the value of ``fingerprint``.
    """
    k = rows.select(*by, F.col(key).cast("string").alias("_k")).where("_k is not null")
    parts = k.groupBy(*by, F.substring(F.md5("_k"), 1, 4).alias("_p")).agg(F.md5(F.array_join(F.sort_array(F.collect_list("_k")), "|")).alias("_d"))
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), "|")
    return parts.groupBy(*by).agg(F.substring(F.md5(digests), 1, 16).alias("fingerprint"))


def numbered(rows: DataFrame, by: str, order: str, span_rows: int = 200_000) -> DataFrame:
    """rows with ``rn``, their place in their group by a whole number, from 1; as row_number, but no group is sorted as a whole.

    The order's range is cut into even spans; places within a span are added to the counts of the spans before.
    """
    rows = written(rows, "rows")
    n, low, high = rows.agg(F.count("*"), F.min(order), F.max(order)).first()
    spans = max(1, math.ceil(n / span_rows))
    width = ((high or 0) - (low or 0)) // spans + 1
    cut = rows.withColumn("_span", F.coalesce(F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)), F.lit(-1)))
    counts = cut.groupBy(F.col(by).alias("_by"), F.col("_span").alias("_of")).agg(F.count("*").alias("_n"))
    before = counts.select("_by", "_of", (F.sum("_n").over(Window.partitionBy("_by").orderBy("_of")) - F.col("_n")).alias("_before"))
    met = cut.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_span") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(by, "_span").orderBy(order))
    return met.withColumn("rn", (F.col("_before") + place).cast("long")).drop("_span", "_by", "_of", "_before")


def cache_key(size: Column, name: Column) -> Column:
    return F.md5(F.concat(size.cast("string"), F.lit("_"), name))


def to_process(listing: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """The files of a listing (name, size) that the manifest (key) doesn't have; all if forced."""
    keyed = listing.withColumn("key", cache_key(F.col("size"), F.col("name")))
    return keyed if force else keyed.join(manifest.select("key"), "key", "left_anti")


def quota(rows: DataFrame, limits: Mapping[tuple[str, ...], int], order: Sequence[str], total: int | None = None) -> DataFrame:
    """The first rows of each group by order, one limit after the other, then of all."""
    for i, (keys, n) in enumerate(limits.items()):
        rows = rows.withColumn(f"_q{i}", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(f"_q{i}") <= n).drop(f"_q{i}")
    return rows if total is None else rows.orderBy(*order).limit(total)


def coded(code: Column, names: Mapping[str, str], prefix: str = "IC_") -> Column:
    """The name of a code; unknown ones as the code with a prefix."""
    table = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit(prefix), code))


def parse_vector(text: Column) -> Column:
    """A vector written as text; null where it isn't one, or is empty."""
    v = F.from_json(text, "array<float>")
    return F.when(F.size(v) > 0, v)


def from_templates(spark: SparkSession, templates: Mapping[str, str], conditions: Sequence[str], each: int, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, condition, a column a template): ``each`` documents of every condition, their other placeholders filled by hash of the id."""
    ids = spark.range(each * len(conditions)).withColumn("condition", F.get(F.array(*[F.lit(c) for c in conditions]), F.expr(f"int(id div {each})")))
    return ids.select("id", "condition", *[T.filled_template(F.replace(F.lit(t), F.lit("{condition}"), F.col("condition")), values, F.col("id")).alias(n) for n, t in templates.items()])


def enrich(results: DataFrame, index: DataFrame, key: str, columns: Sequence[str], flag: str | None = None) -> DataFrame:
    """results with what they lack (null or '') filled from the first row of the index of the same key; flag is true if either says so."""
    first = keep(index, key, [F.col(c) for c in columns]).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], *([F.col(flag).alias("_flag")] if flag else []))
    out = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}
    if flag:
        out[flag] = F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col("_flag"), F.lit(False))
    return results.join(first, F.col(key) == F.col("_key"), "left").withColumns(out).select(*results.columns)


def shared_tokens(a: DataFrame, b: DataFrame, least: int, shorter_than: int = 1) -> DataFrame:
    """(a_id, b_id, n) of texts (id, text) that share ``least`` or more different words of ``shorter_than`` characters or more."""
    side = lambda d, n: d.select(F.col("id").alias(n), F.explode(F.array_distinct(T.words(F.lower("text")))).alias("token")).where(F.length("token") >= shorter_than)
    return side(a, "a_id").join(side(b, "b_id"), "token").groupBy("a_id", "b_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)

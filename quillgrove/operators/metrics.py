"""Ranking metrics over ranked rows (query_id, item_id, rank) and relevant pairs (query_id, item_id).

Ranked rows count as they come: an item that is ranked twice is two hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.sources.files import written


def hits(ranked: DataFrame, relevant: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranked rows, with the columns ``by`` if several systems are ranked, with ``hit`` and the number of relevant items of the query, ``n_relevant`` (0 for none)."""
    r = relevant.select("query_id", "item_id").distinct()
    n = r.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    h = ranked.select(*by, "query_id", "item_id", "rank").join(r.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").join(n, "query_id", "left")
    return h.select(*by, "query_id", "item_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def hits_by_label(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """As hits, where all other items of the query's label (item_id, label) are relevant; no pair of them is made."""
    n = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    q = labels.join(n, "label").select(F.col("item_id").alias("query_id"), F.col("label").alias("_label"), "n_relevant")
    h = ranked.select("query_id", "item_id", "rank").join(q, "query_id", "left").join(labels, "item_id", "left")
    hit = F.coalesce((F.col("label") == F.col("_label")) & (F.col("item_id") != F.col("query_id")), F.lit(False)).cast("int")
    return h.select("query_id", "item_id", "rank", hit.alias("hit"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def hits_by_topics(ranked: DataFrame, queries: DataFrame, items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As hits, where the items (item_id, topics) that share a topic with a query (query_id, topics) are relevant; no pair of them is made.

    Relevant items are counted by the sets of topics that there are. Rows of one id are one, with the topics of all.
    """
    one = lambda d, key: d.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"))
    q, i = written(one(queries, "query_id"), "queries"), written(one(items, "item_id"), "items")
    sets = i.groupBy("topics").agg(F.count("*").alias("n"))
    met = q.select("query_id", F.explode("topics").alias("topic")).join(sets.select("topics", "n", F.explode("topics").alias("topic")), "topic").select("query_id", "topics", "n").distinct()
    n = met.groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    h = ranked.select(*by, "query_id", "item_id", "rank").join(q.withColumnRenamed("topics", "_q"), "query_id", "left").join(i.withColumnRenamed("topics", "_i"), "item_id", "left").join(n, "query_id", "left")
    hit = F.coalesce(F.arrays_overlap("_q", "_i"), F.lit(False)).cast("int")
    return h.select(*by, "query_id", "item_id", "rank", hit.alias("hit"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def precision(k: int, mode: str = "always") -> Column:
    """Hits in the first k over k. mode "full": 0 unless k rows were ranked."""
    p = F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1).otherwise(0)) / F.lit(k)
    return F.when(F.max("rank") >= k, p).otherwise(F.lit(0.0)) if mode == "full" else p


def recall(k: int) -> Column:
    found = F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1).otherwise(0))
    return F.when(F.max("n_relevant") == 0, F.lit(0.0)).otherwise(found / F.max("n_relevant"))


def ideal(n: Column) -> Column:
    """Gain of n hits at the first n ranks."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))


def ndcg(k: int) -> Column:
    gain = F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0)))
    best = ideal(F.least(F.max("n_relevant"), F.lit(k)))
    return F.when(best == 0, F.lit(0.0)).otherwise(gain / best)


def reciprocal_rank() -> Column:
    return F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0))


def per_query(h: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), by: Sequence[str] = ()) -> DataFrame:
    """A row for each query, of each system ``by``, with precision, recall and nDCG at each k, average precision, reciprocal rank and hits in five."""
    so_far = F.sum("hit").over(Window.partitionBy(*by, "query_id").orderBy("rank"))
    h = h.withColumn("gain", F.when(F.col("hit") == 1, so_far / F.col("rank")).otherwise(F.lit(0.0)))
    ap = F.when(F.max("n_relevant") == 0, F.lit(0.0)).otherwise(F.sum("gain") / F.max("n_relevant"))
    cols = [f(k).alias(f"{n}_{k}") for k in ks for n, f in (("precision", precision), ("recall", recall), ("ndcg", ndcg))]
    return h.groupBy(*by, "query_id").agg(*cols, ap.alias("ap"), reciprocal_rank().alias("rr"), F.sum(F.when((F.col("rank") <= 5) & (F.col("hit") == 1), 1).otherwise(0)).alias("hits_5"))


def summary(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row for each metric: mean, population deviation, least and most over the queries, how many are 0 or 1."""
    one = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select(*by, "m.*")
    return one.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(F.col("value") == 0).alias("n_zero"), F.count_if(F.col("value") == 1).alias("n_perfect"))

"""Queries that write a table and read it back in each form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.operators import chunk as C
from quillgrove.plans.chunk_queries import _SLIDING
from quillgrove.plans.graph_queries import GRAPH, graph
from quillgrove.registry import query, table
from quillgrove.sources import files as S
from quillgrove.streaming import ingest as I


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_SAME = "SELECT doc_id, md5(text) AS digest, lang FROM documents"


def _same(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.md5("text").alias("digest"), "lang")


@query(_SAME)
def s1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "csv")
    S.write_csv(_docs(spark, sf_dir), path, S.NULL)
    return _same(S.read_csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long", S.NULL))


@query(_SAME)
def s2_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "json")
    _docs(spark, sf_dir).write.json(path)
    return _same(S.read_json(spark, path, "doc_id long, text string, lang string"))


@query("SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_characters FROM documents GROUP BY lang")
def s7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "texts")
    _docs(spark, sf_dir).select("text", "lang").write.partitionBy("lang").text(path)
    t = S.read_texts(spark, path)
    return t.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).agg(F.sum(F.length("text")).alias("n_characters"))


@query("SELECT DISTINCT lang FROM documents")
def s8_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "texts")
    _docs(spark, sf_dir).select("text", "lang").write.partitionBy("lang").text(path)
    return S.listing(spark, path, "*.txt").where("size > 0").select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).distinct()


@query("SELECT lang, CASE WHEN lang = 'de' THEN 'fallback' ELSE 'primary' END AS extraction_method, CAST(sum(length(text) + CASE WHEN lang = 'de' THEN 2 ELSE 1 END) AS BIGINT) AS n_characters FROM documents GROUP BY lang")
def s6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one language are marked, beyond the first extractor and left to the second."""
    path = S.scratch(spark, "texts")
    marked = F.when(F.col("lang") == "de", F.concat(F.lit("%"), "text")).otherwise(F.col("text"))
    _docs(spark, sf_dir).select(marked.alias("text"), "lang").write.partitionBy("lang").text(path)
    d = S.read_documents(spark, path, lambda content: [] if content.startswith(b"%") else [content.decode()], lambda content: [content.decode()], pattern="*.txt")
    return d.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), "extraction_method").agg(F.sum(F.length("text")).cast("long").alias("n_characters"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 1")
def s9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = S.scratch(spark, "stream")
    d = _docs(spark, sf_dir).select("doc_id", "text", "n_chars")
    for half in (0, 1):
        d.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        I.ingest(I.new_files(spark, f"{root}/in", d.schema), lambda b: b.select("doc_id", "n_chars"), f"{root}/out", f"{root}/at").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("doc_id", "n_chars")


@query(f"WITH {_SLIDING} SELECT doc_id, chunk_index, md5(text) AS digest FROM c")
def s10_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "chunks")
    S.save_chunks(C.sliding(_docs(spark, sf_dir)), path)
    return S.load_chunks(spark, path).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query("SELECT 'backup' AS version, lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'now', lang, count(*) FROM documents WHERE doc_id % 2 = 0 GROUP BY lang")
def s17_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by some of its own rows, and its backup."""
    path = S.scratch(spark, "dataset")
    S.replace(_docs(spark, sf_dir).select("doc_id", "lang"), path)
    backup = S.replace(spark.read.parquet(path).where("doc_id % 2 = 0"), path)
    count = lambda at, name: spark.read.parquet(at).groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(name).alias("version"), "lang", "n")
    return count(backup, "backup").unionByName(count(path, "now"))


@query("SELECT 'before' AS stage, 0::BIGINT AS n UNION ALL SELECT 'created', count(*) FROM labels UNION ALL SELECT 'kept', count(*) FROM labels UNION ALL SELECT 'appended', 2 * count(*) FROM labels UNION ALL SELECT 'dropped', 0")
def s13_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, lab = S.Store(spark, S.scratch(spark, "store")), table(spark, sf_dir, "labels")
    rows = [("before", store.count("labels"))]
    store.create("labels", lab)
    rows.append(("created", store.count("labels")))
    store.create("labels", lab)
    rows.append(("kept", store.count("labels")))
    store.append("labels", lab)
    rows.append(("appended", store.count("labels")))
    store.drop("labels")
    rows.append(("dropped", store.count("labels")))
    return spark.createDataFrame(rows, "stage string, n long")


@query("SELECT doc_id, 'private' AS corpus_type, 'de' AS user_id FROM documents WHERE lang = 'de'")
def s14_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "private")
    for user in ("de", "fr"):
        S.append_private(_docs(spark, sf_dir).where(F.col("lang") == user).select("doc_id", "text"), path, user)
    return S.read_private(spark, path, "de").select("doc_id", "corpus_type", "user_id")


@query(f"WITH {GRAPH} SELECT 'nodes' AS kind, count(*) AS n FROM no UNION ALL SELECT 'edges', count(*) FROM ed")
def s15_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "graph")
    S.save_graph(*graph(spark, sf_dir), path)
    meta = S.load_graph(spark, path)[2]
    return meta.select(F.explode(F.map_from_arrays(F.array(F.lit("nodes"), F.lit("edges")), F.array("n_nodes", "n_edges"))).alias("kind", "n"))

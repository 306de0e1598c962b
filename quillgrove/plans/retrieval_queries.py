"""Queries of vector, keyword and hybrid retrieval.

Vectors are queries for each other; benchmark items are the text queries, and item and vector of one
number belong together, as do document and vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import lexicon as L
from quillgrove.functions import score as S
from quillgrove.functions import text as T
from quillgrove.functions import vector as V
from quillgrove.operators import retrieval as R
from quillgrove.plans.text_queries import _BUCKET_SQL, CHUNK_TYPE_SQL, FIXTURE_TYPES, RELEVANCE_SQL, WEIGHTED_SQL, words_sql
from quillgrove.registry import query, table
from quillgrove.sources.files import written


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _q(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _i(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


def vector_ranks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest other vectors of every vector."""
    e = _vectors(spark, sf_dir)
    return R.similar(_q(e), _i(e), k, but_self=True)


def item_vector_ranks(spark: SparkSession, sf_dir: str, k: int | None) -> DataFrame:
    """The k nearest documents of every benchmark item, by their vectors."""
    e = _vectors(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return R.similar(_q(e.join(b, "vec_id")), _i(e.join(d, "vec_id")), k)


def item_bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), k)


COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def ranks_sql(k: int) -> str:
    """CTE vr(query_id, item_id, sim, rank) of vector_ranks."""
    return f"""vs AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
vr AS (SELECT query_id, item_id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= {k})"""


def item_sql(k: int | None) -> str:
    """CTE ir(query_id, item_id, sim, rank) of item_vector_ranks."""
    return f"""isim AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COS} AS sim FROM embeddings a JOIN benchmark q ON q.item_id = a.vec_id, embeddings b JOIN documents d ON d.doc_id = b.vec_id),
ir AS (SELECT query_id, item_id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS INTEGER) AS rank FROM isim {f"QUALIFY rank <= {k}" if k else ""})"""


TERMS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda t: t <> '')"


def bm25_sql(k: int, queries: str = "SELECT item_id AS query_id, text FROM benchmark", items: str = "SELECT doc_id AS item_id, text FROM documents") -> str:
    """CTE br(query_id, item_id, score, rank) of item_bm25, or of other queries (query_id, text) and items (item_id, text)."""
    return f"""bq AS (SELECT query_id, unnest(list_distinct({TERMS_SQL})) AS term FROM ({queries})),
bd AS (SELECT item_id, {TERMS_SQL} AS t FROM ({items})), bs AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM bd),
bt AS (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM bd), tf AS (SELECT term, item_id, dl, count(*) AS tf FROM bt WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bw AS (SELECT bq.query_id, tf.item_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM bq JOIN tf USING (term) JOIN df USING (term), bs GROUP BY ALL),
br AS (SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM bw QUALIFY rank <= {k})"""


@query(f"""WITH t AS (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents), d AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM d""")
def v1_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hashed_terms(table(spark, sf_dir, "documents"))


@query("""WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(e[i] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS value FROM d, unnest(range(1, 65)) AS t(i)""")
def v2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.normalized(F.col("embedding"))).alias("dim", "value"))
    return d.withColumn("value", F.round("value", 6))


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COS} AS sim FROM embeddings a, embeddings b")
def v3_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return R.similar(_q(e), _i(e))


@query(f"WITH {ranks_sql(10)} SELECT * FROM vr")
def v4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_ranks(spark, sf_dir, 10)


@query(f"WITH {item_sql(5)} SELECT query_id, item_id, rank, round(1 - sim, 6) AS distance, sim AS similarity FROM ir")
def v5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_vector_ranks(spark, sf_dir, 5).select("query_id", "item_id", "rank", F.round(1 - F.col("sim"), 6).alias("distance"), F.col("sim").alias("similarity"))


@query(f"WITH {bm25_sql(10)} SELECT * FROM br")
def v6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_bm25(spark, sf_dir, 10)


def fuse_sql(alphas: str, k: int) -> str:
    return f"""{item_sql(50)}, {bm25_sql(50)},
nv AS (SELECT query_id, item_id, CASE WHEN max(sim) OVER w = min(sim) OVER w THEN 1.0::DOUBLE ELSE (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) END AS v FROM ir WINDOW w AS (PARTITION BY query_id)),
nb AS (SELECT query_id, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS b FROM br WINDOW w AS (PARTITION BY query_id)),
fu AS (SELECT query_id, item_id, alpha, v, b FROM nv FULL JOIN nb USING (query_id, item_id), (SELECT unnest({alphas}::DOUBLE[]) AS alpha)),
fs AS (SELECT query_id, item_id, alpha, round(alpha * coalesce(v, 0) + (1 - alpha) * coalesce(b, 0), 4) AS score FROM fu WHERE (alpha > 0 OR b IS NOT NULL) AND (alpha < 1 OR v IS NOT NULL)),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, alpha ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM fs QUALIFY rank <= {k})"""


def hybrid(spark: SparkSession, sf_dir: str, alphas: list[float], k: int) -> DataFrame:
    return R.fuse(item_vector_ranks(spark, sf_dir, 50).drop("rank"), item_bm25(spark, sf_dir, 50).drop("rank"), alphas, k)


@query(f"WITH {fuse_sql('[0.25]', 10)} SELECT * FROM fr")
def v7_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, [0.25], 10)


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), S.capped_relevance(F.col("text"), L.HUB + ("hand", "aim")).alias("relevance"), S.weighted(F.col("text"), L.WEIGHTED).alias("weight"))


_REL_SQL = f"re AS (SELECT doc_id AS item_id, {RELEVANCE_SQL} AS relevance, {WEIGHTED_SQL} AS weight FROM (SELECT *, lower(text) AS t FROM documents))"


@query(f"""WITH {item_sql(None)}, {_REL_SQL}, s AS (SELECT query_id, item_id, round(CASE WHEN relevance > 0.5 THEN sim * 1.5::DOUBLE ELSE sim END, 6) AS score FROM ir JOIN re USING (item_id))
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def v8_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = item_vector_ranks(spark, sf_dir, None).join(_relevance(spark, sf_dir), "item_id")
    return R.boosted(s, F.col("relevance") > 0.5, F.lit(1.5), 5).select("query_id", "item_id", "score", F.col("new_rank").alias("rank"))


@query(f"""WITH {item_sql(20)}, {_REL_SQL}, s AS (SELECT query_id, item_id, rank, round(CASE WHEN weight > 0.1 THEN sim * (1 + 0.5::DOUBLE * weight) ELSE sim END, 6) AS score FROM ir JOIN re USING (item_id))
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS new_rank FROM s QUALIFY new_rank <= 10""")
def v9_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = item_vector_ranks(spark, sf_dir, 20).join(_relevance(spark, sf_dir), "item_id")
    return R.boosted(s, F.col("weight") > 0.1, 1 + 0.5 * F.col("weight"), 10).select("query_id", "item_id", "rank", "score", "new_rank")


@query(f"""WITH RECURSIVE {item_sql(50)}, {_REL_SQL}, c AS (SELECT query_id, item_id, sim * CASE WHEN relevance > 0.5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS rel, CAST(embedding AS DOUBLE[]) AS e FROM ir JOIN re USING (item_id) JOIN embeddings ON vec_id = item_id),
m AS (SELECT query_id, 1 AS pick, list(item_id ORDER BY round(0.7::DOUBLE * rel, 9) DESC, item_id)[1:1] AS ids FROM c GROUP BY query_id
  UNION ALL SELECT m.query_id, any_value(m.pick) + 1, list_append(any_value(m.ids), list(x.item_id ORDER BY x.score DESC, x.item_id)[1]) FROM m JOIN (
    SELECT m.query_id, a.item_id, round(0.7::DOUBLE * any_value(a.rel) - 0.3::DOUBLE * max(list_cosine_similarity(a.e, b.e)), 9) AS score FROM m JOIN c a ON a.query_id = m.query_id AND NOT list_contains(m.ids, a.item_id) JOIN c b ON b.query_id = m.query_id AND list_contains(m.ids, b.item_id) GROUP BY m.query_id, a.item_id) x ON x.query_id = m.query_id
  WHERE m.pick < 5 GROUP BY m.query_id)
SELECT query_id, ids[pick] AS item_id, CAST(pick AS INTEGER) AS pick FROM m""")
def v10_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = item_vector_ranks(spark, sf_dir, 50).join(_relevance(spark, sf_dir), "item_id").join(_i(_vectors(spark, sf_dir)), "item_id")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return R.mmr(q, c.select("query_id", "item_id", "sim", "v", (F.col("relevance") > 0.5).alias("focused")), 5)


KEYWORDS = ("the", "and", "hand", "of the")


def _worded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items (query_id, qv, terms) and documents (item_id, v, terms, n_keywords) that have vectors; terms are hashes of their different words."""
    e = _vectors(spark, sf_dir)
    words = F.array_distinct(T.words(F.lower("text")))
    hashed = F.transform("w", lambda x: F.xxhash64(x)).alias("terms")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), words.alias("w")).join(e, "vec_id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), words.alias("w")).join(e, "vec_id")
    keywords = F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in KEYWORDS]))).alias("n_keywords")
    return b.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), hashed), d.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), hashed, keywords)


@query(f"""WITH {item_sql(None)}, b AS (SELECT item_id AS query_id, list_distinct({words_sql("lower(text)")}) AS q FROM benchmark), d AS (SELECT doc_id AS item_id, list_distinct({words_sql("lower(text)")}) AS w FROM documents),
s AS (SELECT query_id, item_id, round(0.7::DOUBLE * sim + 0.3::DOUBLE * ((len(list_intersect(q, w)) + 2 * len(list_intersect(['the', 'and', 'hand', 'of the'], w))) / greatest(len(q) + 8, 1)), 6) AS score FROM ir JOIN b USING (query_id) JOIN d USING (item_id))
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def v11_keyword_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = _worded(spark, sf_dir)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        most = np.maximum([len(t) + 2 * len(KEYWORDS) for t in x["terms"]], 1)
        shared = R.overlaps(x, y) + 2 * y["n_keywords"].to_numpy()[None, :]
        score = np.round(0.7 * R.cosines(x, y) + 0.3 * (shared / most[:, None]), 6)
        q, i = R._best(score, 5)
        return pd.DataFrame({"query_id": x["query_id"].to_numpy()[q], "item_id": y["item_id"].to_numpy()[i], "score": score[q, i]})

    return R.top_k(R.in_blocks(b, d, compare, "query_id long, item_id long, score double", R.QUERIES, R.ITEMS), 5)


@query(f"""WITH {bm25_sql(5)}, b AS (SELECT item_id AS query_id, list_distinct({words_sql("lower(text)")}) AS q FROM benchmark), d AS (SELECT doc_id AS item_id, list_distinct({words_sql("lower(text)")}) AS w FROM documents),
x AS (SELECT query_id AS item_id, item_id AS doc_id, list_sort(list_intersect(q, w)) AS s FROM br JOIN b USING (query_id) JOIN d USING (item_id))
SELECT item_id, doc_id, CASE WHEN len(s) > 3 THEN 'Shared terms: ' || array_to_string(s[1:5], ', ') ELSE 'Semantic similarity to requirement' END AS explanation FROM x""")
def l18_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of an item's five best documents was found."""
    words = F.array_distinct(T.words(F.lower("text")))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("q"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), words.alias("w"))
    both = item_bm25(spark, sf_dir, 5).select("query_id", "item_id").join(b, "query_id").join(d, "item_id").select("query_id", "item_id", F.array_sort(F.array_intersect("q", "w")).alias("s"))
    text = F.when(F.size("s") > 3, F.concat(F.lit("Shared terms: "), F.array_join(F.slice("s", 1, 5), ", "))).otherwise("Semantic similarity to requirement")
    return both.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"), text.alias("explanation"))


@query(f"WITH {fuse_sql('[0, 0.25, 0.5, 1]', 5)} SELECT * FROM fr")
def v12_alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, [0.0, 0.25, 0.5, 1.0], 5)


@query(f"""WITH {ranks_sql(1000000)}, c AS (SELECT vec_id AS item_id, CASE WHEN label < 5 THEN 'public' ELSE 'private' END AS corpus_type FROM embeddings)
SELECT query_id, item_id, corpus_type, sim, CAST(row_number() OVER (PARTITION BY query_id, corpus_type ORDER BY sim DESC, item_id) AS INTEGER) AS rank FROM vs JOIN c USING (item_id) QUALIFY rank <= 3""")
def v13_two_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    out = None
    for name, cond in (("public", "label < 5"), ("private", "label >= 5")):
        part = R.similar(_q(e), _i(e.where(cond)), 3, but_self=True).withColumn("corpus_type", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {bm25_sql(5)}, k AS (SELECT doc_id AS item_id, {_BUCKET_SQL} AS bucket FROM (SELECT *, {CHUNK_TYPE_SQL} AS kind FROM (SELECT *, lower(text) AS t FROM documents)))
SELECT query_id, bucket, count(*) AS n_matches, array_to_string(list(item_id ORDER BY rank) FILTER (WHERE rank <= 3), ',') AS best FROM br JOIN k USING (item_id) GROUP BY ALL""")
def v14_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", S.ladder(F.col("text"), FIXTURE_TYPES, "general").alias("kind"))
    d = d.select("item_id", S.bucket(F.col("kind"), F.col("text")).alias("bucket"))
    g = item_bm25(spark, sf_dir, 5).join(d, "item_id").groupBy("query_id", "bucket").agg(F.count("*").alias("n_matches"), F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "item_id")))).alias("b"))
    best = F.array_join(F.transform("b", lambda x: x["item_id"].cast("string")), ",")
    return g.select("query_id", "bucket", "n_matches", F.when(F.size("b") > 0, best).alias("best"))


@query(f"""WITH p AS (SELECT a.label AS la, b.label AS lb, {COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id),
s AS (SELECT avg(sim) FILTER (WHERE la = lb) AS intra, avg(sim) FILTER (WHERE la <> lb) AS inter FROM p)
SELECT round(coalesce(intra, 0.5), 5) AS intra, round(coalesce(inter, 0.5), 5) AS inter, round((coalesce(intra, 0.5) - coalesce(inter, 0.5)) * 0.5 + 0.5, 5) AS discrimination FROM s""")
def v15_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosines within and between labels, from the sums of the labels' vectors."""
    m = R.mean_vectors(_vectors(spark, sf_dir).select("label", F.col("embedding").alias("v")).where("v is not null"), ["label"])
    # a row a label: pairs of one label, and all pairs, each once
    own = R.dot(F.col("total"), F.col("total"))
    every = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), F.max(F.size("total"))), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    s = m.agg(((F.sum(own) - F.sum("n_some")) / 2).alias("si"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("ni"), every.alias("t"), F.sum("n").alias("n"), F.sum("n_some").alias("some"))
    s = s.select("si", "ni", ((R.dot(F.col("t"), F.col("t")) - F.col("some")) / 2).alias("sa"), (F.col("n") * (F.col("n") - 1) / 2).alias("na"))
    mean = lambda x, n: F.when(n > 0, x / n).otherwise(0.5)
    s = s.select(mean(F.col("si"), F.col("ni")).alias("intra"), mean(F.col("sa") - F.col("si"), F.col("na") - F.col("ni")).alias("inter"))
    return s.select(F.round("intra", 5).alias("intra"), F.round("inter", 5).alias("inter"), F.round((F.col("intra") - F.col("inter")) * 0.5 + 0.5, 5).alias("discrimination"))


@query(f"""WITH {item_sql(None)}, b AS (SELECT item_id AS query_id, list_distinct({words_sql("lower(text)")}) AS q FROM benchmark), d AS (SELECT doc_id AS item_id, list_distinct({words_sql("lower(text)")}) AS w FROM documents),
r AS (SELECT coalesce(avg(sim) FILTER (WHERE len(list_intersect(q, w)) > 2), 0) AS relevance, avg(sim) FILTER (WHERE rank <= 5) AS top FROM ir JOIN b USING (query_id) JOIN d USING (item_id)),
qq AS (SELECT sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE {COS} END) / count(*) AS qsim FROM embeddings a JOIN benchmark x ON x.item_id = a.vec_id, embeddings b JOIN benchmark y ON y.item_id = b.vec_id),
aa AS (SELECT sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE {COS} END) / count(*) AS asim FROM embeddings a JOIN documents x ON x.doc_id = a.vec_id, embeddings b JOIN documents y ON y.doc_id = b.vec_id)
SELECT round(relevance, 5) AS relevance, round(top, 5) AS top, round(qsim, 5) AS qsim, round(asim, 5) AS asim, round(0.4 * relevance + 0.3 * top + 0.2 * (1 - qsim) + 0.1 * asim, 5) AS score FROM r, qq, aa""")
def v16_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block gives its sum over pairs that share words, and its five best of each query; means over all pairs come from the sums of the vectors."""
    b, d = _worded(spark, sf_dir)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        s = R.cosines(x, y)
        shared = R.overlaps(x, y) > 2
        q, i = R._best(s, 5)
        best = pd.DataFrame({"query_id": x["query_id"].to_numpy()[q], "item_id": y["item_id"].to_numpy()[i], "sim": s[q, i], "n": 0})
        return pd.concat([best, pd.DataFrame({"query_id": [-1], "item_id": [-1], "sim": [s[shared].sum()], "n": [int(shared.sum())]})])

    found = written(R.in_blocks(b, d, compare, "query_id long, item_id long, sim double, n long", R.QUERIES, R.ITEMS), "scores")
    r = found.where("item_id = -1").agg(F.coalesce(F.sum("sim") / F.sum("n"), F.lit(0.0)).alias("relevance"))
    r = r.crossJoin(R.top_k(found.where("item_id <> -1"), 5, "sim").agg(F.avg("sim").alias("top")))

    def mean(rows: DataFrame, name: str) -> DataFrame:
        return R.mean_vectors(rows).select(((R.dot(F.col("total"), F.col("total")) - F.col("n_some")) / (F.col("n") * F.col("n"))).alias(name))

    m = r.crossJoin(mean(b.select(F.col("qv").alias("v")), "qsim")).crossJoin(mean(d.select("v"), "asim"))
    score = 0.4 * F.col("relevance") + 0.3 * F.col("top") + 0.2 * (1 - F.col("qsim")) + 0.1 * F.col("asim")
    return m.select(*[F.round(c, 5).alias(c) for c in ("relevance", "top", "qsim", "asim")], F.round(score, 5).alias("score"))


@query(f"""WITH {item_sql(None)}, b AS (SELECT item_id AS query_id FROM benchmark WHERE {L.any_sql(L.HUB, "lower(text)")}), d AS (SELECT doc_id AS item_id FROM documents WHERE {L.any_sql(L.HUB, "lower(text)")})
SELECT round(coalesce(avg(sim), 0), 5) AS mean_sim, count(*) AS n FROM ir SEMI JOIN b USING (query_id) SEMI JOIN d USING (item_id)""")
def v17_lexicon_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are filtered first; the mean over their pairs is the product of their sums."""
    e = _vectors(spark, sf_dir)

    def side(name: str, key: str, as_: str) -> DataFrame:
        ids = table(spark, sf_dir, name).where(L.any_of(L.lowered(F.col("text")), L.HUB)).select(F.col(key).alias("vec_id"))
        return R.mean_vectors(e.join(ids, "vec_id", "left_semi").select(F.col("embedding").alias("v")).where("v is not null")).select(F.col("total").alias(f"t{as_}"), F.col("n").alias(f"n{as_}"))

    s = side("benchmark", "item_id", "a").crossJoin(side("documents", "doc_id", "b")).withColumn("n", F.col("na") * F.col("nb"))
    mean = F.when(F.col("n") > 0, R.dot(F.col("ta"), F.col("tb")) / F.col("n")).otherwise(0.0)
    return s.select(F.round(F.coalesce(mean, F.lit(0.0)), 5).alias("mean_sim"), "n")

"""The reference's entry points as batches: every query of a table goes through the plan at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import lexicon as L
from quillgrove.functions import score as S
from quillgrove.functions import text as T
from quillgrove.operators import chunk as C
from quillgrove.operators import dataset as D
from quillgrove.operators import graph as G
from quillgrove.operators import metrics as M
from quillgrove.operators import retrieval as R
from quillgrove.plans.chunk_queries import _PARAS, overlap_sql, packed_sql
from quillgrove.plans.dataset_queries import PARTS, TRUTH, _topical
from quillgrove.plans.graph_queries import CONCEPTS, CORPUS, HUBS, LEXICONS, WANTED_SQL, corpus, wanted
from quillgrove.plans.retrieval_queries import bm25_sql, fuse_sql, hybrid, item_bm25
from quillgrove.plans.text_queries import _BUCKET_SQL, ASKING_SQL, CHUNK_TYPE_SQL, FIXTURE_TYPES, SECTION_SQL, WEIGHTED_SQL, _labelled, asking, clean_page_sql, requirements_sql, words_sql
from quillgrove.registry import query, table
from quillgrove.sources.files import written


def search_and_expand(results: DataFrame, concept_edges: DataFrame, documents: DataFrame, k: int = 10, seeds: int = 3, focused: DataFrame | None = None) -> DataFrame:
    """Ranked results (query_id, item_id, score, rank) with the documents that share concepts with the first of them.

    Results come first; a document counts where it comes first. Only ``focused`` (item_id) ones stay
    if given; what is left is filled in from the documents (item_id, institution).
    """
    results = written(results, "results")
    s = results.where(F.col("rank") <= seeds).select("query_id", F.concat(F.lit("DOC_"), "item_id").alias("seed"), "rank")
    more = G.two_hop(concept_edges, s).select("query_id", F.substring_index("id", "_", -1).cast("long").alias("item_id"), "score", "rank")
    both = D.keep_first([results.select("query_id", "item_id", "score", "rank"), more], ["query_id", "item_id"], "rank")
    if focused is not None:
        both = both.join(focused.select("item_id"), "item_id", "left_semi")
    ranked = F.row_number().over(G.Window.partitionBy("query_id").orderBy("list_ord", "rank"))
    both = both.withColumn("place", ranked).where(F.col("place") <= k)
    return both.join(documents, "item_id", "left").select("query_id", "item_id", "score", F.when(F.col("list_ord") == 0, "hybrid").otherwise("graph").alias("source"), "place", "institution")


@query(f"""WITH {fuse_sql('[0.25]', 10)}, {CORPUS}, ce AS ({CONCEPTS}), hu AS ({HUBS}),
sd AS (SELECT query_id, 'DOC_' || item_id AS seed, rank FROM fr WHERE rank <= 3), pa AS (SELECT query_id, dst AS hub, max(weight) AS weight, min(rank) AS seed_rank FROM sd JOIN ce ON ce.src = seed GROUP BY ALL),
fo AS (SELECT query_id, ce.src AS id, pa.weight FROM pa JOIN ce ON ce.dst = hub WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = pa.query_id AND sd.seed = ce.src)),
ex AS (SELECT query_id, id, round(max(weight) * 0.8::DOUBLE, 3) AS score FROM fo GROUP BY ALL), er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ex QUALIFY rank <= 5),
b AS (SELECT query_id, item_id, score, rank, 0 AS lo FROM fr UNION ALL SELECT query_id, CAST(substr(id, 5) AS BIGINT), score, rank, 1 FROM er),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY lo, rank) = 1), f AS (SELECT * FROM k WHERE 'DOC_' || item_id IN (SELECT src FROM hu)),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lo, rank) AS INTEGER) AS place FROM f QUALIFY place <= 10)
SELECT query_id, item_id, score, CASE lo WHEN 0 THEN 'hybrid' ELSE 'graph' END AS source, place, d.source AS institution FROM p LEFT JOIN documents d ON d.doc_id = item_id""")
def e1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    focused = G.hub_edges(c, L.HUB).select(F.substring_index("src", "_", -1).cast("long").alias("item_id"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("institution"))
    return search_and_expand(hybrid(spark, sf_dir, [0.25], 10).drop("alpha"), G.concept_edges(c, LEXICONS), d, focused=focused)


@query(f"""WITH {CORPUS}, ce AS ({CONCEPTS}), w AS ({WANTED_SQL}), m AS (SELECT query_id, CAST(substr(src, 5) AS BIGINT) AS item_id, round(sum(w.weight), 2) AS score FROM w JOIN ce ON ce.dst = concept GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM m QUALIFY rank <= 10), {bm25_sql(10)},
b AS (SELECT query_id, item_id, score, rank, 0 AS lo FROM mr UNION ALL SELECT query_id, item_id, score, rank, 1 FROM br), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY lo, rank) = 1)
SELECT query_id, item_id, score, CASE lo WHEN 0 THEN 'graph' ELSE 'keyword' END AS source FROM k""")
def e1_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept matches first, then keyword results."""
    m = G.match(G.concept_edges(corpus(spark, sf_dir), LEXICONS), wanted(spark, sf_dir))
    m = R.top_k(m.select("query_id", F.substring_index("id", "_", -1).cast("long").alias("item_id"), "score"), 10)
    k = D.keep_first([m, item_bm25(spark, sf_dir, 10)], ["query_id", "item_id"], "rank")
    return k.select("query_id", "item_id", "score", F.when(F.col("list_ord") == 0, "graph").otherwise("keyword").alias("source"))


_ASKED = f"SELECT item_id * {PARTS} + i - 1 AS query_id, r[i] AS text FROM (SELECT item_id, {requirements_sql('text')} AS r FROM {ASKING_SQL}), unnest(range(1, len(r) + 1)) AS t(i)"


@query(f"""{packed_sql(250, _PARAS)}, ch AS (SELECT doc_id * {PARTS} + chunk_index AS item_id, text FROM a), kc AS (SELECT *, {CHUNK_TYPE_SQL} AS kind FROM (SELECT *, lower(text) AS t FROM ch)), {bm25_sql(5, _ASKED, "SELECT * FROM ch")},
x AS (SELECT query_id, {_BUCKET_SQL} AS bucket, {SECTION_SQL} AS section FROM br JOIN kc USING (item_id))
SELECT query_id, bucket, count(*) AS n_matches, coalesce(string_agg(DISTINCT section, ', ' ORDER BY section), '') AS sections FROM x GROUP BY ALL""")
def e2_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of every item against the chunks of all documents: best chunks, their parts of a proposal."""
    r = asking(spark, sf_dir).select("item_id", F.posexplode(T.requirements(F.col("text"))).alias("pos", "text")).select((F.col("item_id") * PARTS + F.col("pos")).alias("query_id"), "text")
    c = C.packed(table(spark, sf_dir, "documents"), 250, "\n").select((F.col("doc_id") * PARTS + F.col("chunk_index")).alias("item_id"), "text", S.ladder(F.col("text"), FIXTURE_TYPES, "general").alias("kind"))
    best = R.bm25(r, c.select("item_id", "text"), 5).join(c, "item_id")
    return best.groupBy("query_id", S.bucket(F.col("kind"), F.col("text")).alias("bucket")).agg(F.count("*").alias("n_matches"), F.array_join(F.sort_array(F.collect_set(S.suggested_section(F.col("kind"), F.col("text")))), ", ").alias("sections"))


@query(f"""WITH RECURSIVE cl AS (SELECT doc_id, {clean_page_sql('text')} AS text FROM documents), hq AS (SELECT doc_id, text, lower(text) AS t FROM cl WHERE length(text) >= 300), {overlap_sql('hq')}
SELECT o.doc_id, chunk_index, total_chunks, CAST(len({words_sql('o.text')}) AS BIGINT) AS n_words, CASE WHEN length(hq.text) >= 800 THEN 'high' ELSE 'medium' END AS quality, {_labelled([(k, L.any_sql(w)) for k, w in L.CONDITIONS.entries], 'general')} AS condition, round({WEIGHTED_SQL}, 3) AS score FROM o JOIN hq ON hq.doc_id = o.doc_id""")
def e4_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned, sectioned, tagged and chunked with overlap, those of high or medium quality."""
    d = table(spark, sf_dir, "documents").withColumn("text", T.clean_page(F.col("text")))
    d = d.withColumns({"quality": T.extraction_quality(F.col("text"), F.lit(1)), "condition": L.first_label(L.lowered(F.col("text")), L.CONDITIONS), "score": S.weighted(F.col("text"), L.WEIGHTED, 3)}).where(T.quality_rank(F.col("quality")) >= 2)
    c = C.overlapped(d).select("doc_id", "chunk_index", "total_chunks", "n_words")
    return c.join(d.select("doc_id", "quality", "condition", "score"), "doc_id")


@query(f"""WITH {fuse_sql('[0, 0.25, 1]', 10)}, {TRUTH}, tn AS (SELECT query_id, count(*) AS n FROM tr GROUP BY ALL), y AS (SELECT fr.query_id, alpha, rank, CAST(tr.item_id IS NOT NULL AS INTEGER) AS hit, coalesce(n, 0) AS n FROM fr LEFT JOIN tr ON tr.query_id = fr.query_id AND tr.item_id = fr.item_id LEFT JOIN tn ON tn.query_id = fr.query_id),
z AS (SELECT *, sum(hit) OVER (PARTITION BY query_id, alpha ORDER BY rank) AS c FROM y), a AS (SELECT query_id, alpha, CASE WHEN max(n) = 0 THEN 0 ELSE sum(CASE WHEN hit = 1 THEN c / rank ELSE 0 END) / max(n) END AS ap, coalesce(1 / min(rank) FILTER (WHERE hit = 1), 0) AS rr, sum(hit) FILTER (WHERE rank <= 5) / 5 AS p5 FROM z GROUP BY ALL)
SELECT CASE alpha WHEN 0 THEN 'keyword' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS system, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(p5), 6) AS precision_5 FROM a GROUP BY alpha""")
def e5_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three systems are one grid of alphas over the same two rankings."""
    p = M.per_query(M.hits_by_topics(hybrid(spark, sf_dir, [0.0, 0.25, 1.0], 10), *_topical(spark, sf_dir), ["alpha"]), (5,), ["alpha"])
    system = F.when(F.col("alpha") == 0, "keyword").when(F.col("alpha") == 1, "dense").otherwise("hybrid").alias("system")
    return p.groupBy("alpha").agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("ap", "map"), ("rr", "mrr"), ("precision_5", "precision_5"))]).select(system, "map", "mrr", "precision_5")



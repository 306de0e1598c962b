"""Queries of the document graph. A tenth of the corpus comes twice, as the reference's own does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import lexicon as L
from quillgrove.operators import graph as G
from quillgrove.plans.retrieval_queries import bm25_sql, item_bm25
from quillgrove.plans.text_queries import labels_sql
from quillgrove.registry import query, table
from quillgrove.sources.files import written

LEXICONS = {"COND": L.CONDITIONS, "INT": L.INTERVENTIONS, "POP": L.POPULATIONS}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, pos, text, institute, year), with a later version of every tenth; pos orders the versions of a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), "text", "lang", F.col("doc_id").alias("n"))
    again = d.where("doc_id % 10 = 0").withColumns({"pos": F.lit(1), "n": F.col("doc_id") + 1})
    institute = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("lang"))
    return d.unionByName(again).select("doc_id", "pos", "text", institute.alias("institute"), F.when(F.col("n") % 11 != 0, (2022 + F.col("n") % 3).cast("int")).alias("year"))


CORPUS = """co AS (SELECT doc_id, pos, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS institute, CASE WHEN n % 11 <> 0 THEN CAST(2022 + n % 3 AS INTEGER) END AS year
  FROM (SELECT doc_id, 0 AS pos, text, lang, doc_id AS n FROM documents UNION ALL SELECT doc_id, 1, text, lang, doc_id + 1 FROM documents WHERE doc_id % 10 = 0)),
la AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1)"""
_N = L.count_sql(L.HUB, "lower(text)")
NODES = f"""SELECT 'DOC_' || doc_id AS id, 'grant' AS type, coalesce(year, 2024) AS year, coalesce(institute, 'Unknown') AS institute, {_N} > 0 AS is_hub, least({_N} / 5.0::DOUBLE, 1.0::DOUBLE) AS hub_score FROM la"""
INST = "SELECT DISTINCT 'DOC_' || doc_id AS src, 'INST_' || institute AS dst, 'funded_by' AS type, 1.0::DOUBLE AS weight FROM co WHERE institute NOT IN ('', 'nan', 'Unknown')"
YEARS = """SELECT DISTINCT 'DOC_' || doc_id AS src, 'YEAR_' || coalesce(year, 2024) AS dst, 'published_in' AS type, 0.6::DOUBLE AS weight FROM co
UNION ALL SELECT 'YEAR_' || y, 'YEAR_' || z, 'consecutive_year', 0.3::DOUBLE FROM (SELECT y, lead(y) OVER (ORDER BY y) AS z FROM (SELECT DISTINCT coalesce(year, 2024) AS y FROM co)) WHERE z IS NOT NULL"""
CONCEPTS = " UNION ALL ".join(f"SELECT DISTINCT 'DOC_' || doc_id AS src, '{p}_' || unnest({labels_sql(LEXICONS[p])}) AS dst, '{t}' AS type, {w}::DOUBLE AS weight FROM (SELECT *, lower(text) AS t FROM co)" for p, _, t, w in G.CONCEPTS)
HUBS = f"SELECT * FROM (SELECT 'DOC_' || doc_id AS src, 'HUB' AS dst, 'is_fqhc' AS type, least({_N} / 5.0::DOUBLE, 1.0::DOUBLE) AS weight FROM la) WHERE weight > 0"
_ORD = "CASE condition " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(L.CONDITIONS.labels)) + " END"
SIMILAR = f"""SELECT 'DOC_' || a AS src, 'DOC_' || b AS dst, 'similar_study' AS type, 0.7::DOUBLE AS weight, arg_min(condition, ord) AS shared_condition FROM (
  SELECT least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b, x.condition, x.ord FROM sn x JOIN sn y ON x.condition = y.condition AND y.rn BETWEEN x.rn + 1 AND x.rn + 5) GROUP BY a, b"""
_SN = f"""sn AS (SELECT *, {_ORD} AS ord, row_number() OVER (PARTITION BY condition ORDER BY doc_id) AS rn FROM (SELECT doc_id, unnest({labels_sql(L.CONDITIONS)}) AS condition FROM (SELECT doc_id, lower(text) AS t FROM documents)))"""
GRAPH = f"""{CORPUS}, {_SN}, ce AS ({CONCEPTS}), si AS ({SIMILAR}), ed AS (SELECT *, NULL AS shared_condition FROM ({INST} UNION ALL {YEARS} UNION ALL SELECT * FROM ce UNION ALL {HUBS}) UNION ALL SELECT * FROM si),
ids AS (SELECT 'DOC_' || doc_id AS id FROM co UNION SELECT src FROM ed UNION SELECT dst FROM ed),
no AS (SELECT id, CASE split_part(id, '_', 1) WHEN 'DOC' THEN 'grant' WHEN 'INST' THEN 'institute' WHEN 'YEAR' THEN 'year' WHEN 'COND' THEN 'condition' WHEN 'INT' THEN 'intervention' WHEN 'POP' THEN 'population' ELSE 'hub' END AS type FROM ids),
bo AS (SELECT src, dst, type, weight FROM ed UNION ALL SELECT dst, src, type, weight FROM ed WHERE src <> dst)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the documents, built once and read back, as every query goes over them more than once."""
    c = corpus(spark, sf_dir)
    edges = G.institute_edges(c).unionByName(G.year_edges(c)).unionByName(G.concept_edges(c, LEXICONS)).unionByName(G.hub_edges(c, L.HUB))
    edges = edges.unionByName(G.similarity_edges(table(spark, sf_dir, "documents"), L.CONDITIONS), allowMissingColumns=True)
    edges = written(edges, "edges")
    return G.node_table(c, edges), edges


@query(f"WITH {CORPUS} {NODES}")
def g1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grant_nodes(corpus(spark, sf_dir), L.HUB)


@query(f"WITH {CORPUS} {INST}")
def g2_institutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.institute_edges(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} {YEARS}")
def g3_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.year_edges(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} {CONCEPTS}")
def g4_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.concept_edges(corpus(spark, sf_dir), LEXICONS)


@query(f"WITH {CORPUS} {HUBS}")
def g5_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hub_edges(corpus(spark, sf_dir), L.HUB)


@query(f"WITH {_SN} {SIMILAR}")
def g6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.similarity_edges(table(spark, sf_dir, "documents"), L.CONDITIONS)


@query(f"WITH {GRAPH} SELECT * FROM ed")
def g7_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1]


_WANTED = ["ea", "hand", "one", "nothing"]


@query(f"WITH {GRAPH} SELECT DISTINCT item, dst AS id FROM (SELECT unnest({_WANTED}) AS item) w JOIN no ON contains(lower(no.id), item) AND no.type IN ('condition', 'intervention', 'population') JOIN bo ON bo.src = no.id WHERE dst LIKE 'DOC\\_%' ESCAPE '\\'")
def g8_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return G.by_concept(nodes, edges, spark.createDataFrame([(w,) for w in _WANTED], "item string"))


@query(f"""WITH {GRAPH}, {bm25_sql(3)}, sd AS (SELECT query_id, 'DOC_' || item_id AS seed, rank FROM br),
pa AS (SELECT query_id, dst AS hub, max(weight) AS weight, min(rank) AS seed_rank FROM sd JOIN ce ON ce.src = seed GROUP BY ALL),
fo AS (SELECT query_id, ce.src AS id, hub, pa.weight, seed_rank FROM pa JOIN ce ON ce.dst = hub WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = pa.query_id AND sd.seed = ce.src)),
b AS (SELECT query_id, id, round(max(weight) * 0.8::DOUBLE, 3) AS score, first(hub ORDER BY weight DESC, seed_rank, hub) AS hub FROM fo GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM b QUALIFY rank <= 5""")
def g9_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = item_bm25(spark, sf_dir, 3).select("query_id", F.concat(F.lit("DOC_"), "item_id").alias("seed"), "rank")
    return G.two_hop(G.concept_edges(corpus(spark, sf_dir), LEXICONS), seeds)


_RELATED = """o AS (SELECT query_id, seed, dst AS id, max(weight) AS strength FROM sd JOIN bo ON bo.src = seed WHERE bo.src <> bo.dst GROUP BY ALL),
t AS (SELECT query_id, seed, bo.dst AS id, max(strength * weight) AS strength FROM o JOIN bo ON bo.src = o.id WHERE NOT starts_with(o.id, 'DOC_') AND bo.src <> bo.dst AND bo.dst <> seed GROUP BY ALL),
u AS (SELECT * FROM o UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = t.query_id AND o.seed = t.seed AND o.id = t.id)),
d AS (SELECT query_id, id, round(max(strength), 6) AS strength FROM u WHERE starts_with(id, 'DOC_') GROUP BY ALL)"""


@query(f"""WITH {GRAPH}, {bm25_sql(1)}, sd AS (SELECT query_id, 'DOC_' || item_id AS seed FROM br), {_RELATED}
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10""")
def g10_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = item_bm25(spark, sf_dir, 1).select("query_id", F.concat(F.lit("DOC_"), "item_id").alias("seed"))
    return G.related(graph(spark, sf_dir)[1], seeds)


_WEIGHT = {"COND": 1.5, "INT": 1.0, "POP": 1.0}
WANTED_SQL = " UNION ALL ".join(f"SELECT item_id AS query_id, '{p}_' || unnest({labels_sql(x)}) AS concept, {_WEIGHT[p]}::DOUBLE AS weight FROM (SELECT item_id, lower(text) AS t FROM benchmark)" for p, x in LEXICONS.items())


def _concept(prefix: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.concat(F.lit(prefix + "_"), v).alias("concept"), F.lit(_WEIGHT[prefix]).alias("weight"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that each benchmark item names, with their weights."""
    low = L.lowered(F.col("text"))
    found = F.flatten(F.array(*[F.transform(L.labels_of(low, x), _concept(p)) for p, x in LEXICONS.items()]))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(found).alias("w")).select("query_id", "w.*")


@query(f"WITH {CORPUS}, ce AS ({CONCEPTS}), hu AS ({HUBS}), w AS ({WANTED_SQL}) SELECT query_id, src AS id, round(sum(w.weight), 2) AS score FROM w JOIN ce ON ce.dst = concept WHERE src IN (SELECT src FROM hu) GROUP BY ALL")
def g11_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    edges = G.concept_edges(c, LEXICONS).unionByName(G.hub_edges(c, L.HUB))
    return G.match(edges, wanted(spark, sf_dir), hub_only=True)


@query(f"""WITH {GRAPH}, {bm25_sql(5)}, sd AS (SELECT query_id, 'DOC_' || item_id AS seed, rank FROM br),
x AS (SELECT query_id, seed AS id, rank AS ord, 0 AS lvl FROM sd UNION ALL SELECT query_id, dst, rank, 1 FROM sd JOIN bo ON bo.src = seed WHERE starts_with(dst, 'DOC_')
  UNION ALL SELECT query_id, c2.src, rank, 2 FROM sd JOIN ce c1 ON c1.src = seed JOIN ce c2 ON c2.dst = c1.dst),
f AS (SELECT query_id, id, min((lvl, ord)) AS o FROM x GROUP BY ALL)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 20""")
def g12_evaluation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graph(spark, sf_dir)
    sd = item_bm25(spark, sf_dir, 5).select("query_id", F.concat(F.lit("DOC_"), "item_id").alias("seed"), F.col("rank").alias("ord"))
    base = sd.select("query_id", F.col("seed").alias("id"), F.lit(0).alias("lvl"), "ord")
    near = sd.join(G.both_ways(edges), F.col("seed") == F.col("src")).where(F.col("dst").startswith("DOC_")).select("query_id", F.col("dst").alias("id"), F.lit(1).alias("lvl"), "ord")
    ce = edges.where(F.col("type").isin("treats", "uses", "targets"))
    hubs = sd.join(ce.select(F.col("src").alias("seed"), F.col("dst").alias("hub")), "seed").groupBy("query_id", "hub").agg(F.min("ord").alias("ord"))
    far = hubs.join(G.first_beside(ce.select(F.col("src").alias("doc"), F.col("dst").alias("hub")), 20).select("hub", F.col("doc").alias("id")), "hub").select("query_id", "id", F.lit(2).alias("lvl"), "ord")
    first = base.unionByName(near).unionByName(far).groupBy("query_id", "id").agg(F.min(F.struct("lvl", "ord")).alias("o"))
    w = F.row_number().over(G.Window.partitionBy("query_id").orderBy("o", "id"))
    return first.withColumn("rank", w).where("rank <= 20").select("query_id", "id", "rank")


_TOPIC_HUBS = {"heat": "COND_heat", "east": "COND_east", "hand": "INT_hand", "hero": "POP_hero"}


@query(f"WITH {CORPUS}, ce AS ({CONCEPTS}) SELECT DISTINCT topic, src AS id FROM (SELECT unnest({list(_TOPIC_HUBS)}) AS topic, unnest({list(_TOPIC_HUBS.values())}) AS hub) m JOIN ce ON ce.dst = hub")
def g13_topic_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame(list(_TOPIC_HUBS.items()), "topic string, dst string")
    return m.join(G.concept_edges(corpus(spark, sf_dir), LEXICONS), "dst").select("topic", F.col("src").alias("id")).distinct()


@query(f"WITH {GRAPH}, n AS (SELECT count(*) AS n FROM no), m AS (SELECT count(*) AS m FROM ed) SELECT 'graph' AS kind, 'density' AS name, round(2 * m / (n * (n - 1)), 6) AS value FROM n, m UNION ALL SELECT 'node', type, count(*)::DOUBLE FROM no GROUP BY type UNION ALL SELECT 'edge', type, count(*)::DOUBLE FROM ed GROUP BY type")
def g14_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.statistics(*graph(spark, sf_dir))


@query(f"WITH {_SN}, si AS ({SIMILAR}), d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM si UNION ALL SELECT dst FROM si) GROUP BY id), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents) SELECT id, round(d / (n - 1), 6) AS centrality FROM d, n ORDER BY centrality DESC, id LIMIT 10")
def g15_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return G.centrality(edges, nodes)


@query(f"""WITH {_SN}, si AS ({SIMILAR}), e AS (SELECT a.lang AS cs, b.lang AS cd, weight FROM si JOIN documents a ON si.src = 'DOC_' || a.doc_id JOIN documents b ON si.dst = 'DOC_' || b.doc_id),
g AS (SELECT c, sum(weight) AS deg FROM (SELECT cs AS c, weight FROM e UNION ALL SELECT cd, weight FROM e) GROUP BY c), i AS (SELECT cs AS c, sum(weight) FILTER (WHERE cs = cd) AS ins FROM e GROUP BY cs), m AS (SELECT sum(weight) AS m FROM e)
SELECT round(sum(coalesce(ins, 0) / m - (deg / (2 * m)) * (deg / (2 * m))), 6) AS modularity FROM g LEFT JOIN i USING (c), m""")
def g16_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return G.modularity(G.similarity_edges(d, L.CONDITIONS), d.select(F.concat(F.lit("DOC_"), "doc_id").alias("id"), F.col("lang").alias("community")))


@query()
def g16_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.louvain(G.concept_edges(corpus(spark, sf_dir), LEXICONS))


_COMBO = f"""co3 AS (SELECT c.dst AS condition, i.dst AS intervention, p.dst AS population, c.src AS id FROM ce c JOIN ce i ON i.src = c.src AND i.type = 'uses' JOIN ce p ON p.src = c.src AND p.type = 'targets' WHERE c.type = 'treats')"""


def combos(ce: DataFrame) -> DataFrame:
    """(condition, intervention, population, id) of every document that has all three."""
    side = lambda t, n: ce.where(F.col("type") == t).select(F.col("src").alias("id"), F.col("dst").alias(n))
    return side("treats", "condition").join(side("uses", "intervention"), "id").join(side("targets", "population"), "id")


@query(f"WITH {CORPUS}, ce AS ({CONCEPTS}), {_COMBO} SELECT condition, intervention, population, count(*) AS expected_count, array_to_string((list(id ORDER BY id))[1:5], ',') AS known FROM co3 GROUP BY ALL HAVING count(*) >= 2")
def g17_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = combos(G.concept_edges(corpus(spark, sf_dir), LEXICONS)).groupBy("condition", "intervention", "population").agg(F.count("*").alias("expected_count"), F.sort_array(F.collect_list("id")).alias("ids"))
    return c.where("expected_count >= 2").select("condition", "intervention", "population", "expected_count", F.array_join(F.slice("ids", 1, 5), ",").alias("known"))


@query(f"""WITH {CORPUS}, ce AS ({CONCEPTS}), {_COMBO}, k AS (SELECT condition, intervention, population, id, row_number() OVER (PARTITION BY condition, intervention, population ORDER BY id) AS r, count(*) OVER (PARTITION BY condition, intervention, population) AS n FROM co3),
q AS (SELECT DISTINCT condition, intervention, population FROM k WHERE n >= 2),
fo AS (SELECT q.*, ce.src AS id, sum(CASE ce.type WHEN 'treats' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM q JOIN ce ON ce.dst IN (condition, intervention, population) GROUP BY ALL HAVING score >= 2.5),
h AS (SELECT fo.condition, fo.intervention, fo.population, count(*) AS n_found, count(k.id) AS n_hit FROM fo LEFT JOIN k ON k.r <= 5 AND k.condition = fo.condition AND k.intervention = fo.intervention AND k.population = fo.population AND k.id = fo.id GROUP BY ALL),
t AS (SELECT condition, intervention, population, least(n, 5) AS n_true FROM k GROUP BY ALL)
SELECT condition, intervention, population, round(n_hit / n_found, 6) AS precision, round(n_hit / n_true, 6) AS recall, round(2 * n_hit / (n_found + n_true), 6) AS f1 FROM h JOIN t USING (condition, intervention, population)""")
def g18_combo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ce = written(G.concept_edges(corpus(spark, sf_dir), LEXICONS), "concepts")
    key = ["condition", "intervention", "population"]
    w = G.Window.partitionBy(*key)
    k = combos(ce).withColumns({"r": F.row_number().over(w.orderBy("id")), "n": F.count("*").over(w)}).where("n >= 2")
    q = k.select(*key).distinct().withColumn("dst", F.explode(F.array(*key)))
    found = q.join(ce.select("src", "dst", "type"), "dst").groupBy(*key, F.col("src").alias("id")).agg(F.sum(F.when(F.col("type") == "treats", 1.5).otherwise(1.0)).alias("score")).where("score >= 2.5")
    h = found.join(k.where("r <= 5").select(*key, "id", F.lit(1).alias("hit")), [*key, "id"], "left").groupBy(*key).agg(F.count("*").alias("n_found"), F.count("hit").alias("n_hit"))
    t = k.groupBy(*key).agg(F.least(F.max("n"), F.lit(5)).alias("n_true"))
    return h.join(t, key).select(*key, F.round(F.col("n_hit") / F.col("n_found"), 6).alias("precision"), F.round(F.col("n_hit") / F.col("n_true"), 6).alias("recall"), F.round(2 * F.col("n_hit") / (F.col("n_found") + F.col("n_true")), 6).alias("f1"))

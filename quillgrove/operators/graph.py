"""The typed, weighted graph of documents and concepts, as node and edge tables, and queries over it.

Edges are stored once; ``both_ways`` reads them in either direction. Concept edges are computed row
by row from lexicons, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import lexicon as L
from quillgrove.operators.dataset import numbered
from quillgrove.sources.files import written

CONCEPTS = (("COND", "condition", "treats", 1.2), ("INT", "intervention", "uses", 1.1), ("POP", "population", "targets", 1.1))


def keep_last(rows: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """One row a key, the last by order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def grant_nodes(corpus: DataFrame, hub: tuple[str, ...]) -> DataFrame:
    """A node for each document (doc_id, pos, text, year, institute), the last row of each id."""
    d = keep_last(corpus)
    n = L.count_of(L.lowered(F.col("text")), hub)
    return d.select(F.concat(F.lit("DOC_"), "doc_id").alias("id"), F.lit("grant").alias("type"), F.coalesce("year", F.lit(2024)).alias("year"), F.coalesce("institute", F.lit("Unknown")).alias("institute"), (n > 0).alias("is_hub"), F.least(n / 5.0, F.lit(1.0)).alias("hub_score"))


def _doc(column: str = "doc_id") -> Column:
    return F.concat(F.lit("DOC_"), column)


def institute_edges(corpus: DataFrame) -> DataFrame:
    good = F.col("institute").isNotNull() & ~F.col("institute").isin("", "nan", "Unknown")
    return corpus.where(good).select(_doc().alias("src"), F.concat(F.lit("INST_"), "institute").alias("dst"), F.lit("funded_by").alias("type"), F.lit(1.0).alias("weight")).distinct()


def year_edges(corpus: DataFrame) -> DataFrame:
    """Documents to years, and each year to the next one there is."""
    y = F.coalesce("year", F.lit(2024))
    one = corpus.select(_doc().alias("src"), F.concat(F.lit("YEAR_"), y).alias("dst"), F.lit("published_in").alias("type"), F.lit(0.6).alias("weight")).distinct()
    years = corpus.select(y.alias("year")).distinct()
    chain = years.withColumn("next", F.lead("year").over(Window.orderBy("year"))).where("next is not null")
    return one.unionByName(chain.select(F.concat(F.lit("YEAR_"), "year").alias("src"), F.concat(F.lit("YEAR_"), "next").alias("dst"), F.lit("consecutive_year").alias("type"), F.lit(0.3).alias("weight")))


def _edge(prefix: str, type_: str, weight: float) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.concat(F.lit(prefix + "_"), x).alias("dst"), F.lit(type_).alias("type"), F.lit(weight).alias("weight"))


def concept_edges(corpus: DataFrame, lexicons: dict[str, L.Lexicon]) -> DataFrame:
    """Documents to the concepts of each lexicon (COND, INT, POP) that they name."""
    found = L.once(L.lowered(F.col("text")), lambda low: F.flatten(F.array(*[F.transform(L.labels_of(low, lexicons[p]), _edge(p, t, w)) for p, _, t, w in CONCEPTS if p in lexicons])))
    return corpus.select(_doc().alias("src"), F.explode(found).alias("e")).select("src", "e.*").distinct()


def hub_edges(corpus: DataFrame, hub: tuple[str, ...]) -> DataFrame:
    # counted before the last row of an id is looked for, so that no text is shuffled
    n = L.once(L.lowered(F.col("text")), lambda low: L.count_of(low, hub))
    last = keep_last(corpus.select("doc_id", "pos", n.alias("n"))).where("n > 0")
    return last.select(_doc().alias("src"), F.lit("HUB").alias("dst"), F.lit("is_fqhc").alias("type"), F.least(F.col("n") / 5.0, F.lit(1.0)).alias("weight"))


def similarity_edges(corpus: DataFrame, lexicon: L.Lexicon, ahead: int = 5, weight: float = 0.7) -> DataFrame:
    """Each document to the next few of each condition, in order of id; the first condition of the lexicon owns a pair."""
    d = corpus.select("doc_id", F.posexplode(F.transform(F.array(*[F.when(L.any_of(L.lowered(F.col("text")), ws), F.lit(k)) for k, ws in lexicon.entries]), lambda x: x)).alias("ord", "condition")).where("condition is not null")
    n = written(numbered(d, "condition", "doc_id"), "numbered")
    a = n.select("condition", "ord", F.col("doc_id").alias("a"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + ahead)).alias("rn"))
    p = a.join(n.select("condition", "rn", F.col("doc_id").alias("b")), ["condition", "rn"])
    own = p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min_by("condition", "ord").alias("shared_condition"))
    return own.select(_doc("a").alias("src"), _doc("b").alias("dst"), F.lit("similar_study").alias("type"), F.lit(weight).alias("weight"), "shared_condition")


def assemble(corpus: DataFrame, lexicons: dict[str, L.Lexicon], hub: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (src, dst, type, weight, shared_condition) of the whole graph."""
    edges = institute_edges(corpus)
    for e in (year_edges(corpus), concept_edges(corpus, lexicons), hub_edges(corpus, hub)):
        edges = edges.unionByName(e)
    edges = edges.unionByName(similarity_edges(corpus, lexicons["COND"]), allowMissingColumns=True)
    return node_table(corpus, edges), edges


def node_type(id_: Column) -> Column:
    p = F.substring_index(id_, "_", 1)
    return F.when(p == "DOC", "grant").when(p == "INST", "institute").when(p == "YEAR", "year").when(p == "COND", "condition").when(p == "INT", "intervention").when(p == "POP", "population").otherwise("hub")


def node_table(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    ids = corpus.select(_doc().alias("id")).unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.withColumn("type", node_type(F.col("id")))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "type", "weight")
    return e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))


def by_concept(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, first_only: bool = False) -> DataFrame:
    """(item, id): documents beside the concept nodes of which a wanted item (item) is a part; of the first such node only, or of all."""
    hubs = nodes.where(F.col("type").isin("condition", "intervention", "population"))
    m = wanted.join(hubs, F.lower("id").contains(F.lower("item"))).select("item", F.col("id").alias("hub"))
    if first_only:
        m = m.groupBy("item").agg(F.min("hub").alias("hub"))
    return m.join(both_ways(edges).select(F.col("src").alias("hub"), F.col("dst").alias("id")), "hub").where(F.col("id").startswith("DOC_")).select("item", "id").distinct()


def first_beside(edges: DataFrame, n: int) -> DataFrame:
    """Concept edges (doc, hub) of the first n documents by id of each hub; more can't be among the first n of any ranking by hub and id."""
    first = F.row_number().over(Window.partitionBy("hub").orderBy("doc"))
    return edges.select("doc", "hub").distinct().withColumn("nth", first).where(F.col("nth") <= n).drop("nth")


def two_hop(edges: DataFrame, seeds: DataFrame, decay: float = 0.8, k: int = 5) -> DataFrame:
    """(query_id, id, score, hub, rank): documents that share a concept with a seed (query_id, seed, rank).

    A hub that every document has costs no more than a rare one.

    The score is the weight of the seed's edge times decay, the most over all paths; the hub is that
    of the best path of the best-ranked seed. Seeds are left out.
    """
    e = written(edges.where(F.col("type").isin("treats", "uses", "targets")).select(F.col("src").alias("doc"), F.col("dst").alias("hub"), "weight"), "concepts")
    seeds = written(seeds, "seeds")
    paths = seeds.join(e, F.col("seed") == F.col("doc")).select("query_id", F.col("rank").alias("seed_rank"), "hub", "weight")
    # seeds of a query share hubs: one path a hub is enough
    paths = paths.groupBy("query_id", "hub").agg(F.max("weight").alias("weight"), F.min("seed_rank").alias("seed_rank"))
    # all documents of a hub have the same score, so only the first by id can be among the k, behind the seeds at most
    most = seeds.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    found = paths.join(first_beside(e, k + most).select("hub", F.col("doc").alias("id")), "hub").join(seeds.select("query_id", F.col("seed").alias("id")), ["query_id", "id"], "left_anti")
    best = found.groupBy("query_id", "id").agg(F.round(F.max("weight") * decay, 3).alias("score"), F.min_by("hub", F.struct(-F.col("weight"), F.col("seed_rank"), F.col("hub"))).alias("hub"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def related(edges: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, strength, rank): documents one or two edges from a seed (query_id, seed), over any node; nearest first found, strength the greatest product of weights.

    Of the documents beside a node on the way only the first by weight and id are walked to: k of
    them, and as many more as any seed has neighbours, since these are found before. Products keep
    the order of the weights, so no other can be among a query's k; a node that every document has
    costs no more than a rare one. Weights are taken as different from a billionth on.
    """
    e = both_ways(edges).select("src", "dst", F.coalesce("weight", F.lit(0.5)).alias("w")).where("src <> dst")
    one = written(seeds.join(e, F.col("seed") == F.col("src")).groupBy("query_id", "seed", F.col("dst").alias("id")).agg(F.max("w").alias("strength")), "one")
    most = one.where(F.col("id").startswith("DOC_")).groupBy("query_id", "seed").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("w", 9)), "dst"))
    beside = e.where(~F.col("src").startswith("DOC_") & F.col("dst").startswith("DOC_")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    beside = beside.withColumn("nth", first).where(F.col("nth") <= k + most + 1).drop("nth")
    two = one.where(~F.col("id").startswith("DOC_")).join(beside, F.col("id") == F.col("src")).groupBy("query_id", "seed", F.col("dst").alias("id")).agg(F.max(F.col("strength") * F.col("w")).alias("strength"))
    two = two.where(F.col("id") != F.col("seed")).join(one.select("query_id", "seed", "id"), ["query_id", "seed", "id"], "left_anti")
    docs = one.unionByName(two).where(F.col("id").startswith("DOC_")).groupBy("query_id", "id").agg(F.round(F.max("strength"), 6).alias("strength"))
    w = Window.partitionBy("query_id").orderBy(F.desc("strength"), "id")
    return docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match(edges: DataFrame, wanted: DataFrame, hub_only: bool = False) -> DataFrame:
    """(query_id, id, score): weights of the concepts (query_id, concept, weight) that a document has, summed.

    The sums are made for each set of concepts that any document has; its documents then take them.
    """
    edges = edges.join(wanted.select(F.col("concept").alias("dst")).unionByName(wanted.sparkSession.range(1).select(F.lit("HUB").alias("dst"))).distinct(), "dst", "left_semi")
    # a row a document; a hub that all of them have is no group of its own
    docs = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("has"))
    if hub_only:
        docs = docs.where(F.array_contains("has", "HUB"))
    docs = written(docs, "concepts")
    sets = docs.select("has").distinct()
    score = sets.select("has", F.explode("has").alias("concept")).join(wanted, "concept").groupBy("query_id", "has").agg(F.round(F.sum("weight"), 2).alias("score"))
    return score.join(docs, "has").select("query_id", "id", "score")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, value): how many nodes and edges, by type, and the density."""
    n = nodes.agg(F.count("*").alias("n"))
    m = edges.agg(F.count("*").alias("m"))
    both = n.crossJoin(m)
    density = both.select(F.lit("graph").alias("kind"), F.lit("density").alias("name"), F.round(2 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 6).alias("value"))
    count = lambda d, kind: d.groupBy("type").agg(F.count("*").cast("double").alias("value")).select(F.lit(kind).alias("kind"), F.col("type").alias("name"), "value")
    return density.unionByName(count(nodes, "node")).unionByName(count(edges, "edge"))


def centrality(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(id, centrality): the k documents of most edges to documents, over those that there could be; a loop counts twice."""
    e = edges.where(F.col("src").startswith("DOC_") & F.col("dst").startswith("DOC_"))
    deg = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    n = nodes.where("type = 'grant'").agg(F.count("*").alias("n"))
    return deg.crossJoin(n).where("n > 2").select("id", F.round(F.col("d") / (F.col("n") - 1), 6).alias("centrality")).orderBy(F.desc("centrality"), "id").limit(k)


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row, the modularity of groups (id, community) under the edges' weights."""
    e = edges.join(groups.toDF("src", "cs"), "src").join(groups.toDF("dst", "cd"), "dst").select("cs", "cd", "weight")
    inside = e.groupBy(F.col("cs").alias("community")).agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"))
    deg = e.select(F.col("cs").alias("community"), "weight").unionByName(e.select(F.col("cd").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("degree"))
    m = e.agg(F.sum("weight").alias("m"))
    return deg.join(inside, "community", "left").crossJoin(m).agg(F.round(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - (F.col("degree") / (2 * F.col("m"))) * (F.col("degree") / (2 * F.col("m")))), 6).alias("modularity"))


def _contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between the groups (id, community), their weights summed; within one they are its loop."""
    e = edges.join(groups.toDF("src", "_s"), "src").join(groups.toDF("dst", "_d"), "dst")
    return e.groupBy(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")).agg(F.sum("weight").alias("weight"))


def label_moves(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community) by rounds of moves to the neighbouring community of the greatest gain in modularity.

    In each round half of the nodes, by a hash that differs from round to round, choose at once;
    a community goes by one of its nodes. A round is an aggregation of the edges by node and
    community; a node that all others touch is summed within the tasks first.
    """
    edges = written(edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
    both = edges.where("src <> dst").select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ends = both.select(F.col("src").alias("id"), "weight").unionByName(edges.where("src = dst").select(F.col("src").alias("id"), (2 * F.col("weight")).alias("weight")))
    state = written(ends.groupBy("id").agg(F.sum("weight").alias("deg")).withColumn("community", F.col("id")), "state")
    total = state.agg(F.sum("deg")).first()[0] or 0.0
    for turn in range(rounds if total else 0):
        size = state.groupBy(F.col("community").alias("to")).agg(F.sum("deg").alias("size"))
        to = both.join(state.select(F.col("id").alias("dst"), F.col("community").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("weight").alias("w"))
        stay = state.select("id", F.col("community").alias("to"), F.lit(0.0).alias("w"))
        options = to.unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w")).join(size, "to").join(state, "id")
        own = F.col("to") == F.col("community")
        gain = F.round(F.col("w") - (F.col("size") - F.when(own, F.col("deg")).otherwise(0.0)) * F.col("deg") / total, 12)
        best = options.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0).groupBy("id").agg(F.max_by("to", F.struct(gain, own, "to")).alias("to"))
        after = written(state.join(best, "id", "left").select("id", "deg", F.coalesce("to", "community").alias("community"), (F.coalesce("to", "community") != F.col("community")).alias("moved")), "state")
        moved = after.where("moved").limit(1).count()
        state = after.drop("moved")
        if not moved and turn:
            break
    return state.select("id", "community")


def louvain(edges: DataFrame, in_task: int = 2_000_000) -> DataFrame:
    """(id, community) by greedy modularity moves over the concept and document graph.

    A graph of more than ``in_task`` edges is first contracted by rounds of moves over all tasks, as
    often as it takes or as that makes it smaller; the rest, of bounded size, is one group in pandas.
    """
    levels = []
    while (n := edges.count()) > in_task:
        groups = label_moves(edges)
        less = written(_contracted(edges, groups), "contracted")
        if less.count() > 0.9 * n:
            raise ValueError(f"{n} edges, and no communities to contract them by")
        levels.append(groups)
        edges = less
    out = _in_one_task(edges)
    for groups in reversed(levels):
        # a community without edges to others and without a loop can't be: its nodes have edges
        out = groups.toDF("node", "id").join(out, "id").select(F.col("node").alias("id"), "community")
    return out


def _in_one_task(edges: DataFrame) -> DataFrame:

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([part["src"], part["dst"]]), return_inverse=True)
        a, b = codes[: len(part)], codes[len(part) :]
        group = _louvain(len(names), a, b, part["weight"].to_numpy())
        return pd.DataFrame({"id": names, "community": group.astype(np.int32)})

    return edges.select("src", "dst", "weight", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda p: run(p.sort_values(["src", "dst"], kind="stable")), "id string, community int")


def _louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    whole = np.arange(n)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loop = np.zeros(n)
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist()):
            if x == y:
                loop[x] += z
            else:
                near[x][y] = near[x].get(y, 0) + z
                near[y][x] = near[y].get(x, 0) + z
        deg = np.array([sum(d.values()) for d in near]) + 2 * loop
        total = deg.sum()
        group, size = np.arange(n), deg.copy()
        moved = total > 0
        changed = False
        while moved:
            moved = False
            for v in range(n):
                own = int(group[v])
                to: dict[int, float] = {own: 0.0}
                for u, z in near[v].items():
                    g = int(group[u])
                    to[g] = to.get(g, 0) + z
                size[own] -= deg[v]
                best = max(to, key=lambda g: (round(to[g] - size[g] * deg[v] / total, 12), g == own, -g))
                size[best] += deg[v]
                if best != own:
                    group[v], moved, changed = best, True, True
        names, group = np.unique(group, return_inverse=True)
        whole = group[whole]
        if not changed or len(names) == n:
            return whole
        a, b, n = group[a], group[b], len(names)


def density(n: int, m: int) -> float:
    return round(2 * m / (n * (n - 1)), 6) if n > 1 else math.nan

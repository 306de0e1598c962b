"""What SQL can't hold: brute force, known values and edge cases of the reference's operators."""

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillgrove import plans  # noqa: F401
from quillgrove.functions import lexicon as L
from quillgrove.functions import score as S
from quillgrove.functions import text as T
from quillgrove.functions.embed import Hashed, encoded
from quillgrove.operators import chunk as C
from quillgrove.operators import dataset as D
from quillgrove.operators import graph as G
from quillgrove.operators import metrics as M
from quillgrove.operators import retrieval as R
from quillgrove.plans.text_queries import key_terms
from quillgrove.registry import QUERIES
from quillgrove.sources import files as files_
from quillgrove.sources.projects import search_projects


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_clean_page_mends_hyphens(spark):
    t = "Some long line-\nended here\n12\nab\n\n\n\n\nPage 3 of 9 tail\fnext page"
    assert one(spark, T.clean_page(F.col("t")), t=t) == "Some long lineended here\n tail\n\nnext page"


def test_null_and_empty_texts(spark):
    d = texts(spark, None, "", "  ", "one. two three.")
    rows = d.select(T.word_count(F.col("text")).alias("n"), F.size(T.sentences(F.col("text"))).alias("s"), T.normalize(F.col("text")).alias("t")).collect()
    assert [r["n"] for r in rows] == [0, 0, 0, 3]
    assert [r["s"] for r in rows] == [0, 0, 0, 2]
    assert rows[0]["t"] == ""
    for f in (C.sliding, C.packed, C.overlapped, C.whole, lambda x: C.marker_topics(x, ["x"]), lambda x: C.topic_shift(x, ["x"]), lambda x: C.header_sections(x, {"a": "x"})):
        assert f(d).count() >= 0


def test_requirements(spark):
    t = "Applicants must show prior work. Applicants must report each year."
    assert one(spark, T.requirements(F.col("t")), t=t) == ["show prior work", "report each year"]
    plain = "Short one. This sentence has more than five words."
    assert one(spark, T.requirements(F.col("t")), t=plain) == ["This sentence has more than five words."]


def test_requirements_section(spark):
    t = "Intro. REQUIREMENTS: do this\nand that. DELIVERABLES: none"
    assert one(spark, T.requirements_section(F.col("t")), t=t) == "REQUIREMENTS: do this\nand that."
    assert one(spark, T.requirements_section(F.col("t")), t="nothing here") is None


def test_scores_of_known_texts(spark):
    t = "The study finds much in five rural clinics. It is done with care by nurses."
    assert one(spark, S.coherence(F.col("t")), t=t) == 0.6
    assert one(spark, S.coherence(F.col("t")), t="Only one sentence.") == 0.5
    assert abs(one(spark, S.completeness(F.col("t")), t=t) - 0.9) < 1e-9
    assert one(spark, S.weighted(F.col("t"), L.HEALTH_WEIGHTED, 3), t="An FQHC for the uninsured") == round(4.5 / 21, 3)
    assert one(spark, L.first_label(F.lower("t"), L.HEALTH_CONDITIONS), t="Asthma and cancer") == "asthma"
    assert one(spark, S.ladder(F.col("t"), S.STUDY_TYPES, "unspecified"), t="A pragmatic clinical trial") == "pragmatic_trial"


def test_offset_sections_by_brute_force(spark):
    t = "Intro words. METHODS: " + "m " * 25 + "RESULTS " + "r " * 25 + "methods again"
    patterns = {"methods": r"METHODS?[:]?\s*", "results": r"RESULTS?\s*"}
    got = [(r["section"], r["start"], r["text"]) for r in C.offset_sections(texts(spark, t, None, ""), patterns).orderBy("start").collect()]
    at = sorted((m.start(), n) for n, p in patterns.items() for m in re.finditer(p, t, re.I))
    ends = [a for a, _ in at[1:]] + [len(t)]
    want = [(n, a, t[a:e].strip()) for (a, n), e in zip(at, ends) if len(t[a:e].split()) >= 20]
    assert got == want and len(want) == 2


def test_parsed_sections(spark):
    t = "p " * 60 + "AIMS\n" + "a " * 12 + "x" * 60 + " AIMS\n" + "b " * 12
    rows = {r["section"]: r["text"] for r in C.parsed_sections(texts(spark, t), {"aims": r"AIMS\n"}).collect()}
    assert set(rows) == {"preamble", "aims", "aims_1", "full_text"}
    assert rows["aims_1"] == ("b " * 12).strip()


def test_mmr_by_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rel = [round(float(x), 6) for x in v @ v[0]]
    rows = [(0, i, rel[i], [float(x) for x in v[i]], i % 3 == 0) for i in range(12)]
    c = spark.createDataFrame(rows, "query_id long, item_id long, sim double, v array<double>, focused boolean")
    got = [r["item_id"] for r in R.mmr(spark.createDataFrame([(0,)], "query_id long"), c, 5).orderBy("pick").collect()]
    picked = []
    for _ in range(5):
        best = max((i for i in range(12) if i not in picked), key=lambda i: (round(0.7 * rel[i] * (1.3 if i % 3 == 0 else 1) - 0.3 * max([float(v[i] @ v[j]) for j in picked], default=0), 9), -i))
        picked.append(best)
    assert got == picked


def test_similar_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    q, i = d.toDF("query_id", "qv"), d.toDF("item_id", "v")
    one_, many = (sorted(map(tuple, R.similar(q, i, 5, True, b).collect())) for b in (1000, 7))
    assert one_ == many and len(one_) == 61 * 5


def test_nearest_by_brute_force():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 16))
    v[::3], v[1::50], v[2] = v[0], np.round(v[1::50]), 0.0
    v[7::9] = v[7] + 1e-9 * rng.standard_normal((len(v[7::9]), 16))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    q, but = np.concatenate([v[:600], -v[:100]]), np.concatenate([np.arange(600), np.full(100, -1)])
    s = np.round(q @ v.T, 6) + 0.0
    s[np.arange(600), np.arange(600)] = -np.inf
    for k in (1, 10, 700):
        for width in (128, 4096):
            x, y, e = R._nearest(q, v, k, but, 256, width)
            want = [(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(v)), -s[i]))[:k]]
            assert list(zip(x.tolist(), y.tolist())) == want and np.array_equal(e, s[x, y])


def test_vectors_meet_in_few_large_blocks(spark):
    # each side is copied so many times
    assert R._blocks(10, 64) == 1 and R._blocks(615_000, 64) < 20 and R._blocks(615_000, 768) < 230
    rng = np.random.default_rng(6)
    v = rng.standard_normal((70, 4))
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for block in (None, 16):
        got = {(r["query_id"], r["item_id"]): r["sim"] for r in R.similar(d.toDF("query_id", "qv"), d.toDF("item_id", "v"), block=block).collect()}
        assert len(got) == 4900 and all(abs(x - v[i] @ v[j]) < 1e-6 for (i, j), x in got.items())


def test_weights_of_shared_terms(spark):
    rng = np.random.default_rng(2)
    side = lambda rows, each: pd.DataFrame({"row": np.repeat(np.arange(rows), each), "term": (40 * rng.random(rows * each) ** 3).astype(np.int64)}).drop_duplicates()
    a, p = side(30, 6), side(50, 9)
    p["w"] = rng.random(len(p))
    want = np.zeros((30, 50))
    for r, t in a.itertuples(index=False):
        for x, y, w in p.itertuples(index=False):
            want[r, x] += w if t == y else 0
    for at_once in (1, 64, 1 << 21):
        assert np.allclose(R._sums((30, 50), a.sample(frac=1, random_state=1), p.sample(frac=1, random_state=2), at_once), want)
    assert not R._sums((2, 3), a[:0], p[:0]).any()


def test_topics_without_pairs(spark):
    q = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, ["z"]), (1, ["w"])], "query_id long, topics array<string>")
    i = spark.createDataFrame([(10, ["x"]), (10, ["y"]), (11, ["x", "y"]), (12, []), (13, ["w"]), (14, ["v"])], "item_id long, topics array<string>")
    ranked = spark.createDataFrame([(k, j, r) for k in (1, 2, 3, 4) for r, j in enumerate((10, 12, 13, 99), 1)], "query_id long, item_id long, rank int")
    explode = lambda d, key: d.select(key, F.explode("topics").alias("t"))
    pairs = explode(q, "query_id").join(explode(i, "item_id"), "t").select("query_id", "item_id")
    assert sorted(map(tuple, M.hits_by_topics(ranked, q, i).collect())) == sorted(map(tuple, M.hits(ranked, pairs).collect()))


def test_matches_are_summed_by_sets_of_concepts(spark):
    e = spark.createDataFrame([(f"DOC_{d}", c) for d in range(200) for c in ("A", "B", "HUB") if d % 2 or c == "A"], "src string, dst string")
    w = spark.createDataFrame([(q, c, v) for q in range(5) for c, v in (("A", 1.5), ("B", 1.0), ("C", 9.0))], "query_id long, concept string, weight double")
    for only in (False, True):
        got = G.match(e, w, only)
        assert {tuple(r) for r in got.collect()} == {(q, f"DOC_{d}", 2.5 if d % 2 else 1.5) for q in range(5) for d in range(200) if d % 2 or not only}
        # no aggregate over the pairs is left
        assert "id" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [query_id")[1].split("]")[0].replace("query_id", "")


def test_lower_case_is_made_once(spark):
    d = spark.createDataFrame([("Aim, HAND",)], "text string").select(L.labels_of(L.lowered(F.col("text")), L.TOPICS).alias("x"))
    assert d.first()["x"] == ["aim", "hand"]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1


def test_key_terms_of_repeated_ids(spark):
    rows = [(1, "alpha beta beta"), (1, "gamma alpha with alpha"), (2, "Delta delta epsi\x0bepsi zeta"), (3, None), (None, "once more"), (None, "more")]
    for d, want in ((rows, {(1, 1, "alpha", 3), (1, 2, "beta", 2), (1, 3, "gamma", 1), (None, 1, "more", 2), (None, 2, "once", 1)}), (rows[2:5], {(None, 1, "once", 1), (None, 2, "more", 1)})):
        got = key_terms(spark.createDataFrame(d, "doc_id long, text string"))
        assert {tuple(r) for r in got.collect()} == want | {(2, 1, "delta", 2), (2, 2, "epsi", 2), (2, 3, "zeta", 1)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_sections_are_cut_in_one_pass(spark):
    t = "  lead " * 20 + "AIMS\n" + "é " * 12 + "x" * 60 + " AIMS\n" + "b " * 9
    d = texts(spark, t, None, "", "AIMS\n" + "c " * 10)
    got = C.parsed_sections(d, {"aims": r"AIMS\n"})
    assert {(r["doc_id"], r["section"]): r["text"] for r in got.collect()} == {(0, "preamble"): ("  lead " * 20).strip(), (0, "aims"): ("é " * 12 + "x" * 60).strip(), (0, "full_text"): t, (1, "full_text"): "", (2, "full_text"): "", (3, "aims"): ("c " * 10).strip(), (3, "full_text"): "AIMS\n" + "c " * 10}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_metrics_of_a_known_ranking(spark):
    ranked = spark.createDataFrame([(1, i, r) for r, i in enumerate([10, 11, 12, 13], 1)] + [(2, 10, 1)], "query_id long, item_id long, rank int")
    rel = spark.createDataFrame([(1, 10), (1, 12), (1, 99)], "query_id long, item_id long")
    rows = {r["query_id"]: r for r in M.per_query(M.hits(ranked, rel), (1, 3)).collect()}
    r = rows[1]
    assert (r["precision_1"], r["recall_3"], r["rr"]) == (1.0, 2 / 3, 1.0)
    assert abs(r["ap"] - (1 + 2 / 3) / 3) < 1e-9
    assert abs(r["ndcg_3"] - (1 + 0.5) / (1 + 1 / math.log2(3) + 0.5)) < 1e-9
    assert rows[2]["ap"] == rows[2]["ndcg_3"] == rows[2]["rr"] == 0.0


def test_graph_known_values(spark):
    assert G.density(1826, 16901) == 0.010143
    e = spark.createDataFrame([("DOC_1", "COND_a", "treats", 1.2), ("DOC_2", "COND_a", "treats", 1.2), ("DOC_3", "COND_b", "treats", 1.2)], "src string, dst string, type string, weight double")
    seeds = spark.createDataFrame([(7, "DOC_1", 1)], "query_id long, seed string, rank int")
    assert [tuple(r) for r in G.two_hop(e, seeds).select("id", "score", "hub").collect()] == [("DOC_2", 0.96, "COND_a")]


def test_louvain_finds_two_cliques(spark):
    pairs = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0")]
    e = spark.createDataFrame([(x, y, 1.0) for x, y in pairs], "src string, dst string, weight double")
    g = {r["id"]: r["community"] for r in G.louvain(e).collect()}
    assert len({g[f"a{i}"] for i in range(5)}) == len({g[f"b{i}"] for i in range(5)}) == 1 and g["a0"] != g["b0"]


def test_label_moves_come_near_moves_in_one_task(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a in range(120) for b in range(a) if rng.random() < (0.5 if a % 6 == b % 6 else 0.02)]
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", 1.0) for a, b in pairs], "src string, dst string, weight double")
    value = lambda g: G.modularity(e, g.select("id", "community")).first()[0]
    one, many = value(G.louvain(e)), value(G.louvain(e, in_task=200))
    assert one > 0.5 and many >= 0.9 * one


def test_numbered_over_spans(spark):
    rows = [(i * i, "ab"[i % 3 == 0] if i % 7 else None) for i in range(100)]
    d = spark.createDataFrame(rows, "id long, g string")
    want, n = {}, {}
    for i, g in rows:
        n[g] = n.get(g, 0) + 1
        want[i] = n[g]
    for span in (1000, 10):
        assert {r["id"]: r["rn"] for r in D.numbered(d, "g", "id", span).collect()} == want
    assert D.numbered(d.where("false"), "g", "id").count() == 0


def test_two_hop_by_brute_force(spark):
    rng = np.random.default_rng(9)
    weights = {"treats": 1.2, "uses": 1.1, "targets": 1.1}
    hubs = [(f"H{i}", t) for i, t in enumerate([*weights] * 2)]
    edges = [(f"DOC_{d}", h, t, weights[t]) for d in range(50) for h, t in hubs if rng.random() < 0.4]
    seeds = [(q, f"DOC_{int(d)}", r) for q in range(4) for r, d in enumerate(rng.choice(50, 3, replace=False), 1)]
    want = set()
    for q in range(4):
        own = {s: r for x, s, r in seeds if x == q}
        best = {}
        for s, r in own.items():
            for d, h, _, w in edges:
                if d == s:
                    for x, y, _, _ in edges:
                        if y == h and x not in own:
                            best[x] = min(best.get(x, (0, 9, "z")), (-w, r, h))
        want |= {(q, d, b[2], i) for i, (d, b) in enumerate(sorted(best.items(), key=lambda t: (-round(-t[1][0] * 0.8, 3), t[0]))[:5], 1)}
    e, s = spark.createDataFrame(edges, "src string, dst string, type string, weight double"), spark.createDataFrame(seeds, "query_id long, seed string, rank int")
    assert {(r["query_id"], r["id"], r["hub"], r["rank"]) for r in G.two_hop(e, s).collect()} == want


def test_related_by_brute_force(spark):
    rng = np.random.default_rng(8)
    docs, hubs = [f"DOC_{i}" for i in range(60)], ["COND_a", "COND_b", "YEAR_1", "HUB"]
    edges = [(d, h, float(rng.choice([0.6, 1.0, 1.2]))) for d in docs for h in hubs if rng.random() < 0.7] + [(docs[i], docs[i + 1], 0.7) for i in range(0, 58, 3)] + [("COND_a", "COND_b", 0.3)]
    e = spark.createDataFrame([(a, b, "x", w) for a, b, w in edges], "src string, dst string, type string, weight double")
    seeds = [(q, f"DOC_{s}") for q, s in ((1, 0), (1, 3), (2, 30), (3, 59))]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = max(w, near.get(a, {}).get(b, 0))
        near.setdefault(b, {})[a] = max(w, near.get(b, {}).get(a, 0))
    best = {}
    for q, s in seeds:
        for x, w in near.get(s, {}).items():
            best[q, x] = max(best.get((q, x), 0), w)
            if not x.startswith("DOC_"):
                for y, v in near[x].items():
                    if y != s and y not in near[s]:
                        best[q, y] = max(best.get((q, y), 0), w * v)
    for k in (3, 10):
        want = {(q, d, i) for q in (1, 2, 3) for i, d in enumerate(sorted((d for x, d in best if x == q and d.startswith("DOC_")), key=lambda d: (-round(best[q, d], 6), d))[:k], 1)}
        got = {(r["query_id"], r["id"], r["rank"]) for r in G.related(e, spark.createDataFrame(seeds, "query_id long, seed string"), k).collect()}
        assert got == want


def test_encoder_of_ones_own(spark):
    def broken():
        raise OSError("no model here")

    class Marked:
        def encode(self, texts):
            return np.array([[len(t), 1.0, 1.0] for t in texts])

    d = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "x" * 50_000)], "id long, text string").repartition(2)
    rows = {r["id"]: r["v"] for r in d.select("id", encoded(F.col("text"), broken, lambda: Hashed(8)).alias("v")).collect()}
    assert rows[2] is None and list(rows[3]) == [0.0] * 8 and abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and len(rows[4]) == 8
    rows = {r["id"]: r["v"] for r in d.select("id", encoded(F.col("text"), Marked, batch=1).alias("v")).collect()}
    assert abs(rows[1][0] - 3 / 11**0.5) < 1e-6
    with pytest.raises(Exception, match="no model here"):
        d.select(encoded(F.col("text"), broken)).collect()


def test_replace_keeps_a_backup(spark, tmp_path):
    at = f"{tmp_path}/table"
    assert files_.replace(spark.range(3), at) is None
    backup = files_.replace(spark.read.parquet(at).where("id > 0"), at)
    assert spark.read.parquet(at).count() == 2 and spark.read.parquet(backup).count() == 3
    files_.replace(spark.range(1), at, "one")
    with pytest.raises(FileExistsError):
        files_.replace(spark.range(9), at, "one")
    assert spark.read.parquet(at).count() == 1


def test_project_search(spark):
    import http.server
    import json
    import threading

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            name, year = asked["criteria"]["org_names"][0], asked["criteria"]["fiscal_years"][0]
            self.send_response({"busy": 429, "broken": 500}.get(name, 200))
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"id": f"{name}-{year}-{i}"} for i in range(asked["limit"])]}).encode() if name != "odd" else b"no json")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        d = search_projects(spark, url, ["one", "two", "busy", "broken", "odd"], [2023, 2024], limit=3, pause="0")
        rows = sorted((r["organisation"], r["year"], json.loads(r["project"])["id"]) for r in d.collect())
    finally:
        server.shutdown()
    assert rows == [(o, y, f"{o}-{y}-{i}") for o in ("one", "two") for y in (2023, 2024) for i in range(3)]
    assert search_projects(spark, url, ["one"], [2023], timeout="1").count() == 0


def test_no_pdf_library_is_said(monkeypatch):
    monkeypatch.setattr(files_.importlib.util, "find_spec", lambda name: None)
    with pytest.raises(ModuleNotFoundError):
        files_.pdf_extractors()


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class None_:
                            @staticmethod
                            def isDefined():
                                return False

                        return None_

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files_.scratch(Session, "x")


def test_csv_keeps_white_space_and_empty_texts(spark, tmp_path):
    rows = list(enumerate([None, "", "  ", " lead", "trail\n", "\ttab\t", "a\r\nb\r", "\x00", '"\n', 'a "b", c', "end"]))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.col("text"), "source": F.col("text"), "n_chars": F.length("text").cast("long")})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["s1_csv"](spark, str(tmp_path)).collect()}
    assert got == {(i, t if t is None else hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows}


def test_update_and_quota(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    new = spark.createDataFrame([(2, "z", 5)], "id long, a string, b int")
    assert sorted(map(tuple, D.update(old, new, "id").collect())) == [(1, "x", None), (2, "z", 5)]
    d = spark.range(10).withColumn("g", F.col("id") % 2)
    assert D.quota(d, {("g",): 3}, ["id"]).count() == 6
    assert D.quota(d, {("g",): 3}, ["id"], 4).count() == 4


def test_broken_documents_are_rows(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "b.bin").write_bytes(b"good text " * 20)
    rows = files_.read_documents(spark, str(tmp_path), lambda c: [c.decode()], pattern="*.bin").orderBy("path").collect()
    assert [r["extraction_method"] for r in rows] == ["failed", "primary"]
    assert rows[0]["warning"].startswith("UnicodeDecodeError")

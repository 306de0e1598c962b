"""Queries of the chunkers over the documents. The fixture's paragraphs end at single newlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import lexicon as L
from quillgrove.functions import score as S
from quillgrove.functions import text as T
from quillgrove.operators import chunk as C
from quillgrove.plans.text_queries import COMPLETE_SQL, SENTENCES_SQL, words_sql
from quillgrove.registry import query, table

HEADERS = {"aims": "the|des|die", "background": "and|und|et|de", "methods": "in|en", "results": "on|an"}
MARKERS = ("hand", "near", "heat", "rest")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _digest(chunks: DataFrame, *keep: str) -> DataFrame:
    return chunks.select("doc_id", *keep, T.word_count(F.col("text")).alias("n_words"), F.md5("text").alias("digest"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS pos FROM documents)"""
N_WORDS = f"CAST(len({words_sql('text')}) AS BIGINT) AS n_words, md5(text) AS digest"


def sections_sql(headers: dict[str, str], before: str = "header", with_: str = "") -> str:
    """CTE s(doc_id, grp, section, text) of header sections that aren't empty."""
    case = "CASE " + " ".join(f"WHEN regexp_matches(trim(line), '(?i)^(?:{p})') THEN '{n}'" for n, p in headers.items()) + " END"
    return rf"""WITH RECURSIVE {with_} {_LINES}, h AS (SELECT *, {case} AS name FROM l),
g AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY pos) + CASE WHEN first_value(name) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS grp FROM h),
s AS (SELECT doc_id, grp, coalesce(max(name), '{before}') AS section, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY doc_id, grp),
n AS (SELECT doc_id, section, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS chunk_index FROM s WHERE text <> '')"""


@query(rf"SELECT doc_id, {N_WORDS} FROM (SELECT doc_id, trim(text) AS text FROM documents)")
def c1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.whole(_docs(spark, sf_dir)))


@query(f"{sections_sql(HEADERS)} SELECT doc_id, chunk_index, section, {N_WORDS} FROM n")
def c2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.header_sections(_docs(spark, sf_dir), HEADERS), "chunk_index", "section")


_PARAS = """pa AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents)"""
_MASK = " + ".join(f"CASE WHEN contains(lower(p), '{k}') THEN {1 << i} ELSE 0 END" for i, k in enumerate(L.TOPICS.keywords))


@query(f"""WITH RECURSIVE {_PARAS}, p AS (SELECT doc_id, CAST(i AS INTEGER) AS i, ps[i] AS p, len(ps) AS n_all, CAST({_MASK.replace("(p)", "(ps[i])")} AS BIGINT) AS m, CAST(len({words_sql("ps[i]")}) AS BIGINT) AS n FROM pa, unnest(range(1, len(ps) + 1)) AS t(i)),
f AS (SELECT doc_id, i, m, n, 0 AS c FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN f.m <> 0 AND f.m & p.m = 0 AND f.n >= 50 THEN p.m ELSE f.m | p.m END, CASE WHEN f.m <> 0 AND f.m & p.m = 0 AND f.n >= 50 THEN p.n ELSE f.n + p.n END, f.c + CASE WHEN f.m <> 0 AND f.m & p.m = 0 AND f.n >= 50 THEN 1 ELSE 0 END
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
a AS (SELECT f.doc_id, f.c AS chunk_index, CASE WHEN max(n_all) <= 1 THEN 'single_topic' ELSE 'topic' END AS chunk_type, string_agg(p.p, chr(10) || chr(10) ORDER BY p.i) AS text FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i GROUP BY ALL)
SELECT doc_id, chunk_index, chunk_type, {N_WORDS} FROM a""")
def c3_topic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.topic_shift(_docs(spark, sf_dir), L.TOPICS.keywords, "\n"), "chunk_index", "chunk_type")


OFFSETS = {"aims": r"The\s+", "background": r"And\s+", "methods": r"\bIn\b[:]?\s*", "results": r"\bLe\b\s*"}


def offsets_sql() -> str:
    """CTE m(doc_id, i, section, start, body) of the matches of OFFSETS: the text is cut in front of each, and what stands before is counted.

    Letters beyond ASCII become an x first, as the ends of words are judged by all letters.
    """
    one = [rf"SELECT doc_id, {i} AS i, '{n}' AS section, string_split(regexp_replace(a, '(?i)({p})', chr(1) || '\1', 'g'), chr(1)) AS sg, '(?i)^(?:{p})' AS p FROM ax" for i, (n, p) in enumerate(OFFSETS.items())]
    body = " ".join(f"WHEN {i} THEN length(regexp_extract(sg[k], '(?i)^(?:{p})'))" for i, p in enumerate(OFFSETS.values()))
    return rf"""ax AS (SELECT doc_id, regexp_replace(text, '[^\P{{L}}a-zA-Z]', 'x', 'g') AS a FROM documents WHERE text <> ''), pm AS ({" UNION ALL ".join(one)}),
m AS (SELECT doc_id, i, section, CAST(list_sum(list_transform(sg[1:k - 1], lambda s: length(s))) AS INTEGER) AS start, CAST(list_sum(list_transform(sg[1:k - 1], lambda s: length(s))) + CASE i {body} END AS INTEGER) AS body FROM pm, unnest(range(2, len(sg) + 1)) AS t(k))"""


@query(rf"""WITH {offsets_sql()}, o AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, i) AS nxt FROM m),
s AS (SELECT doc_id, section, start, CAST(coalesce(nxt, length(d.text)) AS INTEGER) AS stop, d.text AS whole FROM o JOIN documents d USING (doc_id)),
c AS (SELECT doc_id, section, start, stop, regexp_replace(substr(whole, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS text FROM s) SELECT doc_id, section, start, stop, {N_WORDS} FROM c WHERE len({words_sql('text')}) >= 20""")
def c4_offset_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.offset_sections(_docs(spark, sf_dir), OFFSETS), "section", "start", "stop")


def packed_sql(budget: int, source: str, key: str = "doc_id", with_: str = "") -> str:
    """CTE a(key, chunk_index, text) of greedy packing; source has key and ps, the array of paragraphs."""
    sentences = SENTENCES_SQL.replace("(text,", "(p,")
    return f"""WITH RECURSIVE {with_} {source}, sg AS (SELECT {key}, flatten(list_transform(ps, lambda p: CASE WHEN len({words_sql("p")}) > {budget} THEN {sentences} ELSE [p] END)) AS ss FROM pa),
p AS (SELECT {key}, CAST(i AS INTEGER) AS i, ss[i] AS p, CAST(len({words_sql("ss[i]")}) AS BIGINT) AS n FROM sg, unnest(range(1, len(ss) + 1)) AS t(i)),
f AS (SELECT {key}, i, n, 0 AS c FROM p WHERE i = 1 UNION ALL
  SELECT {", ".join("p." + k for k in key.split(", "))}, p.i, CASE WHEN f.n + p.n > {budget} THEN p.n ELSE f.n + p.n END, f.c + CASE WHEN f.n + p.n > {budget} THEN 1 ELSE 0 END FROM f JOIN p ON {" AND ".join(f"p.{k} = f.{k}" for k in key.split(", "))} AND p.i = f.i + 1),
a AS (SELECT {", ".join("f." + k for k in key.split(", "))}, f.c AS chunk_index, string_agg(p.p, chr(10) || chr(10) ORDER BY p.i) AS text FROM f JOIN p ON {" AND ".join(f"p.{k} = f.{k}" for k in key.split(", "))} AND p.i = f.i GROUP BY ALL)"""


@query(f"{packed_sql(250, _PARAS)} SELECT doc_id, chunk_index, {N_WORDS} FROM a")
def c5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.packed(_docs(spark, sf_dir), 250, "\n"), "chunk_index")


def overlap_sql(source: str = "documents") -> str:
    """CTE o(doc_id, chunk_index, total_chunks, text) of overlapping chunks."""
    return f"""w AS (SELECT doc_id, text, len({words_sql()}) AS n FROM {source}), sg AS (SELECT doc_id, CASE WHEN n <= 400 THEN [trim(text)] ELSE {SENTENCES_SQL} END AS ss FROM w WHERE n >= 20),
p AS (SELECT doc_id, CAST(i AS INTEGER) AS i, ss, CAST(len({words_sql("ss[i]")}) AS BIGINT) AS n, list_transform(ss, lambda s: CAST(len({words_sql("s")}) AS BIGINT)) AS ws FROM sg, unnest(range(1, len(ss) + 1)) AS t(i)),
f AS (SELECT doc_id, i, n, 1 AS a, 0 AS c FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN f.n + p.n > 400 THEN CAST(list_sum(p.ws[greatest(f.a, p.i - 2):p.i]) AS BIGINT) ELSE f.n + p.n END, CASE WHEN f.n + p.n > 400 THEN greatest(f.a, p.i - 2) ELSE f.a END, f.c + CASE WHEN f.n + p.n > 400 THEN 1 ELSE 0 END
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
b AS (SELECT doc_id, c AS chunk_index, min(a) AS a, max(i) AS b FROM f GROUP BY ALL),
o AS (SELECT b.doc_id, chunk_index, CAST(count(*) OVER (PARTITION BY b.doc_id) AS INTEGER) AS total_chunks, array_to_string(ss[a:b], ' ') AS text FROM b JOIN sg ON sg.doc_id = b.doc_id)"""


@query(f"WITH RECURSIVE {overlap_sql()} SELECT doc_id, chunk_index, total_chunks, {N_WORDS} FROM o")
def c6_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.overlapped(_docs(spark, sf_dir)), "chunk_index", "total_chunks")


_SLIDING = f"""w AS (SELECT doc_id, {words_sql()} AS w FROM documents), c AS (SELECT doc_id, CAST(i // 200 AS INTEGER) AS chunk_index, array_to_string(w[i + 1:i + 250], ' ') AS text FROM w, unnest(range(0, len(w), 200)) AS t(i))"""


@query(f"WITH {_SLIDING} SELECT doc_id, chunk_index, {N_WORDS} FROM c")
def c7_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.sliding(_docs(spark, sf_dir)), "chunk_index")


_SECTION_PARAS = "pa AS (SELECT doc_id, section_index, section, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM (SELECT doc_id, chunk_index AS section_index, section, text FROM n))"


@query(f"{packed_sql(250, _SECTION_PARAS, 'doc_id, section_index, section', sections_sql(HEADERS).replace('WITH RECURSIVE', '') + ',')} SELECT doc_id, section_index, section, chunk_index, {N_WORDS} FROM a")
def c8_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.hierarchical(_docs(spark, sf_dir), HEADERS), "section_index", "section", "chunk_index")


@query(f"""WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents), p AS (SELECT doc_id, i, ss[i] AS p, {L.any_sql(MARKERS, "lower(ss[i])")} AS hit FROM s, unnest(range(1, len(ss) + 1)) AS t(i)),
g AS (SELECT *, CAST(coalesce(sum(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS chunk_index FROM p),
a AS (SELECT doc_id, chunk_index, string_agg(p, ' ' ORDER BY i) AS text FROM g GROUP BY ALL) SELECT doc_id, chunk_index, {N_WORDS} FROM a""")
def c9_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.marker_topics(_docs(spark, sf_dir), MARKERS), "chunk_index")


@query(rf"""WITH RECURSIVE {offsets_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, i) AS n FROM m),
f AS (SELECT doc_id, n, start AS last, true AS keep FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, CASE WHEN o.start - f.last > 50 THEN o.start ELSE f.last END, o.start - f.last > 50 FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1),
k AS (SELECT o.*, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.n) - 1 AS place, lead(o.start) OVER (PARTITION BY o.doc_id ORDER BY o.n) AS nxt FROM o JOIN f ON f.doc_id = o.doc_id AND f.n = o.n AND f.keep),
b AS (SELECT doc_id, place, section, regexp_replace(substr(d.text, body + 1, greatest(coalesce(nxt, length(d.text)) - body, 0)), '^\s+|\s+$', '', 'g') AS text FROM k JOIN documents d USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY place) AS nth FROM b WHERE len({words_sql('text')}) >= 10),
h AS (SELECT doc_id, regexp_replace(substr(d.text, 1, k.start), '^\s+|\s+$', '', 'g') AS text FROM k JOIN documents d USING (doc_id) WHERE place = 0 AND k.start > 100),
a AS (SELECT doc_id, CASE WHEN nth = 1 THEN section ELSE section || '_' || place END AS section, text FROM g UNION ALL SELECT doc_id, 'preamble', text FROM h WHERE text <> '' UNION ALL SELECT doc_id, 'full_text', coalesce(text, '') FROM documents)
SELECT doc_id, section, {N_WORDS} FROM a""")
def c10_parsed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.parsed_sections(_docs(spark, sf_dir), OFFSETS), "section")


TITLED = {"title": "[a-z]+ (?:the|of|de|la|der)", "aims": "the|des|die", "methods": "in|en"}


@query(f"{sections_sql(TITLED, 'untitled')} SELECT doc_id, chunk_index, section, {N_WORDS} FROM n")
def c11_line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.header_sections(_docs(spark, sf_dir), TITLED, "untitled"), "chunk_index", "section")


TWO = {"abstract": "[^ ]+(?: [^ ]+){0,3}$", "aims": ".* (?:the|le|der) "}


@query(f"{sections_sql(TWO, 'header')} SELECT doc_id, section, {N_WORDS} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY chunk_index DESC) AS r FROM n) WHERE r = 1")
def c12_last_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(C.last_sections(_docs(spark, sf_dir), TWO), "section")


@query(f"""WITH {_SLIDING}, k AS (SELECT doc_id, chunk_index, list_filter({words_sql("lower(text)")}, lambda w: length(w) > 9) AS terms FROM c)
SELECT doc_id, chunk_index, CAST(row_number() OVER w - 1 AS INTEGER) AS index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, (row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY doc_id) - 1, 1) AS position,
  array_to_string((lag(terms) OVER w)[1:3], ' ') AS previous_terms, array_to_string((lead(terms) OVER w)[1:3], ' ') AS next_terms FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def c13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.filter(T.words(F.lower("text")), lambda w: F.length(w) > 9)
    c = C.with_neighbours(C.sliding(_docs(spark, sf_dir)), terms).drop("text")
    return c.withColumns({k: F.array_join(k, " ") for k in ("previous_terms", "next_terms")})


@query(f"""WITH {_SLIDING}, b AS (SELECT 'sliding' AS strategy, text FROM c UNION ALL SELECT 'whole', trim(text) FROM documents),
m AS (SELECT strategy, text, len({words_sql()}) AS n, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS c FROM b)
SELECT strategy, count(*) AS n_chunks, round(avg(n), 4) AS mean_words, round(stddev_pop(n), 4) AS std_words, round(avg({COMPLETE_SQL}), 6) AS completeness FROM m GROUP BY strategy""")
def a11_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    both = C.sliding(d).select(F.lit("sliding").alias("strategy"), "text").unionByName(C.whole(d).select(F.lit("whole").alias("strategy"), "text"))
    n = T.word_count(F.col("text"))
    return both.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 4).alias("mean_words"), F.round(F.stddev_pop(n), 4).alias("std_words"), F.round(F.avg(S.completeness(F.col("text"))), 6).alias("completeness"))

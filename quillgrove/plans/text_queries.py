"""Queries of text cleaning, splitting and lexicon scores over the documents."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.functions import lexicon as L
from quillgrove.functions import score as S
from quillgrove.functions import text as T
from quillgrove.registry import query, table
from quillgrove.sources.files import written

SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
WORDS_SQL = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"


def words_sql(text: str = "text") -> str:
    return WORDS_SQL.format(text)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _digest(df: DataFrame, out: Column) -> DataFrame:
    """doc_id with length and md5 of a computed text."""
    return df.select("doc_id", out.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_out"), F.md5("t").alias("digest"))


def digest_sql(expression: str, source: str = "documents") -> str:
    return f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n_out, md5(t) AS digest FROM (SELECT doc_id, {expression} AS t FROM {source})"


def _labelled(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in pairs) + f" ELSE '{default}' END"


@query(digest_sql(r"trim(regexp_replace(text, '\s+', ' ', 'g'))"))
def p1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.normalize(F.col("text")))


ABSTRACT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^PROJECT SUMMARY/ABSTRACT', '', 'i'), '^ABSTRACT\s*:?', '', 'i'), '^NARRATIVE\s*:?', '', 'i'))"


@query(digest_sql(ABSTRACT_SQL.format("'Abstract: ' || text")))
def p2_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.clean_abstract(F.concat(F.lit("Abstract: "), F.col("text"))))


@query(r"""SELECT doc_id, CAST(len(k) AS BIGINT) AS n_lines, md5(array_to_string(k, chr(10))) AS digest FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^\d+$') AND (length(trim(x)) >= 3 OR trim(x) IN ('.', '-', '–'))) AS k FROM documents)""")
def p3_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.page_lines(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("n_lines"), F.md5(F.array_join("k", "\n")).alias("digest"))


_SP = "[[:space:]]"
_FORMS = [rf"PHS{_SP}+[0-9]{{3,}}{_SP}*[(]Rev[.]{_SP}*[0-9/]+[)]", rf"OMB{_SP}+No[.]{_SP}*[0-9-]+", rf"Continuation{_SP}+Format{_SP}+Page", rf"Page{_SP}+[0-9]+{_SP}+of{_SP}+[0-9]+"]


def clean_page_sql(text: str) -> str:
    """The cleaned page; a line behind one that ends with a hyphen is joined to it."""
    lines = rf"list_filter(string_split(coalesce({text}, ''), chr(10)), lambda x: NOT regexp_matches(trim(x), '^\d+$') AND (length(trim(x)) >= 3 OR trim(x) IN ('.', '-', '–')))"
    joined = f"coalesce(list_reduce({lines}, lambda a, x: CASE WHEN right(a, 1) = '-' THEN a[:-2] || trim(x) ELSE a || chr(10) || x END, NULL), '')"
    joined = joined.replace(", NULL), '')", "), '')").replace(f"list_reduce({lines}", f"list_reduce(CASE WHEN len({lines}) = 0 THEN [''] ELSE {lines} END")
    t = rf"replace(regexp_replace(regexp_replace({joined}, '\n\n\n+', chr(10) || chr(10), 'g'), '[ \t][ \t]+', ' ', 'g'), chr(12), chr(10) || chr(10))"
    for f in _FORMS:
        t = f"regexp_replace({t}, '(?i){f}', '', 'g')"
    return f"trim({t})"


@query(digest_sql(clean_page_sql("text")))
def p3_clean_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.clean_page(F.col("text")))


OCR_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace({}, '\n[[:space:]]*\n[[:space:]]*\n+', chr(10) || chr(10), 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '-[[:space:]]*[0-9]+[[:space:]]*-', '', 'g'), '\n[0-9]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'))"


@query(digest_sql(OCR_SQL.format("text")))
def p4_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.clean_ocr(F.col("text")))


SCRUB_SQL = r"regexp_replace(regexp_replace(regexp_replace({0}, '[^[:space:]]+@[^[:space:]]+[.][^[:space:]]+', '', 'g'), 'https?://[^[:space:]]+', '', 'g'), '[(]?[0-9]{{3}}[)]?[-.[:space:]]?[0-9]{{3}}[-.[:space:]]?[0-9]{{4}}', '', 'g')"
_GRANT = "text"
for _p in ("(?:RFA|NOT)-[A-Z]+-[0-9]+-[0-9]+", "PA-[0-9]+-[0-9]+", "Page [0-9]+ of [0-9]+", "OMB No[.] [0-9]+-[0-9]+", "Expiration Date:.*"):
    _GRANT = f"regexp_replace({_GRANT}, '{_p}', '', 'gi')"
BY_TYPE_SQL = rf"""CASE k WHEN 0 THEN {_GRANT}
  WHEN 1 THEN trim(regexp_replace(regexp_replace(text, '^(?:SUMMARY|ABSTRACT|BACKGROUND)[[:space:]]*:?[[:space:]]*', '', 'i'), '^[[:upper:]][[:lower:]]+ [[:upper:]][.] [[:upper:]][[:lower:]]+,? (?:et al[.]?,? )?', ''))
  ELSE {SCRUB_SQL.format("text")} END"""
_BY_TYPE = f"(SELECT doc_id, text, doc_id % 3 AS k FROM documents)"


def _kind() -> Column:
    return F.get(F.array(F.lit("nih_grant"), F.lit("research_abstract"), F.lit("general_document")), (F.col("doc_id") % 3).cast("int"))


@query(digest_sql(BY_TYPE_SQL, _BY_TYPE))
def p5_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.clean_by_type(F.col("text"), _kind()))


@query(digest_sql(SCRUB_SQL.format("text")))
def p6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.scrub(F.col("text")))


STRUCTURE_SQL = r"regexp_replace(regexp_replace(regexp_replace({}, '\n[[:space:]]*\n[[:space:]]*\n+', chr(10) || chr(10), 'g'), '(?m)^[[:space:]]*[*•-][[:space:]]+', '• ', 'g'), '(?m)^[[:space:]]*[0-9]+[.][[:space:]]+', '1. ', 'g')"


@query(digest_sql(STRUCTURE_SQL.format("replace(text, ' | ', chr(10) || ' - ')")))
def p7_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.keep_structure(F.replace("text", F.lit(" | "), F.lit("\n - "))))


def noise_sql(text: str) -> str:
    out = rf"regexp_replace({text}, '[ \t]+', ' ', 'g')"
    for a, b in (T.LIGATURES | T.QUOTES).items():
        out = "replace({}, '{}', '{}')".format(out, a.replace("'", "''"), b.replace("'", "''"))
    return rf"""trim(regexp_replace({out}, '[^\pL\pN_\s.,;:!?''"()\[\]{{}}<>-]', ' ', 'g'))"""


@query(digest_sql(noise_sql("text")))
def p8_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.remove_noise(F.col("text")))


@query(digest_sql(noise_sql(STRUCTURE_SQL.format("c")), f"(SELECT doc_id, {BY_TYPE_SQL} AS c FROM {_BY_TYPE})"))
def p9_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_docs(spark, sf_dir), T.preprocess(F.col("text"), _kind()))


@query(f"SELECT doc_id, CAST(len({words_sql()}) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_characters FROM documents")
def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.length("text").cast("long").alias("n_characters"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def p11_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query("SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)")
def p12_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.paragraphs(F.col("text"), "\n").alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.md5(F.array_join("p", "|")).alias("digest"))


CODES = {"MH": "NIMH", "MD": "NIMHD", "CA": "NCI"}
_NAME = "CASE doc_id % 4 WHEN 0 THEN 'R01MD' || CAST(100000 + doc_id AS VARCHAR) || ' 2024.pdf' WHEN 1 THEN 'U01ZZ' || CAST(100000 + doc_id AS VARCHAR) || '-02.pdf' ELSE 'plain 2019' END"
_TITLED = "CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || text ELSE text END"


@query(rf"""WITH x AS (SELECT doc_id, {_NAME} AS name, substr({_TITLED}, 1, 2000) AS head FROM documents),
n AS (SELECT *, coalesce(nullif(regexp_extract(name, '\b([A-Z][0-9]{{2}}[A-Z]{{2}}[0-9]{{6}}(?:-[0-9]{{2}}[A-Z]?)?)\b', 1), ''), nullif(regexp_extract(head, '\b([A-Z][0-9]{{2}}[A-Z]{{2}}[0-9]{{6}}(?:-[0-9]{{2}}[A-Z]?)?)\b', 1), '')) AS grant_number,
  regexp_extract(name, '\b(20\d{{2}})\b', 1) AS own, regexp_extract(head, '\b(20\d{{2}})\b', 1) AS found FROM x)
SELECT doc_id, grant_number, CASE substr(grant_number, 4, 2) WHEN 'CA' THEN 'NCI' WHEN 'MD' THEN 'NIMHD' WHEN 'MH' THEN 'NIMH' ELSE substr(grant_number, 4, 2) END AS institute,
  coalesce(CAST(nullif(own, '') AS INTEGER), CASE WHEN CAST(nullif(found, '') AS INTEGER) BETWEEN 2000 AND 2030 THEN CAST(found AS INTEGER) END) AS year,
  nullif(trim(regexp_extract(head, '(?i)(?:Project[[:space:]]+)?Title[:[:space:]]+([^\n]{{10,150}})', 1)), '') AS title FROM n""")
def p13_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.lit(100000) + F.col("doc_id")).cast("string")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("R01MD"), n, F.lit(" 2024.pdf"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("U01ZZ"), n, F.lit("-02.pdf"))).otherwise("plain 2019")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title: "), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in T.fields(name, text, CODES).items()])


@query("SELECT doc_id, source AS institution, CASE WHEN trim(lang) <> '' AND doc_id % 5 <> 0 THEN lang ELSE 'Unknown' END AS institute FROM documents")
def p14_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    lang = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    return d.select("doc_id", T.resolve(d, ["institution", "org", "source"]).alias("institution"), T.first_filled(lang, F.lit("Unknown")).alias("institute"))


@query(f"""WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, CASE WHEN len({words_sql("l[1]")}) >= 50 THEN l[1] WHEN len({words_sql("l[2]")}) >= 50 THEN l[2] ELSE text END AS body FROM s)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_out, md5(t) AS digest FROM (SELECT doc_id, array_to_string({words_sql("body")}[1:500], ' ') AS t FROM p)""")
def p15_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    sections = F.create_map(F.lit("abstract"), F.get(lines, F.lit(0)), F.lit("preamble"), F.get(lines, F.lit(1)))
    return _digest(_docs(spark, sf_dir), T.abstract_of(sections, F.col("text")))


_PAGES = "1 + doc_id % 7"
QUALITY_SQL = "CASE WHEN length(text) / (1 + doc_id % 7) >= 800 THEN 'high' WHEN length(text) / (1 + doc_id % 7) >= 300 THEN 'medium' WHEN length(text) / (1 + doc_id % 7) >= 100 THEN 'low' ELSE 'failed' END"


def _pages() -> Column:
    return F.lit(1) + F.col("doc_id") % 7


@query(rf"SELECT doc_id, {QUALITY_SQL} AS quality, (length(text) / ({_PAGES}) < 100 OR length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1) > 0.15) AS poor FROM documents")
def p16_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.extraction_quality(t, _pages()).alias("quality"), T.poor_extraction(t, _pages()).alias("poor"))


@query(f"SELECT doc_id, quality FROM (SELECT doc_id, {QUALITY_SQL} AS quality FROM documents) WHERE quality IN ('high', 'medium')")
def p17_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.extraction_quality(F.col("text"), _pages()).alias("quality"))
    return d.where(T.quality_rank(F.col("quality")) >= 2)


@query("SELECT doc_id, (contains(lower(text), 'hand') OR contains(lower(text), 'aim')) AS contains_methods, contains(lower(text), 'rest') AS contains_outcomes, contains(lower(text), 'near') AS contains_innovation, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 100)) AS BIGINT) AS section_count FROM documents")
def p18_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = L.lowered(F.col("text"))
    sections = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= 100)).cast("long")
    return _docs(spark, sf_dir).select("doc_id", L.any_of(low, ["hand", "aim"]).alias("contains_methods"), L.any_of(low, ["rest"]).alias("contains_outcomes"), L.any_of(low, ["near"]).alias("contains_innovation"), sections.alias("section_count"))


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0 AND lang IN ('en', 'de') AND NOT source = 'src0' AND quality = 1")
def p19_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where(F.col("lang").isin("en", "de") & ~(F.col("source") == "src0"))
    lab = table(spark, sf_dir, "labels").where("toxic = 0 and quality = 1")
    return d.join(lab, "doc_id").select("doc_id", "source", "quality")


def _asked(text: str, start: str, stops: str) -> str:
    """What stands behind each start, up to a stop: the text is cut in front of each stop, of which the start is one."""
    cut = f"string_split(regexp_replace({text}, '(?i)({stops})', chr(1) || '\\1', 'g'), chr(1))"
    return f"list_transform(list_filter({cut}, lambda s: regexp_matches(s, '(?is)^{start}')), lambda s: trim(regexp_replace(s, '(?is)^{start}{_SP}*', '')))"


def requirements_sql(text: str) -> str:
    found = [_asked(text, "Requirements?:?", "Requirements?|Qualifications|Deliverables")]
    found += [_asked(text, f"{p}", f"[.]|{p}") for p in ("Applicants? must", "Proposals? should", "Projects? will")]
    found += [_asked(text, f"Key{_SP}+(?:Elements|Components):?", "Key")]
    every = f"list_filter(flatten([{', '.join(found)}]), lambda x: length(x) > 10)"
    sentences = SENTENCES_SQL.replace("(text,", f"({text},")
    plain = f"list_filter({sentences}, lambda s: len({words_sql('s')}) > 5)"
    return f"(CASE WHEN len({every}) > 0 THEN {every} ELSE {plain} END)[1:10]"


#: Items with the words that the patterns look for, and some without.
ASKING_SQL = "(SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' and ', ' Requirements: ') WHEN 2 THEN replace(text, ' the ', ' Applicants must ') ELSE replace(text, ' of ', ' Key elements: ') END AS text FROM benchmark)"


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, t = F.col("item_id") % 4, F.col("text")
    put = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    text = F.when(kind == 0, t).when(kind == 1, put(" and ", " Requirements: ")).when(kind == 2, put(" the ", " Applicants must ")).otherwise(put(" of ", " Key elements: "))
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))


@query(f"SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, r[i] AS requirement FROM (SELECT item_id, {requirements_sql('text')} AS r FROM {ASKING_SQL}), unnest(range(1, len(r) + 1)) AS t(i)")
def p20_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking(spark, sf_dir).select("item_id", F.posexplode(T.requirements(F.col("text"))).alias("pos", "requirement"))


def _section_sql(start: str) -> str:
    return f"nullif(trim(rtrim(regexp_extract(t, '(?is)({start}.*?)(?:DELIVERABLES|QUALIFICATIONS|SUBMISSION|$)', 1), chr(10))), '')"


@query(f"SELECT doc_id, coalesce({', '.join(map(_section_sql, ('REQUIREMENTS?', 'SCOPE OF WORK', 'STATEMENT OF WORK')))}) AS section FROM (SELECT doc_id, 'Scope of work: ' || CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' and ', ' submission ') ELSE replace(text, ' the ', ' requirements ') END AS t FROM documents)")
def p21_requirements_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = lambda a, b: F.replace("text", F.lit(a), F.lit(b))
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, put(" and ", " submission ")).otherwise(put(" the ", " requirements "))
    return _docs(spark, sf_dir).select("doc_id", T.requirements_section(F.concat(F.lit("Scope of work: "), t)).alias("section"))


CHOICES = {"condition": ["aim", "heat", "data"], "population": ["ness", "tone"]}


@query("""SELECT item_id, replace(replace('Work on {condition} for {population}', '{condition}', (['aim', 'heat', 'data'])[1 + CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR) || '-0'), 1, 8))::BIGINT % 3 AS INTEGER)]),
  '{population}', (['ness', 'tone'])[1 + CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR) || '-1'), 1, 8))::BIGINT % 2 AS INTEGER)]) AS query FROM benchmark""")
def p22_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.filled_template(F.lit("Work on {condition} for {population}"), CHOICES, F.col("item_id")).alias("query"))


# Lexicon scores

_T = "(SELECT *, lower(text) AS t FROM documents)"


@query(f"SELECT doc_id FROM {_T} WHERE {L.any_sql(L.HUB)}")
def l1_any_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(L.any_of(L.lowered(F.col("text")), L.HUB)).select("doc_id")


@query(f"SELECT doc_id, {L.count_sql(L.TOPICS.keywords)} AS n_keywords FROM {_T}")
def l2_keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", L.count_of(L.lowered(F.col("text")), L.TOPICS.keywords).alias("n_keywords"))


RELEVANCE_SQL = f"least({L.count_sql(L.HUB + ('hand', 'aim'))} / 3.0::DOUBLE, 1.0::DOUBLE)"


@query(f"SELECT doc_id, round({RELEVANCE_SQL}, 6) AS relevance FROM {_T}")
def l3_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(S.capped_relevance(F.col("text"), L.HUB + ("hand", "aim")), 6).alias("relevance"))


WEIGHTED_SQL = "least((" + " + ".join(f"CASE WHEN contains(t, '{k}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for k, w in L.WEIGHTED) + f") / {sum(w for _, w in L.WEIGHTED)}::DOUBLE, 1.0::DOUBLE)"


@query(f"SELECT doc_id, round({WEIGHTED_SQL}, 3) AS score FROM {_T}")
def l4_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.weighted(F.col("text"), L.WEIGHTED, 3).alias("score"))


@query(f"SELECT doc_id, CASE WHEN {L.any_sql(['hero', 'para'])} THEN 0.8::DOUBLE WHEN {L.any_sql(['rest'])} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS tier FROM {_T}")
def l5_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.tier(F.col("text"), ["hero", "para"], ["rest"]).alias("tier"))


FIXTURE_STUDY = (("first", [["hand"], ["rest"]]), ("second", [["ness", "tone"]]), ("third", [["east"]]))


def ladder_sql(rules: tuple, default: str) -> str:
    return _labelled([(k, " AND ".join(L.any_sql(g) for g in groups)) for k, groups in rules], default)


@query(f"SELECT doc_id, {_labelled([(k, L.any_sql(w)) for k, w in L.CONDITIONS.entries], 'general')} AS condition, {ladder_sql(FIXTURE_STUDY, 'unspecified')} AS study_type FROM {_T}")
def l6_first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", L.first_label(L.lowered(F.col("text")), L.CONDITIONS).alias("condition"), S.ladder(F.col("text"), FIXTURE_STUDY, "unspecified").alias("study_type"))


def labels_sql(lexicon: L.Lexicon) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {L.any_sql(w)} THEN '{k}' END" for k, w in lexicon.entries) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, CASE WHEN len(p) = 0 THEN 'general' ELSE array_to_string(p, ', ') END AS populations FROM (SELECT doc_id, {labels_sql(L.POPULATIONS)} AS p FROM {_T})")
def l7_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", L.labels_of(L.lowered(F.col("text")), L.POPULATIONS).alias("p"))
    return d.select("doc_id", F.when(F.size("p") == 0, "general").otherwise(F.array_join("p", ", ")).alias("populations"))


@query(f"SELECT doc_id, unnest({labels_sql(L.TOPICS)}) AS topic FROM {_T}")
def l8_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(L.labels_of(L.lowered(F.col("text")), L.TOPICS)).alias("topic"))


FIXTURE_TYPES = (("methods", [["hand", "test"]]), ("results", [["rest"]]), ("background", [["east"]]), ("aims", [["aim"]]), ("innovation", [["near", "hero"]]))
FIXTURE_DOCUMENTS = (("nih_grant", [["wheat", "license"]]), ("rfp", [["para"]]), ("research_abstract", [["ness"]]), ("study_protocol", [["tone"]]))
CHUNK_TYPE_SQL = ladder_sql(FIXTURE_TYPES, "general")


@query(f"SELECT doc_id, {CHUNK_TYPE_SQL} AS chunk_type FROM {_T}")
def l9_chunk_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.ladder(F.col("text"), FIXTURE_TYPES, "general").alias("chunk_type"))


@query(f"SELECT doc_id, {ladder_sql(FIXTURE_DOCUMENTS, 'general_document')} AS document_type FROM {_T}")
def l10_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.ladder(F.col("text"), FIXTURE_DOCUMENTS, "general_document").alias("document_type"))


MOVES = ("hand", "near")
COHERENCE_SQL = f"""CASE WHEN len(p) < 2 THEN 0.5::DOUBLE WHEN list_min(list_transform(p, lambda s: len({words_sql("s")}))) < 5 THEN 0.4::DOUBLE WHEN {L.any_sql(MOVES)} THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END"""


@query(f"SELECT doc_id, {COHERENCE_SQL} AS coherence FROM (SELECT doc_id, lower(text) AS t, list_filter(string_split(text, '.'), lambda s: trim(s) <> '' AND len({words_sql('s')}) > 0) AS p FROM documents)")
def l11_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.coherence(F.regexp_replace("text", r"\s+", " "), MOVES).alias("coherence"))


COMPLETE_SQL = "((CASE WHEN regexp_matches(c, '[.!?]$') THEN 1.0::DOUBLE WHEN suffix(c, ',') THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) + CASE WHEN contains(text, 'e.g.') OR contains(text, 'i.e.') OR contains(text, 'etc.') OR contains(text, '...') OR contains(text, '•') OR contains(text, '- ') THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END) / 2"


@query(rf"SELECT doc_id, round({COMPLETE_SQL}, 6) AS completeness FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM documents)")
def l12_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(S.completeness(F.col("text")), 6).alias("completeness"))


@query(f"SELECT doc_id, CASE WHEN len({SENTENCES_SQL}) < 2 OR NOT {L.any_sql(MOVES, 'lower(text)')} THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS score FROM documents")
def l13_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.semantic(F.col("text"), MOVES).alias("score"))


FIXTURE_PRONOUNS = ("the", "la", "der", "it")


@query(f"SELECT doc_id, round(CASE WHEN len(s) < 2 THEN 0.3::DOUBLE ELSE len(list_filter(s, lambda x: list_has_any({words_sql('lower(x)')}, ['the', 'la', 'der', 'it']))) / len(s) END, 6) AS coherence FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def l14_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(S.pronoun_coherence(F.col("text"), FIXTURE_PRONOUNS), 6).alias("coherence"))


_WORD = re.compile("[^ \t\n\x0b\f\r]+")


def key_terms(docs: DataFrame, k: int = 5, stop: tuple[str, ...] = S.STOPWORDS, id_column: str = "doc_id") -> DataFrame:
    """The k most frequent words over 3 characters that aren't stopwords; ties go to the one seen first.

    A row is counted where it is, if no other has its id; of rows that share one the words are shuffled.
    """
    left_out = set(stop)

    def counted(text: str | None) -> list[dict]:
        # counts keep the order of the first place, and so does the sort
        n = Counter(w for w in _WORD.findall(text or "") if len(w) > 3 and w not in left_out)
        return [{"rank": i, "term": w, "n": c} for i, (w, c) in enumerate(heapq.nsmallest(k, n.items(), key=lambda x: -x[1]), 1)]

    @F.pandas_udf("array<struct<rank:int,term:string,n:long>>")
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(counted)

    again = written(docs.groupBy(F.col(id_column).alias("_id")).count().where("count > 1").select("_id"), "again")
    if not again.limit(1).count():
        return docs.select(id_column, F.inline(best(F.lower("text"))))
    shared = F.col(id_column).eqNullSafe(F.col("_id"))
    alone = docs.join(again, shared, "left_anti").select(id_column, F.inline(best(F.lower("text"))))
    w = docs.join(again, shared, "left_semi").select(id_column, F.posexplode(T.words(F.lower("text"))).alias("pos", "term")).where((F.length("term") > 3) & ~F.col("term").isin(*stop))
    c = w.groupBy(id_column, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("n"), "first"))
    return alone.unionByName(c.withColumn("rank", rank).where(F.col("rank") <= k).select(id_column, "rank", "term", "n"))


KEY_TERMS_SQL = f"""WITH w AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {words_sql("lower(text)")} AS w FROM documents)),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS f FROM w WHERE length(term) > 3 AND term NOT IN ({", ".join(f"'{s}'" for s in S.STOPWORDS)}) GROUP BY ALL),
r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS INTEGER) AS rank, term, n FROM c)"""


@query(f"{KEY_TERMS_SQL} SELECT doc_id, rank, term, n FROM r WHERE rank <= 5")
def l15_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_terms(_docs(spark, sf_dir))


SECTION_SQL = "CASE WHEN kind IN ('methods', 'approach') THEN 'Methods and Approach' WHEN kind = 'background' THEN 'Background and Significance' WHEN kind = 'innovation' THEN 'Innovation' WHEN kind = 'results' THEN 'Evaluation and Outcomes' WHEN contains(t, 'implementation') THEN 'Implementation Plan' WHEN contains(t, 'budget') THEN 'Budget Justification' END"
_BUCKET_SQL = f"CASE WHEN kind = 'methods' OR {L.any_sql(['approach', 'method'])} THEN 'methods_approach' WHEN kind = 'background' THEN 'background_significance' WHEN kind = 'innovation' OR contains(t, 'innovative') THEN 'innovation' WHEN kind = 'results' OR {L.any_sql(['outcome', 'result'])} THEN 'evaluation_outcomes' WHEN {L.any_sql(['implement', 'plan', 'schedule', 'timeline'])} THEN 'implementation_plan' WHEN {L.any_sql(['cost', 'resource', 'budget', 'funding'])} THEN 'budget_justification' ELSE 'methods_approach' END"
_KIND_SQL = f"(SELECT *, {CHUNK_TYPE_SQL} AS kind FROM {_T})"


@query(f"SELECT lang, {_BUCKET_SQL} AS bucket, count(*) AS n, min(doc_id) AS first_doc FROM {_KIND_SQL} GROUP BY ALL")
def l16_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("kind", S.ladder(F.col("text"), FIXTURE_TYPES, "general"))
    return d.groupBy("lang", S.bucket(F.col("kind"), F.col("text")).alias("bucket")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT DISTINCT source, CASE WHEN kind IN ('methods', 'approach') THEN 'Methods and Approach' WHEN kind = 'background' THEN 'Background and Significance' WHEN kind = 'innovation' THEN 'Innovation' WHEN kind = 'results' THEN 'Evaluation and Outcomes' END AS section FROM {_KIND_SQL} WHERE kind IN ('methods', 'background', 'innovation', 'results')")
def l17_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("kind", S.ladder(F.col("text"), FIXTURE_TYPES, "general"))
    return d.select("source", S.suggested_section(F.col("kind"), F.col("text")).alias("section")).where("section is not null").distinct()


COVERED_SQL = f"""WITH q AS (SELECT item_id, {labels_sql(L.TOPICS)} AS qt FROM (SELECT *, lower(text) AS t FROM benchmark)), c AS (SELECT doc_id, {labels_sql(L.TOPICS)} AS ct FROM {_T}),
cov AS (SELECT item_id, doc_id, CASE WHEN len(qt) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(qt, ct)) / len(qt) END AS coverage FROM q, c)"""


def covered(spark: SparkSession, sf_dir: str, least: float = 0.3) -> DataFrame:
    """(item_id, doc_id, coverage) of the documents that have enough of an item's topics, one at least."""
    topics = lambda d, key: d.select(key, F.explode(F.array_distinct(L.labels_of(L.lowered(F.col("text")), L.TOPICS))).alias("topic"))
    q = topics(table(spark, sf_dir, "benchmark"), "item_id")
    q = q.join(q.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")
    met = q.join(topics(_docs(spark, sf_dir), "doc_id"), "topic").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("coverage"))
    return met.where(F.col("coverage") >= least)


@query(f"{COVERED_SQL} SELECT item_id, doc_id, round(coverage, 6) AS coverage FROM cov WHERE coverage >= 0.3")
def l19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))

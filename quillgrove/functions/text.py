"""Text scalars: cleaning, splitting, counting and field extraction, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
QUOTES = {"’": "'", "``": '"', "''": '"'}
#: Pieces of the patterns below: white space, a number, white space or not, white space at least once.
W, N = r"\p{Space}", "[0-9]+"
Ws, W1 = f"{W}*", f"{W}+"
EMAIL, URL = r"(?<!\S)\S+@\S+\.\S+", r"https?://\S+"
_GAP = f"(?:[.-]|{W})?"
PHONE = f"[(]?[0-9]{{3}}[)]?{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}"
BOILERPLATE = tuple(f"(?i){p}" for p in (f"(?:NOT|RFA)-[A-Z]+-{N}-{N}", f"PA-{N}-{N}", f"Page {N} of {N}", f"OMB No[.] {N}-{N}", "Expiration Date:.*"))


def some(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def replaced(text: Column, pairs: Mapping[str, str]) -> Column:
    for a, b in pairs.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def normalize(text: Column) -> Column:
    """White space to single blanks, none at the ends; null to ''."""
    return F.trim(F.regexp_replace(some(text), r"\s+", " "))


def clean_abstract(text: Column) -> Column:
    """Single blanks, then leading headings off: a blank in front of one keeps it."""
    t = F.regexp_replace(some(text), r"\s+", " ")
    return F.trim(without(t, r"(?i)^PROJECT SUMMARY/ABSTRACT", r"(?i)^ABSTRACT\s*:?", r"(?i)^NARRATIVE\s*:?"))


def page_lines(text: Column) -> Column:
    """The lines of a page without page numbers and scraps under 3 characters."""

    def good(x: Column) -> Column:
        t = F.trim(x)
        return ~t.rlike(r"^\d+$") & ((F.length(t) >= 3) | t.isin(".", "-", "–"))

    return F.filter(F.split(some(text), "\n", -1), good)


def clean_page(text: Column) -> Column:
    """A page without scraps, hyphenated breaks, runs of blank lines and form boilerplate."""

    def join(done: Column, line: Column) -> Column:
        broken = (F.size(done) > 0) & F.endswith(F.element_at(done, -1), F.lit("-"))
        mended = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.regexp_replace(F.element_at(done, -1), "-$", ""), F.trim(line))))
        return F.when(broken, mended).otherwise(F.concat(done, F.array(line)))

    lines = F.aggregate(page_lines(text), F.array().cast("array<string>"), join)
    t = F.regexp_replace(F.array_join(lines, "\n"), "\n\n\n+", "\n\n")
    t = F.replace(F.regexp_replace(t, "[ \t][ \t]+", " "), F.lit("\f"), F.lit("\n\n"))
    forms = (f"PHS{W1}[0-9]{{3,}}{Ws}[(]Rev[.]{Ws}[0-9/]+[)]", f"OMB{W1}No[.]{Ws}[0-9-]+", f"Continuation{W1}Format{W1}Page", f"Page{W1}{N}{W1}of{W1}{N}")
    return F.trim(without(t, *[f"(?i){p}" for p in forms]))


def clean_ocr(text: Column) -> Column:
    """Blank-line runs, two ligatures, page numbers and blank runs."""
    t = F.regexp_replace(some(text), r"\n\s*\n\s*\n+", "\n\n")
    t = replaced(t, {"ﬁ": "fi", "ﬂ": "fl"})
    t = F.regexp_replace(F.regexp_replace(t, r"-\s*\d+\s*-", ""), r"\n\d+\n", "\n")
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def scrub(text: Column) -> Column:
    """Emails, web addresses and phone numbers taken out, in this order."""
    return without(some(text), EMAIL, URL, PHONE)


def requirements_section(text: Column) -> Column:
    """From the first heading of requirements or work to what ends them; null if there is none."""
    found = [F.regexp_extract(some(text), rf"(?is)({start}.*?)(?=DELIVERABLES|QUALIFICATIONS|SUBMISSION|$)", 1) for start in ("REQUIREMENTS?", "SCOPE OF WORK", "STATEMENT OF WORK")]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in found])


def clean_by_type(text: Column, kind: Column) -> Column:
    """The cleaning for the type of document: grants, calls, abstracts, all else."""
    t = some(text)
    name = "[A-Z][a-z]+"
    abstract = F.trim(without(t, f"(?i)^(?:BACKGROUND|SUMMARY|ABSTRACT){Ws}:?{Ws}", f"^{name} [A-Z][.] {name},? (?:et al[.]?,? )?"))
    return F.when(kind == "nih_grant", without(t, *BOILERPLATE)).when(kind == "rfp", F.coalesce(requirements_section(t), scrub(t))).when(kind == "research_abstract", abstract).otherwise(scrub(t))


def keep_structure(text: Column) -> Column:
    """Newline runs to one blank line, bullets and numbers of lists in one form."""
    t = F.regexp_replace(some(text), r"\n\s*\n\s*\n+", "\n\n")
    t = F.regexp_replace(t, r"(?m)^\s*[\-\*•]\s+", "• ")
    return F.regexp_replace(t, r"(?m)^\s*\d+\.\s+", "1. ")


def remove_noise(text: Column) -> Column:
    """Blank runs, ligatures and quotes; characters other than words and punctuation to blanks."""
    t = replaced(F.regexp_replace(some(text), r"[ \t]+", " "), LIGATURES | QUOTES)
    return F.trim(F.regexp_replace(t, r"""(?U)[^\w\s.,;:!?'"()\[\]{}<>-]""", " "))


def preprocess(text: Column, kind: Column) -> Column:
    return remove_noise(keep_structure(clean_by_type(text, kind)))


def words(text: Column) -> Column:
    """Array of the runs between white space."""
    return F.filter(F.split(some(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    t = F.regexp_replace(some(text), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def sentences(text: Column) -> Column:
    """Split at white space after . ! or ?; blank ones are dropped."""
    return F.filter(F.transform(F.split(some(text), f"(?<=[?!.]){W1}"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column, delimiter: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(some(text), delimiter), lambda p: F.trim(p)), lambda p: p != "")


GRANT = r"\b([A-Z][0-9][0-9][A-Z][A-Z][0-9]{6}(?:-[0-9][0-9][A-Z]?)?)\b"


def fields(name: Column, text: Column, codes: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Grant number, institute code, year and title: from the name first, then from the text's first 2000 characters (a rule of the format, not a limit of ours)."""
    head = F.substring(some(text), 1, 2000)
    empty = F.lit("")
    number = F.coalesce(F.nullif(F.regexp_extract(some(name), GRANT, 1), empty), F.nullif(F.regexp_extract(head, GRANT, 1), empty))
    code = F.substring(number, 4, 2)
    named = F.create_map(*[F.lit(x) for p in (codes or {"": ""}).items() for x in p])
    own = F.regexp_extract(some(name), r"\b(20\d{2})\b", 1)
    found = F.regexp_extract(head, r"\b(20\d{2})\b", 1)
    year = F.coalesce(F.nullif(own, empty).cast("int"), F.when(F.nullif(found, empty).cast("int").between(2000, 2030), found.cast("int")))
    title = F.nullif(F.trim(F.regexp_extract(head, f"(?i)(?:Project{W1})?Title(?::|{W})+([^\n]{{10,150}})", 1)), empty)
    return {"grant_number": number, "institute": F.coalesce(F.try_element_at(named, code), code), "year": year, "title": title}


def resolve(df: DataFrame, candidates: Sequence[str], default: object = None) -> Column:
    """The first of the candidate columns that df has; the default if it has none."""
    for c in candidates:
        if c in df.columns:
            return F.col(f"`{c}`")
    return F.lit(default)


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank, '' if all are."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns], F.lit(""))


def abstract_of(sections: Column, text: Column, names: Sequence[str] = ("project_summary", "abstract", "specific_aims", "preamble"), least: int = 50, most: int = 500) -> Column:
    """The first 500 words of the first of these sections that has 50, else of the text."""
    body = F.coalesce(*[F.when(F.size(words(F.try_element_at(sections, F.lit(n)))) >= least, F.try_element_at(sections, F.lit(n))) for n in names], some(text))
    return F.array_join(F.slice(words(body), 1, most), " ")


def per_page(text: Column, pages: Column) -> Column:
    return F.length(some(text)) / F.greatest(pages, F.lit(1))


def extraction_quality(text: Column, pages: Column) -> Column:
    """high, medium, low or failed, by characters a page."""
    rate = per_page(text, pages)
    return F.when((some(text) == "") | (pages == 0), "failed").when(rate >= 800, "high").when(rate >= 300, "medium").when(rate >= 100, "low").otherwise("failed")


def poor_extraction(text: Column, pages: Column) -> Column:
    foreign = F.length(F.regexp_replace(some(text), r"[\x00-\x7F]", "")) / F.greatest(F.length(some(text)), F.lit(1))
    return (some(text) == "") | (pages == 0) | (per_page(text, pages) < 100) | (foreign > 0.15)


def quality_rank(quality: Column) -> Column:
    return F.when(quality == "high", 3).when(quality == "medium", 2).when(quality == "low", 1).otherwise(0)


def _until(start: str, gap: str, *stops: str) -> str:
    """From what follows start to the first of stops, or the end."""
    return f"(?is){start}{gap}(.+?)(?={'|'.join([*stops, '$'])})"


_MUST, _SHOULD, _WILL = (f"{who}s? {verb}" for who, verb in (("Applicant", "must"), ("Proposal", "should"), ("Project", "will")))
REQUIREMENTS = (
    _until("Requirements?:?", Ws, "Requirements?", "Qualifications", "Deliverables"),
    *[_until(p, Ws, "[.]", p) for p in (_MUST, _SHOULD, _WILL)],
    _until(f"Key{W1}(?:Elements|Components):?", Ws, "Key"),
)


def requirements(text: Column, patterns: Sequence[str] = REQUIREMENTS, most: int = 10) -> Column:
    """Array of requirements that the patterns find; without any, the sentences of more than five words. The first ten."""
    found = F.concat(*[F.regexp_extract_all(some(text), F.lit(p), F.lit(1)) for p in patterns])
    found = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    plain = F.filter(sentences(text), lambda s: F.size(words(s)) > 5)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(plain), 1, most)


def filled_template(template: Column, values: Mapping[str, Sequence[str]], key: Column) -> Column:
    """Placeholders {name} of a template replaced by one of their values each, picked by the key's hash."""
    for i, (name, choices) in enumerate(values.items()):
        pick = F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{i}"))), 1, 8), 16, 10).cast("long"), F.lit(len(choices))).cast("int")
        template = F.replace(template, F.lit("{" + name + "}"), F.get(F.array(*[F.lit(c) for c in choices]), pick))
    return template

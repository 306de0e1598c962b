"""Secret scans by dictionary-primed zstandard novelty.

A candidate is a value assigned to a sensitive word such as "token" or "password" (quoted or not), a
long run of key characters after such a word or with the prefix of a known key format, or the body of
a private key block. Its novelty is what it adds to the compressed size of the text around it, where
the compressor is primed with a dictionary of code identifiers and common words, and its own other
occurrences nearby are blanked. Words and identifiers add a few bits a character; a random string adds
as many as its alphabet has or more, and is reported. The compressor counts whole bytes and long
matches, too coarse for values that are short or have other characters than keys: those must be novel
by a model of character pairs, too, in which words of the dictionary or nearby cost next to nothing.
Scanning is a map over the documents; texts without any sensitive word never leave the JVM.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common

_WORDS = "api[ _-]?key|access[ _-]?key|secret|token|passw(?:or)?d|passphrase|pwd|auth|bearer|credential|private[ _-]?key|client[ _-]?id|signature"
_PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abpr]-|AIza|eyJ|npm_|hf_|SG\\."
#: Texts that may have a secret; the same for Java and Python.
SENSITIVE = f"(?i:{_WORDS})|{_PREFIXES}|-----BEGIN|://[^\\s/:@]{{0,256}}:[^\\s/@]{{1,512}}@"
#: Each text that SENSITIVE finds has one of these in lower case; they are quicker to look for.
STEMS = ("key", "secret", "token", "passw", "passphrase", "pwd", "auth", "bearer", "credential", "client", "signature", "akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xox", "aiza", "eyj", "npm_", "hf_", "sg.", "-----begin", "://")
_SCHEME = "(?:(?i:basic|bearer|digest|negotiate|token|api-?key)\\s{1,3})?"
CONTEXT = re.compile(f"(?i:{_WORDS})(?i:[a-z0-9_-]{{0,64}})[\"'`]?\\s{{0,3}}(?:[:=]>?|is|\\s)\\s{{0,3}}[\"'`]?{_SCHEME}$")
#: A value that is assigned to a sensitive word: quoted, or up to the next blank.
ASSIGNED = re.compile(f"(?i:{_WORDS})(?i:[a-z0-9_-]{{0,64}})[\"'`]?\\s{{0,3}}[:=]>?\\s{{0,3}}(?=([\"'`]){_SCHEME}((?:(?!\\1)[^\\\\\n]|\\\\.){{1,512}})\\1|{_SCHEME}([^\\s\"'`]\\S{{0,511}}))")
#: The body of a private key block, up to its end or the last line of key characters; line breaks may be escaped.
_GAP = r"(?:\\[rn]|\\(?![rn])|[\s\"',>#*|]|(?<=[\"'\s])[+.](?=\s))"
BLOCK = re.compile(rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----{_GAP}*(?:[A-Z][A-Za-z-]+: [^\n\\]*{_GAP}+)*((?:[A-Za-z0-9+/=]+{_GAP}+(?=[A-Za-z0-9+/=]{{16,}}|=|[A-Za-z0-9+/]{{2,}}={{1,2}}(?![A-Za-z0-9])|[A-Za-z0-9+/]+=*{_GAP}*-----END))*[A-Za-z0-9+/=]+)")
#: The password of a web address.
ADDRESS = re.compile(r"(?i:[a-z][a-z0-9+.-]{0,30})://[^\s/:@]{0,256}:([^\s/@]{1,512})@")
PREFIX = re.compile(f"(?:{_PREFIXES})")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_.-]{12,}={0,2}")
#: Characters before a candidate in which its word may stand.
NAMES = 160
FOUND = "doc_id long, start_char int, end_char int, kind string, n_chars int, marginal_bytes int, bytes_per_char double"

IDENTIFIERS = """
def class return import from self None True False lambda yield async await public private protected static void int long double float
String string boolean const let var function new this null undefined true false if else elif while for switch case break continue
try catch finally except raise throw throws package interface extends implements struct enum namespace template typename include define
print println printf format append extend insert remove delete update select where group order limit offset index value values key keys
items length size count total number name names user users username email address password token secret apiKey api_key access_key
client_id client_secret accessToken refresh_token session request response header headers content type application json text html
http https www com org net example localhost server client host port path file filename directory config configuration settings
environment variable default option options argument arguments parameter parameters callback handler listener event message error
exception warning debug info logger logging level timestamp datetime date time second minute hour create read write open close
connect disconnect database table column query cursor transaction commit rollback getElementById addEventListener
toString valueOf hashCode equals getInstance setValue getValue isEmpty substring indexOf replace split join trim
your_api_key_here changeme placeholder xxxxxxxx 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
the of and to in is that for it as was with be by on not he his but at are this have from which or had they you were their one all
""".encode()


#: What is assigned where no secret is, for the model of character pairs.
FORMS = """
= None, = null; = true = false = "" = '' = [] = {} = () = self.x = this.x, = f(x) = x[0] = x[i], = x.get("y") = x['y'] = os.environ["X"]
= $X = ${X} = <x> = {{ x }} = %(x)s = %s = [x] = x(); = x() = new X() = &x = *x = x->y = @x = x|y = Optional[str] = Dict[str, int]
required optional string integer number boolean undefined disabled enabled hidden redacted removed unknown missing invalid expired valid
basic bearer digest oauth default example sample manager provider parser service getenv environ process secrets vault settings none
jwt jws sha1 sha256 sha512 md5 hs256 rs256 es256 base64 utf8 uuid4 i+1 n-1 x+y
"""


@lru_cache(maxsize=2)
def _compressor(words: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=9)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False)


def novelty(text: str, start: int, end: int, around: int, words: bytes = IDENTIFIERS) -> int:
    """Bytes that text[start:end] adds to what stands around it."""
    own = text[start:end]
    before = text[max(0, start - around) : start].replace(own, " ")
    after = text[end : end + around].replace(own, " ")
    c = _compressor(words)
    rest = (after + "\n" + before).encode("utf-8", "surrogatepass")
    return len(c.compress(rest + own.encode("utf-8", "surrogatepass"))) - len(c.compress(rest))


def alphabet_bytes(own: str) -> float:
    """Bytes a character of a random string over the kinds of characters that this one has."""
    if re.fullmatch("[0-9]+", own):
        n = 10
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", own):
        n = 16
    else:
        n = sum(k for k, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (4, "[^a-zA-Z0-9]")) if re.search(p, own))
    return math.log2(n) / 8


@lru_cache(maxsize=2)
def _pairs(words: str) -> tuple[Counter, Counter]:
    return Counter(words), Counter(zip(words, words[1:]))


#: Words of identifiers, without and with a number at their end.
_PARTS = (re.compile("[A-Z]?[a-z]{2,}|[A-Z]{2,}"), re.compile("(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})[0-9]+"))


@lru_cache(maxsize=2)
def _parts(words: str) -> frozenset[str]:
    return frozenset(x.lower() for part in _PARTS for x in part.findall(words))


def novel_bits(text: str, start: int, end: int, around: int, words: str = IDENTIFIERS.decode() + FORMS) -> float:
    """Bits of text[start:end] by the character pairs of the dictionary and of what stands around; a bit a character for words of these."""
    own = text[start:end]
    near = text[max(0, start - around) : start].replace(own, " ") + "\n" + text[end : end + around].replace(own, " ")
    (one, two), (one_, two_) = _pairs(words), (Counter(near), Counter(zip(near, near[1:])))
    known, known_ = _parts(words), {x.lower() for part in _PARTS for x in part.findall(near)}
    n = len(words) + len(near)
    free = {i for part in _PARTS for m in part.finditer(own) if m.group().lower() in known or m.group().lower() in known_ for i in range(*m.span())}
    bits = 0.0
    for i, (x, y) in enumerate(zip(" " + own, own)):
        if i in free:
            bits += 1
        else:
            p = (one[y] + one_[y] + 1) / (n + 128)
            bits -= math.log2((two[x, y] + two_[x, y] + 4 * p) / (one[x] + one_[x] + 4))
    return bits


def _random_bits(own: str) -> float:
    """Bits a character of a random string over the kinds of characters that this one has, any punctuation one kind."""
    if re.fullmatch("[0-9]+", own):
        return math.log2(10)
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", own):
        return 4.0
    return math.log2(sum(k for k, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (32, "[^a-zA-Z0-9]")) if re.search(p, own)))


def _block(text: str, a: int, b: int, around: int) -> tuple[int, float]:
    """What the lines of a key block add to the text outside of it, each by itself, and what random ones would."""
    more, random = 0, 0.0
    head = text.rindex("-----BEGIN", 0, a)
    before, after = text[max(0, head - around) : head], text[b : b + around]
    for m in re.finditer("[A-Za-z0-9+/=]+", text[a:b].replace("\\n", "\n\n").replace("\\r", "\n\n")):
        for at in range(0, len(m.group()), 64):
            own = m.group()[at : at + 64]
            more += novelty(before + own + after, len(before), len(before) + len(own), around)
            random += alphabet_bytes(own) * len(own)
    return more, random


def _value(m: re.Match) -> tuple[int, int]:
    """The value of a match of ASSIGNED, without what closes the phrase around an unquoted one."""
    if m.group(2) is not None:
        return m.span(2)
    a, b = m.span(3)
    own = m.group(3)
    cut = re.search("&(?=[A-Za-z_][A-Za-z0-9_.-]*=)|</|[\"'`]", own)
    own = own[: cut.start()] if cut else own
    return a, a + len(own.rstrip(".,;:)]}>"))


def find(text: str, around: int, least: float) -> list[tuple[int, int, str, int, float]]:
    """(start, end, kind, marginal bytes, bytes a character) of the secrets of a text."""
    out = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b, 0)) - 1
        return i < 0 or taken[i][1] <= a

    for m in BLOCK.finditer(text):
        a, b = m.span(1)
        # a header without a key behind it is just named
        if len(re.findall("[A-Za-z0-9+/=]", m.group(1))) < 24:
            continue
        more, random = _block(text, a, b, around)
        if more >= least * random:
            out.append((a, b, "private key", more, more / (b - a)))
            insort(taken, (a, b))
    for m in ADDRESS.finditer(text):
        a, b = m.span(1)
        own = m.group(1)
        if not re.search("[A-Za-z0-9]", own) or novel_bits(text, a, b, around) < least * _random_bits(own) * len(own) + 8:
            continue
        more = novelty(text, a, b, around)
        if more >= least * alphabet_bytes(own) * (b - a):
            out.append((a, b, "url", more, more / (b - a)))
            insort(taken, (a, b))
    for m in ASSIGNED.finditer(text):
        a, b = _value(m)
        own = text[a:b]
        # what is long and of key characters is judged below; short numbers are counts and times unless called a password
        if CANDIDATE.fullmatch(text, a, b) or not re.search("[A-Za-z0-9]", own) or not free(a, b):
            continue
        if re.fullmatch("[0-9.,]{1,5}", own) and not re.match("(?i:passw|passphrase|pwd)", m.group()):
            continue
        # a byte beyond the random string, as one rare pair makes no secret
        if novel_bits(text, a, b, around) < least * _random_bits(own) * len(own) + 8:
            continue
        more = novelty(text, a, b, around)
        if more >= least * alphabet_bytes(own) * (b - a):
            known = PREFIX.match(own)
            kind = known.group().strip("_-.").lower() if known else re.match(f"(?i:{_WORDS})", m.group()).group().lower()
            out.append((a, b, kind, more, more / (b - a)))
            insort(taken, (a, b))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-/":
            b -= 1
        if not free(a, b):
            continue
        known = PREFIX.match(text, a, b)
        context = CONTEXT.search(text[max(0, a - NAMES) : a])
        if b - a < 12 or not (known or context):
            continue
        more = novelty(text, a, b, around)
        if more >= least * alphabet_bytes(text[a:b]) * (b - a):
            kind = known.group().strip("_-.").lower() if known else re.match(f"(?i:{_WORDS})", context.group()).group().lower()
            out.append((a, b, kind, more, more / (b - a)))
    return sorted(out)


def secrets(docs: DataFrame, around: int = 400, least: float = 1.0) -> DataFrame:
    """The secrets of each text by position and novelty; the strings themselves are left out.

    A name may have 64 more characters behind its sensitive word; an assigned value that isn't
    key-like may have 512, key-like ones and key blocks any number. Texts of any length are scanned
    whole, and overlapping candidates count once, key blocks first.

    ``around`` characters on either side are what a candidate is measured against; it is reported
    if it adds at least ``least`` times the bytes of a random string of its alphabet. Null and empty texts and rows without doc_id have
    none; repeated rows come out as often as they went in. Extra columns are ignored; an empty table
    gives an empty result.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, a, b, kind, b - a, more, rate) for doc, text in zip(batch["_id"].tolist(), batch["_text"].tolist()) for a, b, kind, more, rate in find(text, around, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char", "kind", "n_chars", "marginal_bytes", "bytes_per_char"])

    some = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    stem = F.transform(F.array(F.lower("_text")), lambda t: reduce(Column.__or__, [t.contains(x) for x in STEMS]))[0]
    some = some.where(F.col("_id").isNotNull() & stem & F.col("_text").rlike(SENSITIVE))
    return some.mapInPandas(scan, FOUND)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents; odd rows as in secrets."""
    return secrets(common.read(spark, sf_dir, "documents"))

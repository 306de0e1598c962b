"""Toxicity by maximum-scoring segments.

Three steps:

1. fit: log-odds of words and word beginnings between toxic and clean labelled documents, each
   smoothed by a Dirichlet (for two classes: Beta) prior whose mean is the next shorter beginning.
   It takes a bounded number of labelled documents of either class, chosen by hash; near copies
   among them (a shared min-hash) count once, so that a much copied document makes no vocabulary.
2. calibrate: over the clean ones of these, Karlin and Altschul's lambda (the root of
   sum p(s) exp(lambda s) = 1) and K (its maximum-likelihood value from the best segment of each
   document) by language; a language with few clean rows takes the values of all.
3. scan: Ruzzo and Tompa's linear-time algorithm finds all maximal segments of each whole text. The
   normalised scores lambda S - ln(K n) of a document's best segments are summed, and the sum
   statistic of extreme values gives the document's p-value.

Step 3 is a map over the documents: nothing is shuffled, and the model is of bounded size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.llm import common

WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that count as tokens too; the shortest is the root's child.
STEMS = (4, 5, 6, 7)
PASSAGES = "doc_id long, passage int, start_char int, end_char int, n_words int, score double, evalue double, doc_pvalue double"


@dataclass
class Model:
    """Log-odds of words ("idiot") and beginnings ("idio*"), 0 where they tell nothing though a shorter one does; the cost of any other word, and calibration by language."""

    known: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    calibration: dict[str, tuple[float, float]] = field(default_factory=lambda: {"": (1.0, 1.0)})

    def lookup(self) -> "Scores":
        return Scores(self)


class Scores(dict):
    """Score of a word, kept after its first use; the longest beginning that was seen decides."""

    LIMIT = 1_000_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > self.LIMIT:
            self.clear()
        m = self.model
        s = m.known.get(word)
        for k in reversed(STEMS):
            if s is not None:
                break
            if len(word) > k:
                s = m.known.get(word[:k] + "*")
        self[word] = s = s if s is not None and s > 0 else -m.drift
        return s


def tokens(word: str) -> list[str]:
    """A word with its beginnings, shortest first."""
    return [word[:k] + "*" for k in STEMS if len(word) > k] + [word]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), end exclusive (Ruzzo and Tompa 1999).

    Scores of zero or less never open a segment, so only the positive ones are visited; their sums
    before and after come from one cumulative sum.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float]] = []
    for i in at.tolist():
        new = (i, i + 1, float(total[i]), float(total[i + 1]))
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def sum_pvalue(normal: list[float]) -> tuple[float, int]:
    """The least p-value over the r best normalised segment scores, each r at the price 2**-r, and that r."""
    best, r_best, total = 1.0, 0, 0.0
    for r, s in enumerate(sorted(normal, reverse=True), 1):
        total += s
        if total <= 0:
            break
        if r == 1:
            ln = math.log(2) + (-total if total > 30 else math.log(-math.expm1(-math.exp(-total))))
        else:
            ln = r * math.log(2) - total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        p = math.exp(min(0.0, ln))
        if p < best:
            best, r_best = p, r
    return best, r_best


def judge(text: str, lang: str, model: Model, scores: Scores) -> tuple[float, list[tuple[int, int, float, float]]]:
    """p-value of a text, and its segments (start, end, score, E-value), best first."""
    words = WORD.findall(common.lowered(text))
    if not words:
        return 1.0, []
    found = segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))
    if not found:
        return 1.0, []
    lam, k = model.calibration.get(lang) or model.calibration[""]
    base = math.log(max(k * len(words), 1e-12))
    found.sort(key=lambda x: (-x[2], x[0]))
    p, r = sum_pvalue([lam * s - base for _, _, s in found])
    return p, [(a, b, s, math.exp(min(50.0, base - lam * s))) for a, b, s in found]


def _minhashes(words: list[str], n: int = 4) -> list[int]:
    h = np.array([zlib.crc32(x.encode()) for x in {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}], dtype=np.uint64)
    return [int(((h * np.uint64(a) + np.uint64(b)) % np.uint64(4294967291)).min()) * n + i for i, (a, b) in enumerate([(2654435761, 97), (2246822519, 1299709), (3266489917, 15485863), (668265263, 32452843)][:n])]


def fit_rows(rows: pd.DataFrame, prior: float = 0.5, min_docs: int = 4, min_z: float = 3.5, min_calibration: int = 200) -> Model:
    """A model of labelled rows (text, lang, toxic)."""
    seen: set[int] = set()
    # words are split again where they are needed: as lists they would take more than all else
    docs: list[tuple[str, str, int]] = []
    for text, lang, toxic in zip(rows.text, rows.lang, rows.toxic):
        text = (text or "").lower()
        words = WORD.findall(text)
        if not words:
            continue
        own = _minhashes(words)
        if seen.isdisjoint(own):
            docs.append((text, lang or "", int(toxic)))
        seen.update(own)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for text, _, toxic in docs:
        n[toxic] += 1
        if toxic:
            counts[1].update({t for w in set(WORD.findall(text)) for t in tokens(w)})
    # of the clean documents, only what some toxic one has, too, matters at first
    for text, _, toxic in docs:
        if not toxic:
            counts[0].update({t for w in set(WORD.findall(text)) for t in tokens(w) if t in counts[1]})
    model = Model()
    if not n[0] or not n[1]:
        return model
    scale = 2 * n[0] * n[1] / (n[0] + n[1])
    theta: dict[str, float] = {}
    found: dict[str, float] = {}

    def weigh(word: str) -> None:
        mean = 0.5
        for t in tokens(word):
            if t not in theta:
                a, b = counts[1][t] * scale / n[1], counts[0][t] * scale / n[0]
                p = theta[t] = (a + prior * mean) / (a + b + prior)
                s = math.log(p / (1 - p))
                z = s / math.sqrt(1 / (a + prior * mean) + 1 / (b + prior))
                if counts[1][t] + counts[0][t] >= min_docs:
                    found[t] = s if s > 1.0 and z >= min_z else 0.0
            mean = min(0.9, max(0.1, theta[t]))

    for word in sorted(w for w in counts[1] if not w.endswith("*")):
        weigh(word)
    stems = {t for t, s in found.items() if s > 0 and t.endswith("*")}
    # then the words that only clean documents have, if a toxic beginning would catch them
    caught: set[str] = set()
    for text, _, toxic in docs:
        if not toxic:
            own = {w for w in set(WORD.findall(text)) if w not in counts[1] and any(w[:k] + "*" in stems for k in STEMS if len(w) > k)}
            counts[0].update({t for w in own for t in tokens(w) if t not in counts[1]})
            caught |= own
    for word in sorted(caught):
        weigh(word)
    model.known = {t: s for t, s in found.items() if s > 0 or any(t[:k] + "*" in stems for k in STEMS if len(t) > k)}
    scores = model.lookup()
    share = [np.mean([scores[w] > 0 for w in WORD.findall(text)]) for text, _, toxic in docs if toxic] or [0.0]
    model.drift = float(min(0.2, max(0.02, -math.log1p(-min(0.5, float(np.mean(share)))))))
    scores = model.lookup()
    best: dict[str, list[tuple[int, float]]] = {}
    spread: dict[str, Counter] = {}
    for text, lang, toxic in docs:
        if toxic:
            continue
        words = WORD.findall(text)
        s = np.fromiter(map(scores.__getitem__, words), float, len(words))
        top = max((x[2] for x in segments(s)), default=0.0)
        values = Counter(np.round(s, 2).tolist())
        for key in {"", lang}:
            best.setdefault(key, []).append((len(words), top))
            spread.setdefault(key, Counter()).update(values)
    for key, tops in best.items():
        if key and len(tops) < min_calibration:
            continue
        lam = _lambda(spread[key])
        model.calibration[key] = (lam, min(1.0, (len(tops) + 1) / (1 + sum(m * math.exp(-lam * s) for m, s in tops))))
    return model


def _lambda(values: Counter) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1; 1 where no score is positive, between 0.3 and 1 always."""
    n = sum(values.values())
    low, high = 0.3, 1.0
    excess = lambda lam: sum(c * math.exp(lam * s) for s, c in values.items()) / n - 1
    if max(values) <= 0 or excess(high) <= 0:
        return high
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) <= 0 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, fit_rows_per_class: int = 4000, fit_bytes_per_class: int = 48_000_000) -> Model:
    """Model from a bounded sample of labelled documents.

    ``fit_rows_per_class`` and ``fit_bytes_per_class`` bound the rows and the bytes of text of either
    class; they are those of the lowest hash of doc_id, whole texts, up to the first that would exceed the bytes. Labels that are null are left out; of repeated labels of a document the largest counts.
    Without labels of both classes the model knows no word, and nothing is toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = None
    for toxic in (0, 1):
        part = known.where(F.least(F.col("_toxic"), F.lit(1)) == toxic).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_id"), "text", "lang").where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "text", "lang", F.least(F.col("_toxic"), F.lit(1)).alias("toxic"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= fit_bytes_per_class).select("_id", "text", "lang", "toxic").toPandas()
    return fit_rows(rows.sort_values(["_id", "text"], kind="stable"))


def toxic_passages(docs: DataFrame, model: Model, alpha: float = 3e-3, max_evalue: float = 0.5) -> DataFrame:
    """The passages of toxic documents: those whose p-value is at most alpha.

    A row for each of a document's segments with an E-value up to max_evalue, and for its best one in
    any case, in order of score; positions are characters of the text. Texts of any length are scanned whole, ties go to the earlier segment. Null, empty
    and wordless texts have none; repeated rows of a document come out as often as they went in.
    Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        scores = m.lookup()
        for batch in batches:
            rows = []
            for doc, text, lang in zip(batch["_id"], batch["_text"], batch["_lang"]):
                p, found = judge(text, lang or "", m, scores)
                if p > alpha:
                    continue
                spans = [x.span() for x in WORD.finditer(common.lowered(text))]
                for i, (a, b, s, e) in enumerate(found):
                    if i == 0 or e <= max_evalue:
                        rows.append((doc, i, spans[a][0], spans[b - 1][1], b - a, s, e, p))
            yield pd.DataFrame(rows, columns=["doc_id", "passage", "start_char", "end_char", "n_words", "score", "evalue", "doc_pvalue"])

    some = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.coalesce(F.col("lang"), F.lit("")).alias("_lang"))
    return some.where(F.col("_id").isNotNull() & F.col("_text").isNotNull()).mapInPandas(scan, PASSAGES)


def drop_toxic(docs: DataFrame, model: Model, alpha: float = 3e-3) -> DataFrame:
    """docs without toxic documents, all columns kept, whatever their names; rows of null or empty text, and without doc_id, stay or go by their text.

    A document whose p-value is alpha goes, too. Repeated rows go or stay together; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = sent.value
        scores = m.lookup()
        for texts, langs in parts:
            yield pd.Series([judge(t, g, m, scores)[0] <= alpha for t, g in zip(texts, langs)], dtype=bool)

    return docs.where(~toxic(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic passages of all documents; odd rows as in toxic_passages and fit."""
    docs = common.read(spark, sf_dir, "documents")
    return toxic_passages(docs, fit(docs, common.read(spark, sf_dir, "labels")))

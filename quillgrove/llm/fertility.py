"""Quality rules from tokeniser fertility.

Two public vocabularies measure each text: a byte-level BPE for many languages gives characters per
token and the entropy of its tokens, a piece BPE with byte fallback gives the share of tokens that
are bare bytes. A text is rejected if a measure lies outside the band of its language and length: quartiles
over all texts of the language in that class of length, widened by ``spread`` times their distance.

Entropy is the mean over windows of 256 tokens, each as a share of the most that the window could
have, so that it doesn't depend on the length of a text. Measuring is a map; the bands are one
aggregation of a few numbers a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common

FOLDER = "/opt/tokenizers"
WINDOW = 256
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: How far a band reaches beyond the quartiles at least, by measure; and how many bands are broadcast, some 10 MB.
FLOORS, FEW = (0.5, 0.02, 0.06), 100_000
MEASURED = "doc_id long, lang string, n_tokens int, chars_per_token double, byte_share double, entropy double"


@lru_cache(maxsize=2)
def _tokenizers(folder: str):  # noqa: ANN202
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(f"{folder}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    piece = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    is_byte = np.array([piece.is_byte(i) for i in range(piece.get_piece_size())])
    return bpe, piece, is_byte


def entropy(ids: np.ndarray) -> float:
    """Mean entropy of windows of the tokens, as a share of the most possible; 1 for a single token."""
    n = len(ids)
    if n < 2:
        return 1.0
    windows = max(1, n // WINDOW)
    at = np.minimum(np.arange(n) // WINDOW, windows - 1)
    key = at.astype(np.int64) << 32 | ids
    key.sort()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(edge, n)).astype(float)
    window = key[edge] >> 32
    size = np.bincount(at, minlength=windows).astype(float)
    h = np.log2(size) - np.bincount(window, weights=count * np.log2(count), minlength=windows) / size
    return float((h / np.log2(size)).mean())


def measure(text: str, folder: str = FOLDER) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share and entropy of a text that isn't empty."""
    bpe, piece, is_byte = _tokenizers(folder)
    text = text.encode("utf-8", "replace").decode()
    ids = bpe.encode_to_numpy(text)
    pieces = np.asarray(piece.encode(text), dtype=np.int64)
    return len(ids), len(text) / max(1, len(ids)), float(is_byte[pieces].mean()) if len(pieces) else 0.0, entropy(ids.astype(np.int64))


def measured(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The measures of every text that has any character; language "" where it is null."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, lang, *measure(text, folder)) for doc, lang, text in zip(b["_id"].tolist(), b["_lang"].tolist(), b["_text"].tolist())]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "n_tokens", *MEASURES])

    some = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), F.col("text").alias("_text"))
    return some.where(F.col("_id").isNotNull() & (F.length("_text") > 0)).mapInPandas(scan, MEASURED)


def length_class(n: Column) -> Column:
    """0 for under 8 tokens, then by doublings up to 4, 64 and more."""
    return F.when(n < 8, 0).when(n < 16, 1).when(n < 32, 2).when(n < 64, 3).otherwise(4)


def bands(rows: DataFrame, spread: float = 4.0, floors: tuple[float, float, float] = FLOORS, least_rows: int = 30) -> DataFrame:
    """The least and most of each measure that is kept, for each language and class of length.

    Quartiles are over all its texts, widened by ``spread`` times their distance. No band reaches less
    far than its floor beyond the quartiles, as the texts of a language may all be alike; for short
    texts the floors are wider, by the root of how many fewer tokens than 64 the class has. A language
    with under ``least_rows`` texts of a class takes the quartiles of that class of all languages,
    the row of language null.
    """
    keyed = rows.select("lang", length_class(F.col("n_tokens")).alias("class"), *MEASURES)
    q = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(m) for m in MEASURES]
    own = keyed.groupBy("lang", "class").agg(F.count("*").alias("n"), *q).where(F.col("n") >= least_rows)
    both = own.unionByName(keyed.groupBy(F.lit(None).cast("string").alias("lang"), "class").agg(F.count("*").alias("n"), *q))
    out = [F.col("lang").alias("_lang"), F.col("class").alias("_class")]
    short = F.sqrt(64 / F.element_at(F.array(*[F.lit(x) for x in (4, 8, 16, 32, 64)]), F.col("class") + 1))
    for m, floor in zip(MEASURES, floors):
        wide = F.greatest(F.lit(floor) * short, F.lit(spread) * (F.get(m, F.lit(1)) - F.get(m, F.lit(0))))
        out += [(F.get(m, F.lit(0)) - wide).alias(f"{m}_least"), (F.get(m, F.lit(1)) + wide).alias(f"{m}_most")]
    return both.select(*out)


def kept(docs: DataFrame, folder: str = FOLDER, spread: float = 4.0, floors: tuple[float, float, float] = FLOORS, least_rows: int = 30) -> DataFrame:
    """The measures of the texts that are inside every band of their language and class of length.

    Texts of any length are measured whole; short ones are judged by bands of their own. Null and
    empty texts and rows without doc_id have no measure and no row; null languages are the language "".
    Repeated rows come out as often as they went in, and a measure on the edge of its band is inside.
    Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = common.written(measured(docs, folder), "measures")
    limits = common.written(bands(rows, spread, floors, least_rows), "bands")
    # five rows a language; were there very many, the join shuffles
    few = limits.count() <= FEW
    own, every = limits.where("_lang is not null"), limits.where("_lang is null").drop("_lang")
    at = length_class(F.col("n_tokens"))
    names = [f"{m}_{s}" for m in MEASURES for s in ("least", "most")]
    every = every.select(F.col("_class").alias("_all"), *[F.col(n).alias(f"{n}_all") for n in names])
    met = rows.join(F.broadcast(own) if few else own, (F.col("lang") == F.col("_lang")) & (at == F.col("_class")), "left").join(F.broadcast(every), at == F.col("_all"))
    ok = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(f"{m}_{s}", f"{m}_{s}_all") for s in ("least", "most"))
        # of few tokens, a share is uncertain
        room = F.lit(3.0) * F.sqrt((F.greatest(high, F.lit(0.0)) + 0.01) / F.col("n_tokens")) if m == "byte_share" else F.lit(0.0)
        ok = ok & F.col(m).between(low - room, high + room)
    return met.where(ok).select(*rows.columns)


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of all documents that are kept; odd rows as in kept."""
    return kept(common.read(spark, sf_dir, "documents"))

"""Text to vectors by an encoder of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    """What a model has to offer: a row of numbers for each text."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encoded(text: Column, load: Callable[[], Encoder], fallback: Callable[[], Encoder] | None = None, batch: int = 64) -> Column:
    """The vector of each text, at length 1; null for null texts.

    ``load`` makes the encoder once a task, on the worker; where it fails the fallback does. Texts go
    to it whole, ``batch`` at a time, in Arrow batches. A text of whose numbers all are 0 stays so.
    """

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            if fallback is None:
                raise
            model = fallback()
        for s in parts:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            some = s[s.notna()]
            for at in range(0, len(some), batch):
                own = some.iloc[at : at + batch]
                v = np.asarray(model.encode(own.tolist()), dtype=np.float64).reshape(len(own), -1)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0).astype(np.float32)
                for i, x in zip(own.index, v):
                    out.at[i] = x
            yield out

    return encode(text)


class Hashed:
    """An encoder without a model: counts of hashed words. For tests, and as a fallback."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dims))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                row[zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.dims] += 1
        return out

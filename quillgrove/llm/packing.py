"""Best-fit packing with swap-based local search.

Documents longer than a bin are cut into full bins and a rest. The pieces are spread over shards by
hash; each shard packs its own by best fit in decreasing order, then searches: from the emptiest
underfull bin on, it moves a piece into a fuller bin, exchanges one piece for a smaller one, or two
pieces for one smaller than both, whenever that fills the fuller bin further. Each step raises the
sum of squared fills, so the search ends, and emptied bins are gone. Only ids and lengths are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common

CAPACITY = 2048
PIECES_PER_SHARD = 20_000
PLACED = "doc_id long, piece int, n_tokens int, bin_id long, bin_start int"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices by best fit decreasing; a bit of ``gaps`` says that some bin has that much room."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = gaps >> s
        if fits:
            g = s + (fits & -fits).bit_length() - 1
            b = by_gap[g].pop()
            if not by_gap[g]:
                gaps &= ~(1 << g)
        else:
            g, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if g > s:
            by_gap[g - s].append(b)
            gaps |= 1 << (g - s)
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and swaps between underfull bins while the sum of squared fills grows; emptied bins are left out."""
    fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    live = np.flatnonzero(fill < capacity)
    if len(live) < 2:
        return bins
    item = np.concatenate([np.array(bins[b]) for b in live])
    size = sizes[item].astype(np.int64)
    home = np.repeat(np.arange(len(live)), [len(bins[b]) for b in live])
    load = fill[live]

    def step(a: int) -> bool:
        """One move or swap out of bin a into a bin at least as full; whether there was any."""
        mine = np.flatnonzero(home == a)
        own = size[mine]
        room = np.where((load > 0) & (load >= load[a]) & (load < capacity) & (np.arange(len(load)) != a), capacity - load, -1)
        top = int(room.max())
        if top <= 0:
            return False
        for i in mine[np.argsort(-own, kind="stable")].tolist():
            fits = room >= size[i]
            if fits.any():
                to = int(np.where(fits, room, capacity + 1).argmin())
                home[i] = to
                load[to] += size[i]
                load[a] -= size[i]
                return True
        space = room[home]
        other = np.flatnonzero(space > 0)
        if not len(other):
            return False
        order = np.argsort(size[other], kind="stable")
        theirs, left = size[other][order], space[other][order]
        gain, best = 0, None
        pairs = [(int(x), (int(mine[k]),)) for k, x in enumerate(own)]
        if len(own) > 1:
            j = np.argsort(-own, kind="stable")
            pairs += [(int(own[x] + own[y]), (int(mine[x]), int(mine[y]))) for n, x in enumerate(j.tolist()) for y in j[n + 1 :].tolist()]
        for total, out in pairs:
            low, high = np.searchsorted(theirs, total - top), np.searchsorted(theirs, total)
            if low == high:
                continue
            more = total - theirs[low:high]
            more = np.where(more <= left[low:high], more, 0)
            k = int(more.argmax())
            if more[k] > gain:
                gain, best = int(more[k]), (out, int(other[order[low + k]]))
        if best is None:
            return False
        out, back = best
        to = home[back]
        home[list(out)] = to
        home[back] = a
        load[to] += gain
        load[a] -= gain
        return True

    changed = True
    while changed:
        changed = False
        for a in np.argsort(load, kind="stable").tolist():
            while load[a] and step(a):
                changed = True
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(len(live) + 1))
    full = [bins[b] for b in np.flatnonzero(fill >= capacity)]
    return full + [item[order[x:y]].tolist() for x, y in zip(cuts, cuts[1:]) if y > x]


def pack(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_start): where each piece of each document goes.

    ``tokens`` is the length of a row, words between white space where it isn't given. Documents
    without tokens (null, empty and blank texts) take no place and have no row. Pieces of a document
    are numbered from 0; all but the last are full bins. Repeated rows are packed as often as they
    come; rows without doc_id are packed too. Ties go by length, doc_id and text hash, so the result
    doesn't depend on the order of rows. Texts of any length are counted whole. Extra columns are ignored, whatever their names; an empty table gives no row.
    """
    n = common.word_count(F.col("text")) if tokens is None else tokens
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(0)).alias("doc_id"), id_.isNull().alias("no_id"), F.xxhash64("text").alias("h"), n.cast("long").alias("n")).where("n > 0")
    rows = common.written(rows, "lengths")
    # full bins count too: they are written by the shards
    shards = max(1, math.ceil(rows.count() / pieces_per_shard))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "no_id", "doc_id", "h"], kind="stable")
        n = part["n"].to_numpy(dtype=np.int64)
        whole, rest = n // capacity, n % capacity
        count = whole + (rest > 0)
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        size = np.where(piece < whole[row], capacity, rest[row])
        bin_, start = np.empty(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        full = size == capacity
        bin_[full] = np.arange(full.sum())
        small = np.flatnonzero(~full)
        at = int(full.sum())
        for k, b in enumerate(local_search(best_fit(size[small], capacity), size[small], capacity)):
            own = small[b]
            bin_[own] = at + k
            start[own] = np.cumsum(size[own]) - size[own]
        ids = part["doc_id"].astype("Int64").mask(part["no_id"]).array
        return pd.DataFrame({"doc_id": ids[row], "piece": piece.astype(np.int32), "n_tokens": size.astype(np.int32), "bin_id": (int(part["shard"].iloc[0]) << 32) + bin_, "bin_start": start.astype(np.int32)})

    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(place, PLACED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all documents in bins of CAPACITY words; odd rows as in pack."""
    return pack(common.read(spark, sf_dir, "documents"))

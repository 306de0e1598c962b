"""Nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected to ``dims`` normal (2-stable) coordinates (SRS, Sun et al. 2014). A point at
true distance d lies at a projected distance whose square, over d squared, is chi-square with dims
degrees of freedom. Projected neighbours are verified in order of their distance; once the next one
lies so far out that a point at the k-th best true distance would have been met with probability
``stop``, the search ends.

The kd-tree's upper levels are fitted on a bounded sample of projected points, every point is sent
down them into a cell, and each cell's lower levels are built where it is searched. A query searches
its own cell first, which bounds its k-th distance; then it goes to those other cells that the
stopping test does not rule out, and is done in each as soon as the test holds.

Nothing grows with a hot cell: of equal vectors only the k + 1 least ids can be in any answer, and
the others are no points; a cell of more than ``BLOCK`` points is searched in blocks, and the queries
that ask for a block go to it in parts of at most about ``QUERIES``. A block is copied as often as it
has parts, so copies are in proportion to what is asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.llm import common

CELL, LEAF, QUERIES, BLOCK = 4096, 256, 8192, 100_000
#: The upper levels are fitted on so many points at most, and have so many of them in a cell at least.
SAMPLE, LEAST = 1 << 18, 64
PAIRS = "query_id long, neighbour_id long, d2 double"


def chi2_quantile(p: float, dims: int) -> float:
    """The p-quantile of chi-square with an even number of degrees of freedom."""
    low, high = 0.0, 40.0 + 10 * dims
    for _ in range(80):
        mid = (low + high) / 2
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= mid / 2 / i
            total += term
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * total < p else (low, mid)
    return high


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree, split at the median of the widest coordinate."""
    todo, out = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = p[rows]
        order = np.argsort(part[:, int(np.ptp(part, axis=0).argmax())], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - q[:, j, None], q[:, j, None] - high[None, :, j]), 0)
        out += gap * gap
    return out


def search(ids: np.ndarray, v: np.ndarray, p: np.ndarray, qids: np.ndarray, qv: np.ndarray, qp: np.ndarray, bound: np.ndarray, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k nearest points of each query within its bound, by exact distance and id, as (row of the query, row of the point, d2)."""
    leaves = _leaves(p)
    low, high = np.stack([p[x].min(0) for x in leaves]), np.stack([p[x].max(0) for x in leaves])
    near = _box_distance(qp, low, high)
    order = np.argsort(near, axis=1, kind="stable")
    norm, qnorm = (v * v).sum(1), (qv * qv).sum(1)
    best = np.full((len(qv), k), np.inf)
    best_at = np.full((len(qv), k), -1, dtype=np.int64)
    kth = bound.astype(np.float64).copy()
    slack = _slack(qp)
    # what a float32 distance may be off, by the sizes of both vectors
    off = (v.shape[1] + 8) * float(np.finfo(np.float32).eps) if len(v) else 0.0
    active = np.arange(len(qv))
    for rank in range(len(leaves)):
        leaf = order[active, rank]
        # the stopping test: a point at the k-th distance would have been met by now
        go = near[active, leaf] <= quantile * kth[active] + slack[active]
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by])) + 1
        for rows in np.split(by, cuts):
            points, mine = leaves[leaf[rows[0]]], active[rows]
            d = norm[points][None, :] + qnorm[mine][:, None] - 2 * (qv[mine] @ v[points].T)
            d[ids[points][None, :] == qids[mine][:, None]] = np.inf
            room = off * (qnorm[mine].astype(np.float64) + float(norm[points].max()))
            hit = np.flatnonzero((d <= (kth[mine] + room)[:, None]).any(1))
            if not len(hit):
                continue
            q, room, d = mine[hit], room[hit], d[hit]
            # as far as the k-th of the leaf itself or of before; both sides may be off
            far = np.minimum(kth[q], np.partition(d, k - 1, axis=1)[:, k - 1] + room if len(points) >= k else np.inf) + room
            row, col = np.nonzero((d <= far[:, None]) & np.isfinite(d))
            at = points[col]
            exact = _exact(qv, v, q[row], at)
            old_row, old_col = np.nonzero(best_at[q] >= 0)
            row, at, exact = np.concatenate([old_row, row]), np.concatenate([best_at[q[old_row], old_col], at]), np.concatenate([best[q[old_row], old_col], exact])
            first = np.lexsort((ids[at], exact, row))
            row, at, exact = row[first], at[first], exact[first]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            some = (place < k) & (exact <= bound[q[row]])
            row, at, exact, place = row[some], at[some], exact[some], place[some]
            best[q[row], place], best_at[q[row], place] = exact, at
            kth[q] = np.minimum(kth[q], best[q, k - 1])
    q, j = np.nonzero(best_at >= 0)
    return q, best_at[q, j], best[q, j]


def _exact(qv: np.ndarray, v: np.ndarray, q: np.ndarray, at: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Squared distances in double precision of the pairs of rows q and at."""
    return np.concatenate([((qv[q[i : i + block]].astype(np.float64) - v[at[i : i + block]].astype(np.float64)) ** 2).sum(1) for i in range(0, len(q), block)] or [np.zeros(0)])


def _slack(qp: np.ndarray) -> np.ndarray:
    """Squared projected distance by which copies of a vector may lie apart, as projections are rounded."""
    return 1e-10 * (qp.astype(np.float64) ** 2).sum(1)


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()) if len(s) else np.zeros((0, 1), dtype=np.float32)


def _tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of each inner node of a full kd-tree, node i above 2i and 2i + 1; cuts are medians of the widest dimension."""
    dim, cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth, dtype=np.float32)
    rows = {1: np.arange(len(sample))}
    for node in range(1, 1 << depth):
        own = rows.pop(node)
        part = sample[own]
        if len(own):
            dim[node] = int(np.ptp(part, axis=0).argmax())
            cut[node] = np.median(part[:, dim[node]])
        over = part[:, dim[node]] > cut[node]
        rows[2 * node], rows[2 * node + 1] = own[~over], own[over]
    return dim, cut


def _descend(p: np.ndarray, dim: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The cell of each projected point."""
    node = np.ones(len(p), dtype=np.int64)
    rows = np.arange(len(p))
    for _ in range(len(dim).bit_length() - 1):
        node = 2 * node + (p[rows, dim[node]] > cut[node])
    return (node - len(dim)).astype(np.int32)


ROUTED = "cell int, block int, part int, id long, v array<float>, p array<float>, bound double"


def neighbours(vectors: DataFrame, k: int = 10, dims: int = 10, stop: float = 0.95, cell: int = CELL, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 17, asked: Column | None = None, sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, neighbour_id, rank, distance): the k nearest other vectors of the queries, by Euclidean distance.

    ``asked`` is the condition on ``id`` for a row to be a query; without it every row is one. All
    rows are points. Approximate: each true neighbour is found with a probability of at least
    ``stop`` (expected recall). Ties go to the lesser id, also among more than k equal vectors. The
    tree's upper levels are fitted on the ``sample`` points of the lowest hash of their id. Rows
    without id or vector, with a vector of another length than the most, or with a null, NaN or
    infinite coordinate are left out. Of rows that share an id the least vector counts. Fewer than k
    others give as many rows. Vectors of any length are taken whole. Extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    some = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    some = common.written(some.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    sizes = some.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    width = sizes[0]["s"] if sizes else 1
    some = some.where(F.size("v") == width)
    projection = np.random.default_rng(seed).standard_normal((width, dims)).astype(np.float32)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"p": list(_matrix(b["v"]) @ projection)})

    n = sizes[0]["count"] if sizes else 0
    few = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").mapInPandas(project, "p array<float>").toPandas()
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / cell)), int(math.log2(max(len(few), 1) / min(LEAST, cell)))))
    dim, cut = _tree(_matrix(few["p"]), depth) if len(few) else (np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.float32))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = _matrix(b["v"]) @ projection
                yield b.assign(p=list(p), cell=_descend(p, dim, cut))

    placed = "id long, v array<float>, p array<float>, cell int"
    equal = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = common.written(some.withColumn("nth", equal).where(F.col("nth") <= k + 1).select("id", "v").mapInPandas(place, placed), "points")
    of = common.written((some if asked is None else some.where(asked)).mapInPandas(place, placed), "queries")
    # one row a cell, and there are at most sample / LEAST cells
    box = points.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.get("p", F.lit(j))).alias(f"{s}{j}") for j in range(dims) for f, s in ((F.min, "l"), (F.max, "h"))]).orderBy("cell").toPandas()
    low, high = box[[f"l{j}" for j in range(dims)]].to_numpy(), box[[f"h{j}" for j in range(dims)]].to_numpy()
    numbers, blocks = box["cell"].to_numpy(), np.maximum(1, -(-box["n"].to_numpy() // block))
    first_block = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    row_of = {int(c): i for i, c in enumerate(numbers)}
    quantile = chi2_quantile(stop, dims)

    def wanted(c: pd.DataFrame, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of c and the blocks (row of the box, number) that they are to search, at first or afterwards."""
        ids = c["id"].to_numpy()
        at = np.array([row_of.get(x, -1) for x in c["cell"].tolist()])
        mine = np.where(at >= 0, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[at], 0)
        if own:
            q = np.flatnonzero(at >= 0)
            return q, at[q], mine[q]
        p = _matrix(c["p"])
        q, j = np.nonzero(_box_distance(p, low, high) <= (quantile * c["bound"].to_numpy() + _slack(p))[:, None])
        times = blocks[j]
        q, j = np.repeat(q, times), np.repeat(j, times)
        b = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
        rest = (j != at[q]) | (b != mine[q])
        return q[rest], j[rest], b[rest]

    def searched(asking: DataFrame, own: bool) -> DataFrame:
        """What the queries find in their own block, or in all others that may matter."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(int(first_block[-1]), dtype=np.int64)
            for b in batches:
                for i in range(0, len(b), 512):
                    _, j, block_ = wanted(b.iloc[i : i + 512], own)
                    total += np.bincount(first_block[j] + block_, minlength=len(total))
            some_ = np.flatnonzero(total)
            yield pd.DataFrame({"at": some_.astype(np.int64), "n": total[some_]})

        slim = asking.select("id", "cell", "p", "bound")
        loads = slim.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        parts = np.zeros(int(first_block[-1]), dtype=np.int64)
        parts[loads["at"].to_numpy(dtype=np.int64)] = -(-loads["n"].to_numpy(dtype=np.int64) // queries)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), 512):
                    c = b.iloc[i : i + 512]
                    q, j, block_ = wanted(c, own)
                    ids = c["id"].to_numpy()[q]
                    part = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % np.maximum(1, parts[first_block[j] + block_])
                    yield pd.DataFrame({"cell": numbers[j].astype(np.int32), "block": block_.astype(np.int32), "part": part.astype(np.int32), "id": ids, "v": c["v"].to_numpy()[q], "p": c["p"].to_numpy()[q], "bound": c["bound"].to_numpy()[q]})

        def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = np.array([row_of[x] for x in b["cell"].tolist()], dtype=np.int64)
                block_ = (b["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[at] if len(b) else at
                times = parts[first_block[at] + block_] if len(b) else at
                for t in range(int(times.max()) if len(b) else 0):
                    yield b.assign(block=block_.astype(np.int32), part=np.int32(t))[times > t]

        def search_block(points_: pd.DataFrame, asking_: pd.DataFrame) -> pd.DataFrame:
            if not len(points_) or not len(asking_):
                return pd.DataFrame({"query_id": [], "neighbour_id": [], "d2": []}).astype({"query_id": "int64", "neighbour_id": "int64", "d2": "float64"})
            ids, qids = points_["id"].to_numpy(), asking_["id"].to_numpy()
            q, at, d2 = search(ids, _matrix(points_["v"]), _matrix(points_["p"]), qids, _matrix(asking_["v"]), _matrix(asking_["p"]), asking_["bound"].to_numpy(), k, quantile)
            return pd.DataFrame({"query_id": qids[q], "neighbour_id": ids[at], "d2": d2})

        at = ("cell", "block", "part")
        left = points.mapInPandas(copies, f"{placed}, block int, part int") if (parts > 1).any() or (blocks > 1).any() else points.withColumns({"block": F.lit(0), "part": F.lit(0)})
        return left.groupBy(*at).cogroup(asking.mapInPandas(route, ROUTED).groupBy(*at)).applyInPandas(search_block, PAIRS)

    if not len(box):
        return of.select(F.col("id").alias("query_id"), F.col("id").alias("neighbour_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).where("false")
    infinite = F.lit(float("inf"))
    first = common.written(searched(of.withColumn("bound", infinite), True), "own")
    bounds = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("d2")).alias("bound"))
    bounded = of.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", infinite))
    found = first if first_block[-1] < 2 else first.unionByName(searched(common.written(bounded, "bounded"), False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", F.round(F.sqrt("d2"), 6).alias("distance"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for every vector whose id is divisible by 20; null, odd and repeated rows as in neighbours."""
    return neighbours(common.read(spark, sf_dir, "embeddings"), asked=F.col("id") % 20 == 0)

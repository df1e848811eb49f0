"""Neighbour searches by pivot partitions and the triangle inequality.

Points belong to the nearest of up to `MAX_PIVOTS` pivots.  A point needs a look at another partition only if
the ball of its search radius reaches it: d(x, q) - radius(q) <= r, and (d(x, q) - d(x, home)) / 2 <= r, as the points of q are
nearer to q than to x's own pivot.  Neighbouring partitions share a block (`pairs.block_pairs`); blocks meet once where
some point of one needs a partition of the other, so a point is copied once a block, not once a partition, however
many partitions its ball reaches.  The driver holds the pivots, one radius a pivot and the needed pairs of
pivots, nothing of the points.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned
from .pairs import BLOCK_ROWS, _dist, _mat, block_pairs, block_size, close_pairs

MAX_PIVOTS, PER_PIVOT = 512, 256
#: Bounds are compared with this relative slack, so rounding loses no pair.
SLACK = 1e-9


@dataclass
class Index:
    points: DataFrame          # id, vec, home, r (distance to the pivot), tile
    pivots: np.ndarray
    reach: np.ndarray          # largest r of each partition
    sizes: np.ndarray
    tiles: np.ndarray


def build_index(points: DataFrame, id_col: str, vec: str, per_pivot: int = PER_PIVOT, block_rows: int = BLOCK_ROWS) -> Index | None:
    src = pinned(points.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")), "index-points")
    n = src.count()
    if n == 0:
        return None
    chosen = src.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, math.ceil(n / per_pivot))).select("vec").collect()
    pivots = np.array([r["vec"] for r in chosen], dtype=np.float64)

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                home, r = _nearest(_mat(pdf["vec"]), pivots)
                yield pdf.assign(home=home, r=r)
    held = pinned(src.mapInPandas(nearest, "id long, vec array<double>, home int, r double"), "index-homes")
    stats = held.groupBy("home").agg(F.max("r").alias("reach"), F.count("*").alias("n")).collect()      # one row a pivot
    reach, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for s in stats:
        reach[s["home"]], sizes[s["home"]] = s["reach"], s["n"]
    tiles = np.maximum(1, -(-sizes // block_rows))
    number = F.element_at(F.array(*(F.lit(int(t)) for t in tiles)), F.col("home") + 1)
    return Index(held.withColumn("tile", F.pmod(F.xxhash64("id"), number).cast("int")), pivots, reach, sizes, tiles)


def _nearest(A, pivots):
    home, r = np.empty(len(A), np.int32), np.empty(len(A))
    for s, D in _dist(A, pivots):
        home[s:s + len(D)] = D.argmin(axis=1)
        r[s:s + len(D)] = D.min(axis=1)
    return home, r


def visits(index: Index, points: DataFrame | None = None, radius: float | None = None) -> DataFrame:
    """(id, home, tile, q): each point with every partition q that its search ball may reach.

    `points` are rows of the index, with a column `radius` unless one radius is given.
    """
    pivots, reach, sizes = index.pivots, index.reach, index.sizes

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            A, rad = _mat(pdf["vec"]), pdf["radius"].to_numpy(np.float64)[:, None]
            own = pdf["r"].to_numpy(np.float64)[:, None]
            for s, D in _dist(A, pivots):
                r = rad[s:s + len(D)]
                slack = SLACK * (1.0 + D + reach)
                near = (D - reach <= r + slack) & ((D - own[s:s + len(D)]) / 2 <= r + slack) & (sizes > 0)
                a, q = np.nonzero(near)
                yield pdf[["id", "home", "tile"]].iloc[s + a].assign(q=q.astype(np.int32))
    src = (points if points is not None else index.points.withColumn("radius", F.lit(float(radius)))).select("id", "vec", "radius", "home", "tile", "r")
    return src.mapInPandas(run, "id long, home int, tile int, q int")


def blocks_of(index: Index, needed) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((first block, number of blocks) of every partition, pairs of blocks that meet) for the needed (home, q)."""
    pivots, sizes = index.pivots, index.sizes
    rows = block_size(int(sizes.sum()), pivots.shape[1])
    at, left = 0, np.ones(len(pivots), bool)                # a chain of nearest pivots, so neighbours share a block
    span, block, filled = [(0, 1)] * len(pivots), 0, 0
    while True:
        left[at] = False
        if filled and filled + sizes[at] > rows:
            block, filled = block + 1, 0
        parts = max(1, -(-int(sizes[at]) // rows))
        span[at] = block, parts
        block, filled = block + parts - 1, rows if parts > 1 else filled + int(sizes[at])
        if not left.any():
            break
        d = ((pivots - pivots[at]) ** 2).sum(1)
        at = int(np.where(left, d, np.inf).argmin()) if np.isfinite(d[left]).any() else int(np.flatnonzero(left)[0])
    meet = {tuple(sorted((a, b))) for h, q in needed for a in range(span[h][0], sum(span[h])) for b in range(span[q][0], sum(span[q]))}
    return span, sorted(meet)


class Meeting:
    """Blocks of an index that hold all pairs of points within reach of each other; `each` runs a function on every needed pair."""

    def __init__(self, index: Index, points: DataFrame | None = None, radius: float | None = None):
        needed = visits(index, points, radius).select("home", "q").distinct().collect()         # at most pivots x pivots rows
        span, self.pairs = blocks_of(index, [(r["home"], r["q"]) for r in needed])
        first, parts = (F.element_at(F.array(*(F.lit(int(s[i])) for s in span)), F.col("home") + 1) for i in (0, 1))
        block = (first + F.pmod(F.xxhash64("id", "vec"), parts)).cast("int")
        src = points if points is not None else index.points
        self.points = src.select("id", "vec", *(c for c in ("radius",) if c in src.columns), block.alias("block"))

    def each(self, points: DataFrame, fn, schema: str) -> DataFrame:
        return block_pairs(points, self.pairs, fn, schema)


def _both_ways(fn):
    """A function of (visitors, members) on both directions of a pair of blocks."""
    def run(a, b, same):
        yield from fn(a, b)
        if not same:
            yield from fn(b, a)
    return run


def radius_edges(points: DataFrame, id_col: str, vec: str, eps, **index_args) -> DataFrame:
    """(i, j, d) with d <= eps, self pairs included (DBSCAN neighbourhoods)."""
    eps = float(eps)
    index = build_index(points, id_col, vec, **index_args)
    if index is None:
        return points.sparkSession.createDataFrame([], "i long, j long, d double")

    def fn(a, b, same):
        for i, j, d in close_pairs(a["vec"], b["vec"], eps):
            yield pd.DataFrame({"i": a["id"][i], "j": b["id"][j], "d": d})
            if not same:
                yield pd.DataFrame({"i": b["id"][j], "j": a["id"][i], "d": d})
    meeting = Meeting(index, radius=eps)
    return meeting.each(meeting.points, fn, "i long, j long, d double")


def degrees(meeting: Meeting, eps: float) -> DataFrame:
    """(i, deg): points within eps of each point, itself included."""
    def fn(a, b):
        n = np.zeros(len(a["id"]), np.int64)
        for i, _, _ in close_pairs(a["vec"], b["vec"], eps):
            n += np.bincount(i, minlength=len(n))
        yield pd.DataFrame({"i": a["id"], "deg": n})
    got = meeting.each(meeting.points, _both_ways(fn), "i long, deg long")
    return got.groupBy("i").agg(F.sum("deg").alias("deg")).where("deg > 0")


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (least members) of the sets in `root` after uniting the sets of i and j."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        up = np.arange(len(root))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        root = up[root]


def spanning_links(meeting: Meeting, points: DataFrame, eps: float) -> DataFrame:
    """(i, j): links of at most eps that connect what all links of that length connect; fewer than its rows from a pair of blocks."""
    def fn(a, b, same):
        ids = a["id"] if same else np.concatenate([a["id"], b["id"]])
        root, shift = np.arange(len(ids)), 0 if same else len(a["id"])
        for i, j, _ in close_pairs(a["vec"], b["vec"], eps):
            root = _merge(root, i, j + shift)
        at = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"i": ids[at], "j": ids[root[at]]})
    return meeting.each(points, fn, "i long, j long")


def least_near(meeting: Meeting, points: DataFrame, eps: float) -> DataFrame:
    """(i, bc): the least `cluster` within eps of each point whose own is -1."""
    def fn(a, b):
        ask, known = np.flatnonzero(a["cluster"] < 0), np.flatnonzero(b["cluster"] >= 0)
        least = np.full(len(ask), np.iinfo(np.int64).max)
        for i, j, _ in close_pairs(a["vec"][ask], b["vec"][known], eps):
            np.minimum.at(least, i, b["cluster"][known[j]])
        some = least < np.iinfo(np.int64).max
        yield pd.DataFrame({"i": a["id"][ask[some]], "bc": least[some]})
    return meeting.each(points, _both_ways(fn), "i long, bc long").groupBy("i").agg(F.min("bc").alias("bc"))


def _bounds(index: Index, k: int) -> DataFrame:
    """Rows of the index with an upper bound `radius` of the k-th smallest distance (self included).

    The k-th distance inside the point's own tile, or the far sides of the nearest partitions that hold k points together.
    """
    pivots, reach, sizes = index.pivots, index.reach, index.sizes

    def fn(pdf):
        A = _mat(pdf["vec"])
        out = np.full(len(A), np.inf)
        if len(A) >= k:
            for s, D in _dist(A, A):
                out[s:s + len(D)] = np.partition(D, k - 1, axis=1)[:, k - 1]
        else:
            for s, D in _dist(A, pivots):
                far = np.where(sizes > 0, D + reach, np.inf)
                order = np.argsort(far, axis=1)
                enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(axis=1)
                out[s:s + len(D)] = np.take_along_axis(far, order, 1)[np.arange(len(D)), enough] * (1 + SLACK) + SLACK
        return pdf.assign(radius=out)
    return index.points.groupBy("home", "tile").applyInPandas(fn, "id long, vec array<double>, home int, r double, tile int, radius double")


def knn_distances(points: DataFrame, id_col: str, vec: str, k: int, **index_args) -> DataFrame:
    """(id, k-th smallest distance, self included; the largest one where there are fewer points)."""
    kind = points.schema[id_col].dataType.simpleString()
    index = build_index(points, id_col, vec, **index_args)
    if index is None:
        return points.sparkSession.createDataFrame([], f"{id_col} {kind}, kdist double")
    k = min(k, int(index.sizes.sum()))

    def fn(a, b):
        for i, _, d in close_pairs(a["vec"], b["vec"], a["radius"] * (1 + SLACK) + SLACK):
            order = np.lexsort((d, i))
            i, d = i[order], d[order]
            begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
            stop = np.minimum(np.append(begin[1:], len(i)), begin + k)
            yield pd.DataFrame({"id": a["id"][i[begin]], "d": [d[x:y] for x, y in zip(begin, stop)]})
    bounded = pinned(_bounds(index, k), "index-bounds")
    meeting = Meeting(index, bounded)
    cand = meeting.each(meeting.points, _both_ways(fn), "id long, d array<double>")
    best = cand.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("ds"))
    return best.select(F.col("id").cast(kind).alias(id_col), F.element_at("ds", -1).alias("kdist"))

"""DTW distance and DTW k-means with barycentre averaging (M6).

The searches for all numbers of clusters advance together: one job a round moves every series past the centres of
all of them, keyed by (k, centre).  A table of at most sum(k) short centres is all that goes to the tasks and comes back;
rounds start from nothing else, so no round depends on a lost executor.

For each series and k the centre of the least warping-envelope bound is computed first; others are skipped where their
bound is above that cost, and abandoned where two neighbouring anti-diagonals are.  Only the winner's
path is traced; the values it aligns to each centre position are summed per task, then per centre (barycentre step,
Petitjean et al. 2011).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned

#: Pairs whose cost tables are filled together.
PAIRS = 512


def _diagonals(X: np.ndarray, C: np.ndarray):
    """Anti-diagonals of the cumulative squared-difference tables of the pairs (X[b], C[b]).

    Yields (s, low, high, now, options): now[:, i] is cell (i, s - i), 1-based; options the three costs that were chosen from.
    The caller may send the rows to keep.
    """
    n, m = X.shape[1], C.shape[1]
    R = C[:, ::-1]
    two, one, now = (np.full((len(X), n + 2), np.inf) for _ in range(3))
    two[:, 0] = 0.0
    for s in range(2, n + m + 1):
        low, high = max(1, s - m), min(n, s - 1)
        d = X[:, low - 1:high] - R[:, m - s + low:m - s + high + 1]
        options = two[:, low - 1:high], one[:, low - 1:high], one[:, low:high + 1]
        now[:, low:high + 1] = d * d + np.minimum(np.minimum(options[0], options[1]), options[2])
        now[:, low - 1] = now[:, high + 1] = np.inf
        keep = yield s, low, high, now, one, options
        if keep is not None:
            X, R, two, one, now = X[keep], R[keep], two[keep], one[keep], now[keep]
            yield None
        two, one, now = one, now, two


def dtw_costs(X: np.ndarray, C: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
    """Least cumulative cost of each pair of rows; infinite where it can't stay within the pair's bound."""
    out, rows, last = np.full(len(X), np.inf), np.arange(len(X)), X.shape[1] + C.shape[1]
    steps = _diagonals(X, C)
    for s, low, high, now, one, _ in steps:
        if s == last:
            out[rows] = now[:, high]
        elif bound is not None and s % 32 == 0:
            # a path crosses one of two neighbouring anti-diagonals
            open_ = np.minimum(now[:, low:high + 1].min(1), one.min(1)) <= bound[rows]
            if not open_.any():
                break
            if open_.mean() < 0.75:
                rows = rows[open_]
                steps.send(np.flatnonzero(open_))
    return out


def dtw_paths(X: np.ndarray, C: np.ndarray):
    """(costs, i, j, n): optimal paths of pairs from end to begin, n[b] cells each; ties prefer the diagonal, then i - 1."""
    n, m = X.shape[1], C.shape[1]
    choice = np.zeros((len(X), n + 1, m + 1), np.uint8)
    for s, low, high, now, _, (a, b, c) in _diagonals(X, C):
        i = np.arange(low, high + 1)
        choice[:, i, s - i] = np.where((a <= b) & (a <= c), 0, np.where(b <= c, 1, 2))
        if s == n + m:
            cost = now[:, high].copy()
    at = np.arange(len(X))
    i, j = np.full(len(X), n), np.full(len(X), m)
    size = np.zeros(len(X), np.int64)
    I, J = np.zeros((len(X), n + m), np.int32), np.zeros((len(X), n + m), np.int32)
    for step in range(n + m):
        open_ = (i > 0) & (j > 0)
        if not open_.any():
            break
        I[open_, step], J[open_, step] = i[open_] - 1, j[open_] - 1
        size += open_
        move = choice[at, i, j]
        first = (i == 1) & (j == 1)
        i, j = np.where(open_ & ((move < 2) | first), i - 1, i), np.where(open_ & ((move != 1) | first), j - 1, j)
    return cost, I, J, size


def dtw(x, y):
    """(distance, path) with squared-difference cost; distance = sqrt(min cumulative cost)."""
    cost, I, J, size = dtw_paths(np.asarray(x, float)[None], np.asarray(y, float)[None])
    return float(np.sqrt(cost[0])), list(zip(I[0, :size[0]].tolist(), J[0, :size[0]].tolist()))[::-1]


def envelope_bounds(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """(series, centres): lower bounds of the costs; every value is matched with one inside the other side's range."""
    def outside(A, B):
        lo, hi = B.min(1)[None, :, None], B.max(1)[None, :, None]
        d = np.maximum(np.maximum(A[:, None, :] - hi, lo - A[:, None, :]), 0.0)
        return (d * d).sum(2)
    ends = (X[:, None, 0] - C[None, :, 0]) ** 2 + (X[:, None, -1] - C[None, :, -1]) ** 2
    if X.shape[1] == C.shape[1] == 1:
        ends /= 2
    return np.maximum(np.maximum(outside(X, C), outside(C, X).T), ends) * (1 - 1e-12)


def nearest_centres(X: np.ndarray, C: np.ndarray, groups: list[tuple[int, int]]):
    """(cost, centre), each (series, groups): the nearest centre of every group (begin, end) of rows of C; ties -> the first."""
    cost = np.full((len(X), len(C)), np.inf)
    lower = envelope_bounds(X, C)

    def fill(a, c, bound):
        for k in range(0, len(a), PAIRS):
            p = slice(k, k + PAIRS)
            cost[a[p], c[p]] = dtw_costs(X[a[p]], C[c[p]], None if bound is None else bound[p])
    first = np.stack([begin + lower[:, begin:end].argmin(1) for begin, end in groups], 1)
    fill(np.repeat(np.arange(len(X)), len(groups)), first.ravel(), None)
    bound = np.empty_like(cost)
    for g, (begin, end) in enumerate(groups):
        bound[:, begin:end] = cost[np.arange(len(X)), first[:, g]][:, None]
    a, c = np.nonzero((lower <= bound) & np.isinf(cost))
    fill(a, c, bound[a, c])
    best = np.stack([begin + cost[:, begin:end].argmin(1) for begin, end in groups], 1)
    return np.take_along_axis(cost, best, 1), best


def _groups(ks):
    ends = np.cumsum(ks)
    return list(zip((ends - ks).tolist(), ends.tolist()))


def _stack(values):
    return np.array([np.asarray(v, dtype=np.float64) for v in values])


def _round(series: DataFrame, vec: str, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One round for all k: (new centres, inertia)."""
    ks = sorted(centres)
    C, groups = np.concatenate([centres[k] for k in ks]), _groups(np.array(ks))

    def run(batches):
        total, count, inertia, width = np.zeros(C.shape), np.zeros(C.shape), np.zeros(len(ks)), C.shape[1]
        for pdf in batches:
            for a in range(0, len(pdf), 16):
                X = _stack(pdf[vec].iloc[a:a + 16])
                cost, best = nearest_centres(X, C, groups)
                inertia += cost.sum(0)
                rows, which = np.repeat(np.arange(len(X)), len(ks)), best.ravel()
                for p in range(0, len(rows), 64):
                    _, I, J, size = dtw_paths(X[rows[p:p + 64]], C[which[p:p + 64]])
                    on = np.arange(I.shape[1])[None, :] < size[:, None]
                    at = (which[p:p + 64, None] * width + J)[on]
                    total += np.bincount(at, X[rows[p:p + 64, None], I][on], C.size).reshape(C.shape)
                    count += np.bincount(at, minlength=C.size).reshape(C.shape)
        a, t = np.nonzero(count)
        yield pd.DataFrame({"centre": np.r_[a, -1 - np.arange(len(ks))], "t": np.r_[t, np.zeros(len(ks), int)],
                            "s": np.r_[total[a, t], inertia], "n": np.r_[count[a, t], np.ones(len(ks))]})
    got = series.select(vec).mapInPandas(run, "centre int, t int, s double, n double").groupBy("centre", "t") \
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()       # at most sum(k) x weeks rows
    sums = got[got.centre < 0]
    inertia = {ks[-1 - c]: s for c, s in zip(sums.centre, sums.s)}
    means, new = got[got.centre >= 0], C.copy()
    new[means.centre, means.t] = means.s / means.n
    return {k: new[a:b] for k, (a, b) in zip(ks, groups)}, inertia


class DtwSearch:
    """DTW k-means for several k at once; every k starts from the first k series in hash order."""

    def __init__(self, series: DataFrame, id_col: str, vec: str, ks, seed: int = 42):
        from ..forecast.series import spread
        self.id_col, self.vec = id_col, vec
        # spread the series over tasks: the cost is per (series, centre), not per byte
        self.series = pinned(spread(series.select(id_col, vec), id_col), "dtw-series")
        n = self.series.count()
        ks = sorted({min(k, n) for k in ks})
        first = self.series.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(max(ks, default=0)).collect()
        start = _stack([r[vec] for r in first])
        self.centres = {k: start[:k] for k in ks if k}
        self.inertia, self.rounds, self.done = {}, {k: 0 for k in self.centres}, set()

    def advance(self, max_iter: int, ks=None):
        """Rounds for the given k (default all) until each has had `max_iter` or its inertia stands still."""
        while True:
            open_ = [k for k in (ks or self.centres) if k not in self.done and self.rounds[k] < max_iter]
            if not open_:
                return self
            new, inertia = _round(self.series, self.vec, {k: self.centres[k] for k in open_})
            for k in open_:
                before = self.inertia.get(k)
                self.centres[k], self.inertia[k] = new[k], inertia[k]
                self.rounds[k] += 1
                if before is not None and abs(before - inertia[k]) <= 1e-9 * max(1.0, abs(before)):
                    self.done.add(k)

    def assign(self, ks=None) -> DataFrame:
        """(id, k, cluster, dist) under the present centres."""
        id_col, vec = self.id_col, self.vec
        ks = sorted(ks or self.centres)
        schema = f"{id_col} {self.series.schema[id_col].dataType.simpleString()}, k int, cluster int, dist double"
        if not self.centres:
            return self.series.sparkSession.createDataFrame([], schema)
        C, groups = np.concatenate([self.centres[k] for k in ks]), _groups(np.array(ks))
        begins = np.array([a for a, _ in groups])

        def run(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 16):
                    part = pdf.iloc[a:a + 16]
                    cost, best = nearest_centres(_stack(part[vec]), C, groups)
                    yield pd.DataFrame({id_col: np.repeat(part[id_col].to_numpy(), len(ks)), "k": np.tile(ks, len(part)),
                                        "cluster": (best - begins).ravel(), "dist": np.sqrt(cost).ravel()})
        return self.series.mapInPandas(run, schema)


def dtw_kmeans(series: DataFrame, id_col: str, vec: str, k: int, max_iter: int = 30, seed: int = 42):
    """Returns (assignments DataFrame(id, cluster, dist), centres)."""
    search = DtwSearch(series, id_col, vec, [k], seed).advance(max_iter)
    return search.assign().drop("k"), list(next(iter(search.centres.values()), []))

"""PCA and K-means (M3, M4, M5): Spark ML's projection and start centres, rounds that all starts share."""
from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned
from .metrics import silhouettes
from .pairs import _mat, _slack

#: Searches of start centres that run as concurrent jobs; each is a chain of short jobs, so one alone leaves most executors idle.
CONCURRENT_FITS = 8
#: Rows of a task at most; in the rounds fewer, down to the least, as long as there are idle cores.
ROWS_PER_TASK, LEAST_ROWS = 20_000, 2_000
#: Numbers of one product of rows with centres, and bytes of partial sums that the driver takes from the tasks without a step between.
HELD, SUMS_BYTES = 1 << 18, 32 << 20
#: Costs this close (relative) count as equal: the earliest start wins, in whatever order sums were added.
SAME_COST = 1e-12


def pca_95(df: DataFrame, vec: str, out: str = "pca", variance: float = 0.95):
    """M3: fewest components whose cumulative explained variance exceeds `variance`."""
    first = df.select(vec).first()
    if first is None:                                   # no rows: empty projection, zero components
        return df.withColumn(out, F.lit(None).cast("array<double>")), 0, None
    v = df.withColumn("_v", array_to_vector(vec))
    d = len(first[0])
    n = df.count()
    kmax = max(1, min(d, n))
    model = PCA(k=kmax, inputCol="_v", outputCol="_p").fit(v)
    cum, k = 0.0, kmax
    for i, e in enumerate(model.explainedVariance.toArray()):
        cum += e
        if cum >= variance:
            k = i + 1
            break
    out_df = model.transform(v).select(*[c for c in df.columns], F.slice(vector_to_array("_p"), 1, k).alias(out))
    return out_df, k, model


def nearest(X: np.ndarray, C: np.ndarray, ends) -> np.ndarray:
    """(groups, rows): which centre of each group is nearest to a row of X, the first of equals; group g is rows ends[g] to ends[g + 1] of C.

    By matrix products; what they can't tell apart is decided by differences.
    """
    out, scale = np.empty((len(ends) - 1, len(X)), np.int64), np.einsum("ij,ij->i", C, C)
    near, norms = C @ X.T - scale[:, None] / 2, np.einsum("ij,ij->i", X, X)
    for g, (a, b) in enumerate(zip(ends, ends[1:])):
        out[g] = near[a:b].argmax(axis=0)
        least = near[a:b].max(axis=0) - _slack(norms + scale[a:b].max(), X.shape[1])
        unsure = np.flatnonzero(np.count_nonzero(near[a:b] >= least, axis=0) > 1)
        step = max(1, HELD // max(1, (b - a) * X.shape[1]))
        for s in range(0, len(unsure), step):
            d = X[unsure[s:s + step], None, :] - C[None, a:b, :]
            out[g, unsure[s:s + step]] = np.einsum("ijk,ijk->ij", d, d).argmin(axis=1)
    return out


def _matrices(table: DataFrame, tasks: int):
    """RDD of matrices of some thousand rows of the array column `_v`."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                X = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"dims": pa.array([len(X) // len(batch)], pa.int32()), "x": pa.array([X.tobytes()], pa.binary())})
    packed = table.repartition(tasks).mapInArrow(pack, "dims int, x binary")
    return packed.rdd.map(lambda r: np.frombuffer(r.x, np.float64).reshape(-1, r.dims))


def _total(blocks, fold, size: int):
    """Sum over the partitions of what `fold` (matrices of a partition -> array of `size` numbers) gives."""
    depth = 1 if blocks.getNumPartitions() * size * 8 <= SUMS_BYTES else 2
    return blocks.mapPartitions(lambda part: [fold(part)]).treeReduce(np.add, depth)


def _chunks(part, C: np.ndarray):
    step = max(1, HELD // len(C))
    for X in part:
        for s in range(0, len(X), step):
            yield X[s:s + step]


def _sums(blocks, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Per group of centres: the sums of the rows nearest to each centre, and in the last column their number; one pass for all groups."""
    C, ends = np.concatenate(centres), np.cumsum([0] + [len(c) for c in centres])
    sent = blocks.context.broadcast(C)

    def fold(part):
        C = sent.value
        out = np.zeros((len(C), C.shape[1] + 1))
        for X in _chunks(part, C):
            of = nearest(X, C, ends) + ends[:-1, None]
            member = np.zeros((len(C), len(X)))
            member[of, np.arange(len(X))] = 1.0
            out[:, :-1] += member @ X
            out[:, -1] += np.bincount(of.ravel(), minlength=len(C))
        return out
    total = _total(blocks, fold, C.size + len(C))
    sent.destroy()
    return [total[a:b] for a, b in zip(ends, ends[1:])]


def _costs(blocks, centres: list[np.ndarray]) -> np.ndarray:
    """Per group of centres: the sum of the squared distances of all rows to the nearest one, by differences."""
    C, ends = np.concatenate(centres), np.cumsum([0] + [len(c) for c in centres])
    sent = blocks.context.broadcast(C)

    def fold(part):
        C = sent.value
        out = np.zeros(len(ends) - 1)
        for X in _chunks(part, C):
            for g, of in enumerate(nearest(X, C, ends) + ends[:-1, None]):
                d = X - C[of]
                out[g] += np.einsum("ij,ij->", d, d)
        return out
    total = _total(blocks, fold, len(ends) - 1)
    sent.destroy()
    return total


def _rounds(blocks, centres: list[np.ndarray], max_iter: int, tol: float):
    """(centres, costs) of every start after Lloyd's rounds; a start ends when no centre of it moves by more than `tol`.

    A round is one pass over the rows for all starts that go on.  As in Spark ML, a centre without rows stays, and the
    cost is that of the centres from which the last round began.
    """
    centres, before, going = list(centres), list(centres), list(range(len(centres)))
    for _ in range(max_iter):
        if not going:
            break
        moved = []
        for g, s in zip(going, _sums(blocks, [centres[g] for g in going])):
            n = s[:, -1:]
            before[g], centres[g] = centres[g], np.where(n > 0, s[:, :-1] / np.maximum(n, 1), centres[g])
            if (np.square(centres[g] - before[g]).sum(axis=1) > tol * tol).any():
                moved.append(g)
        going = moved
    return centres, _costs(blocks, before)


def fit_all(df: DataFrame, vec: str, k_values, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> dict[int, tuple]:
    """{k: (centres, cost)}: for each k the best of `n_init` seeded runs by within-cluster sum of squares.

    The vectors are written once.  Spark ML finds the start centres (k-means||) of all (k, start) in concurrent jobs;
    then all of them share one pass over the cached rows a round.
    """
    jobs = [(k, s) for k in k_values for s in range(n_init)]
    if not jobs:
        return {}
    table = pinned(df.select(F.col(vec).alias("_v")), "kmeans-input")
    n = table.count()
    tasks = max(1, math.ceil(n / ROWS_PER_TASK))
    v = table.select(array_to_vector("_v").alias("_v")).coalesce(tasks).persist()

    def start(job):
        k, s = job
        return np.array(KMeans(k=k, seed=seed + s, maxIter=0, featuresCol="_v", predictionCol="_c").fit(v).clusterCenters())
    try:
        with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
            starts = list(pool.map(inheritable_thread_target(df.sparkSession)(start), jobs))
    finally:
        v.unpersist()
    dims = starts[0].shape[1]
    tasks = max(tasks, min(math.ceil(n / LEAST_ROWS), df.sparkSession.sparkContext.defaultParallelism))
    # distances lose least about the mean
    total = _total(_matrices(table, tasks), lambda part: sum((np.append(X.sum(axis=0), len(X)) for X in part), np.zeros(dims + 1)), dims + 1)
    mean = total[:-1] / total[-1]
    blocks = _matrices(table, tasks).map(lambda X: X - mean).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres, costs = _rounds(blocks, [c - mean for c in starts], max_iter, tol=1e-6)
    finally:
        blocks.unpersist()
    best = {}
    for (k, _), c, cost in zip(jobs, centres, costs.tolist()):
        if k not in best or cost < best[k][1] * (1 - SAME_COST):
            best[k] = c + mean, cost
    return best


def labelled(df: DataFrame, vec: str, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """`df` with the number of the nearest of `centres` in column `out`."""
    mean = centres.mean(axis=0)

    @F.pandas_udf("int")
    def label(v: pd.Series) -> pd.Series:
        step = max(1, HELD // len(centres))
        of = [nearest(_mat(v.iloc[s:s + step]) - mean, centres - mean, [0, len(centres)])[0] for s in range(0, len(v), step)]
        return pd.Series(np.concatenate(of) if of else [], dtype="int32")
    return df.withColumn(out, label(F.col(vec).cast("array<double>")))


def kmeans_best_of(df: DataFrame, vec: str, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300):
    """M4: (labelled rows, cost, centres) of the best of `n_init` seeded runs."""
    centres, cost = fit_all(df, vec, [k], n_init, seed, max_iter)[k]
    return labelled(df, vec, centres), cost, centres


def kmeans_search(df: DataFrame, id_col: str, vec: str, k_values, n_init: int = 10, seed: int = 42):
    """M5: ([(k, silhouette, inertia)], {k: (centres, cost)}); k is capped at n - 1 (N14), all silhouettes come from one pass."""
    n = df.count()
    ks = [k for k in k_values if n >= 3 and k <= n - 1]
    fits = fit_all(df, vec, ks, n_init, seed) if ks else {}
    lab = df.select(id_col, vec)
    for k in ks:
        lab = labelled(lab, vec, fits[k][0], f"_c{k}")
    by = {}
    if ks:
        lab = pinned(lab.select(id_col, vec, F.array(*(F.col(f"_c{k}") for k in ks)).alias("_labels")), "kmeans-labels")
        by = {r["labeling"]: r["silhouette"] for r in silhouettes(lab, id_col, vec, "_labels").collect()}     # a row per k
    return [(int(k), by.get(i), float(fits[k][1])) for i, k in enumerate(ks)], fits


def silhouette_by_k(df: DataFrame, id_col: str, vec: str, k_values, n_init: int = 10, seed: int = 42) -> DataFrame:
    """M5: (k, silhouette, inertia) for each k."""
    rows, _ = kmeans_search(df, id_col, vec, k_values, n_init, seed)
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double")

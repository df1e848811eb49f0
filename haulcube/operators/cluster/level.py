"""Every clustering method on one aggregation level -> (assignments, metrics, silhouette curves).

The methods run side by side, each a chain of short distributed jobs on the
(small, pinned) feature matrix: one chain alone waits on its own jobs and leaves most executors idle.  Groups are keyed by a dense integer id for
the pair kernels and mapped back at the end.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned
from ..ordering import global_index
from .dbscan import auto_eps, dbscan
from .dtw import DtwSearch
from .features import feature_matrix
from .kmeans import kmeans_search, labelled, pca_95
from .metrics import cluster_metrics, silhouettes
from .ward import cut_tree, cut_tree_all, ward_linkage

K_RANGE = range(2, 16)
METRIC_SCHEMA = ("method string, silhouette double, calinski_harabasz double, davies_bouldin double, "
                 "n_clusters int, best_k int, eps double, n_noise long, level string")
CURVE_SCHEMA = "method string, level string, k int, silhouette double, inertia double"


def keyed(X: DataFrame, group: str) -> DataFrame:
    """The pinned feature matrix with a dense integer id `gid`; only the ids are numbered."""
    ids = global_index(X.select(group), [group], "gid").select(group, (F.col("gid") + 1).cast("long").alias("gid"))
    return pinned(X.select(group, "features").join(ids, group), "level-matrix")


def capped(k_values, n: int) -> list[int]:
    return [k for k in k_values if k <= n - 1]              # N14


def _best(curve) -> int:
    """The least k of the largest silhouette; one cluster where no k has one."""
    return max((c for c in curve if c[1] is not None), key=lambda c: c[1], default=(1, None))[0]


def curve_of(X: DataFrame, id_col: str, vec: str, labels: DataFrame, k_values) -> list[tuple]:
    """[(k, silhouette)] of `labels` (id, k, cluster), from one pass over the distances."""
    ks = sorted(k_values)
    if not ks:
        return []
    wide = labels.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("k", "cluster"))).alias("_l"))
    got = silhouettes(X.join(wide, id_col).select(id_col, vec, F.col("_l.cluster").alias("_labels")), id_col, vec, "_labels")
    by = {r["labeling"]: r["silhouette"] for r in got.collect()}        # a row per k
    return [(k, by.get(i)) for i, k in enumerate(ks)]


def dtw_search(X: DataFrame, id_col: str, vec: str, k_values, max_iter: int = 30, final_iter: int = 50):
    """M6: DTW k-means for every k at once, refitted at the k of the best Euclidean silhouette; (assignments, k, [(k, silhouette)]).

    The refit starts like the search did, so it goes on from the search's centres.
    """
    search = DtwSearch(X, id_col, vec, k_values).advance(max_iter)
    labels = pinned(search.assign(), "dtw-labels")
    curve = curve_of(X, id_col, vec, labels, search.centres)
    best = _best(curve)
    if best not in search.centres:
        search = DtwSearch(X, id_col, vec, [best])
    return search.advance(final_iter, [best]).assign([best]).drop("k"), best, curve


def ward_search(X: DataFrame, id_col: str, vec: str, k_values):
    """M8: the Ward tree cut at the k of the best silhouette; (assignments, k, [(k, silhouette)])."""
    lk, leaves = ward_linkage(X.select(id_col, vec), id_col, vec)
    if not k_values:
        return cut_tree(lk, leaves, id_col, 1), 1, []
    cuts = pinned(cut_tree_all(lk, leaves, id_col, k_values), "ward-cuts")
    curve = curve_of(X, id_col, vec, cuts, k_values)
    best = _best(curve)
    return (cuts.where(F.col("k") == best).drop("k") if best in k_values else cut_tree(lk, leaves, id_col, best)), best, curve


def side_by_side(spark, calls) -> list:
    """Results of the calls in their order; their jobs run concurrently."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda call: call()), calls))


def cluster_level(cube: DataFrame, group: str, level: str, value: str = "tons_refuse", coverage: float = 0.8,
                  k_values=K_RANGE, n_init: int = 10, dtw_iter: int = 30, dtw_final_iter: int = 50,
                  parts=("assignments", "metrics", "curves")):
    """(assignments, metrics, curves); `parts` names those that are wanted, so that the others' own work is left out (None)."""
    spark = cube.sparkSession
    X = feature_matrix(cube, group, value, coverage)
    X = keyed(X, group)
    n = X.count()
    if n < 5:                                               # N13: always the same frames
        return (spark.createDataFrame([], f"{group} string, cluster_kmeans int, cluster_dtw_kmeans int, "
                                          "cluster_hierarchical int, cluster_dbscan int"),
                spark.createDataFrame([], METRIC_SCHEMA), spark.createDataFrame([], CURVE_SCHEMA))
    ks = capped(k_values, n)

    def metric_row(method, pts, vec, lab, best_k=None, eps=None, n_noise=None):
        if "metrics" not in parts:
            return None
        m = cluster_metrics(pts, "gid", vec, lab).first()
        return (method, m["silhouette"], m["calinski_harabasz"], m["davies_bouldin"], m["n_clusters"],
                best_k, eps, n_noise, level)

    # every method: (name of the labels, labels, metric row, curve)
    def kmeans():
        # on the PCA projection; the fit at the best k is among those of the search
        pca, _, _ = pca_95(X, "features")
        pca = pinned(pca.select(group, "gid", "pca"), "level-pca")
        by_k, fits = kmeans_search(pca, "gid", "pca", ks, n_init=n_init)
        best_k = _best(by_k)
        lab = labelled(pca, "pca", fits[best_k][0])
        return ("cluster_kmeans", lab.select("gid", F.col("cluster").cast("int").alias("c")),
                metric_row("KMeans", lab, "pca", "cluster", best_k=best_k), [("KMeans", level, k, s, inertia) for k, s, inertia in by_k])

    def dtw():
        # Euclidean silhouette picks k
        final, best_k, by_k = dtw_search(X, "gid", "features", ks, dtw_iter, dtw_final_iter if set(parts) != {"curves"} else dtw_iter)
        final = pinned(final.select("gid", "cluster"), "dtw-final")
        return ("cluster_dtw_kmeans", final.select("gid", F.col("cluster").cast("int").alias("c")),
                metric_row("DTW-KMeans", X.join(final, "gid"), "features", "cluster", best_k=best_k), [("DTW-KMeans", level, k, s, None) for k, s in by_k])

    def ward():
        # tree, cut by silhouette
        cut, best_k, by_k = ward_search(X, "gid", "features", ks)
        return ("cluster_hierarchical", cut.select("gid", F.col("cluster").cast("int").alias("c")),
                metric_row("Hierarchical", X.join(cut, "gid"), "features", "cluster", best_k=best_k), [("Hierarchical", level, k, s, None) for k, s in by_k])

    def density():
        # DBSCAN with the knee eps
        eps = auto_eps(X, "gid", "features").first()["eps"]
        db = pinned(dbscan(X, "gid", "features", eps, 3), "dbscan-labels")
        n_noise = db.filter(F.col("cluster") == -1).count()
        return ("cluster_dbscan", db.select("gid", F.col("cluster").alias("c")),
                metric_row("DBSCAN", X.join(db, "gid"), "features", "cluster", eps=float(eps), n_noise=n_noise), [])

    done = side_by_side(spark, [kmeans, dtw, ward] + ([] if set(parts) == {"curves"} else [density]))
    labels = {name: lab for name, lab, _, _ in done}
    rows, curve = [row for _, _, row, _ in done], [c for *_, by_k in done for c in by_k]
    if set(parts) == {"curves"}:
        return None, None, spark.createDataFrame(curve, CURVE_SCHEMA)

    assign = X.select(group, "gid")
    for name, l in labels.items():
        assign = assign.join(l.withColumnRenamed("c", name), "gid", "left")
    return (assign.drop("gid"), spark.createDataFrame(rows, METRIC_SCHEMA) if "metrics" in parts else None, spark.createDataFrame(curve, CURVE_SCHEMA))

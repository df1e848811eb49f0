"""Clustering quality metrics.

Silhouette is exact (Euclidean) from block-tiled distance sums per (point,
cluster); Calinski-Harabasz and Davies-Bouldin come from centroid and
dispersion aggregates; the adjusted Rand index from a contingency table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned
from .pairs import _dist, _mat, distance_sums, tile_apply


def dim_means(df: DataFrame, vec: str, keys) -> DataFrame:
    """Per-key mean vector: posexplode -> groupBy(key, pos).avg -> ordered array."""
    keys = list(keys)
    e = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    g = m.groupBy(*keys) if keys else m.groupBy()
    return g.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_s")).select(*keys, F.col("_s.x").alias("mu"))


def sqdist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def silhouettes(points: DataFrame, id_col: str, vec: str, labels: str) -> DataFrame:
    """(labeling, silhouette): mean over the non-noise points of each labeling of the array column `labels`, from one pass over
    the distances; a labeling of fewer than 2 clusters has no row."""
    s = distance_sums(points, id_col, vec, labels)
    own = F.col("label") == F.col("other")
    per = s.groupBy("labeling", "id").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("sum_d") / (F.col("n") - 1)).otherwise(0.0))).alias("a"),
        F.max(F.when(own, F.col("n") == 1)).alias("single"),
        F.min(F.when(~own, F.col("sum_d") / F.col("n"))).alias("b")).where("b is not null")
    sv = F.when(F.col("single") | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("labeling").agg(F.avg(sv).alias("silhouette"))


def silhouette(points: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """Mean silhouette over non-noise points (null when fewer than 2 clusters)."""
    s = silhouettes(points.select(id_col, vec, F.array(label).alias("_labels")), id_col, vec, "_labels")
    return s.agg(F.max("silhouette").alias("silhouette"))


def _worst_ratio(l, r):
    """Davies-Bouldin: per cluster of the left tile the largest (S + S') / distance to a cluster of the right tile."""
    parts = [pd.DataFrame({"k": pd.Series(dtype="int64"), "r": pd.Series(dtype="float64")})]
    if len(l) and len(r):
        li, ri, sl, sr = l["_k"].to_numpy(), r["_k"].to_numpy(), l["S"].to_numpy(), r["S"].to_numpy()
        for s, D in _dist(_mat(l["mu"]), _mat(r["mu"])):
            ratio = np.full(D.shape, -np.inf)
            other = li[s:s + len(D), None] != ri[None, :]
            np.divide(sl[s:s + len(D), None] + sr[None, :], D, out=ratio, where=other)
            parts.append(pd.DataFrame({"k": li[s:s + len(D)], "r": ratio.max(axis=1)}))
    return pd.concat(parts[1:] or parts, ignore_index=True)


def cluster_metrics(points: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """M9: silhouette, Calinski-Harabasz, Davies-Bouldin, n_clusters (nulls when < 2 clusters)."""
    n_clusters = points.filter(F.col(label) != -1).select(F.count_distinct(label)).first()[0]
    if n_clusters < 2:
        return points.sparkSession.createDataFrame(
            [(None, None, None, int(n_clusters))],
            "silhouette double, calinski_harabasz double, davies_bouldin double, n_clusters int")
    p = points.filter(F.col(label) != -1).select(id_col, vec, F.col(label).alias("_k"))
    p = pinned(p, "metric-points")
    cents = dim_means(p, vec, ["_k"])
    mu = dim_means(p, vec, []).first()["mu"]
    mu_c = F.array(*[F.lit(float(x)) for x in mu])
    pj = p.join(cents, "_k")
    disp = pj.groupBy("_k").agg(F.sum(sqdist(F.col(vec), F.col("mu"))).alias("wss"),
                                F.avg(F.sqrt(sqdist(F.col(vec), F.col("mu")))).alias("S"),
                                F.count(F.lit(1)).alias("n_c"))
    c = cents.join(disp, "_k")
    n = p.count()
    k = n_clusters
    ch = c.agg(((F.sum(F.col("n_c") * sqdist(F.col("mu"), mu_c)) / (k - 1)) /
                (F.sum("wss") / (n - k))).alias("ch")).first()[0]
    # worst ratio per cluster over tiles of centres
    c = c.select(F.col("_k").cast("long").alias("_k"), "mu", "S")
    db = tile_apply(c, ["_k", "mu", "S"], _worst_ratio, "k long, r double").groupBy("k").agg(F.max("r").alias("r")).agg(F.avg("r")).first()[0]
    sil = silhouette(p.withColumnRenamed("_k", label), id_col, vec, label).first()[0]
    return points.sparkSession.createDataFrame(
        [(sil, ch, db, int(k))], "silhouette double, calinski_harabasz double, davies_bouldin double, n_clusters int")


def adjusted_rand(df: DataFrame, a: str, b: str, drop_noise: bool = True) -> DataFrame:
    """ARI between two labelings (rows with -1 in either dropped)."""
    d = df.filter((F.col(a) != -1) & (F.col(b) != -1)) if drop_noise else df
    c2 = lambda x: x * (x - 1) / 2.0
    cont = d.groupBy(a, b).agg(F.count(F.lit(1)).alias("nij"))
    sa = cont.groupBy(a).agg(F.sum("nij").alias("ai")).agg(F.sum(c2(F.col("ai"))).alias("sa"))
    sb = cont.groupBy(b).agg(F.sum("nij").alias("bj")).agg(F.sum(c2(F.col("bj"))).alias("sb"))
    tot = cont.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    sa_v, sb_v = sa.scalar(), sb.scalar()
    sij, n = tot.select("sij").scalar(), tot.select("n").scalar()
    exp = sa_v * sb_v / c2(n)
    mx = (sa_v + sb_v) / 2
    ari = F.when(mx - exp == 0, F.lit(1.0)).otherwise((sij - exp) / (mx - exp))
    return d.sparkSession.range(1).select(ari.alias("ari"))

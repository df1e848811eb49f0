"""Automatic eps and DBSCAN.

eps: k-th neighbour distances (pivot index), sorted with a distributed global
index, knee = arg-max of the second difference (joins on index + 1, + 2).
DBSCAN: pivot index, core = degree >= min_samples (self included), connected components
of core points in logarithmic rounds over a spanning forest of each pair of blocks (the radius graph itself is never written),
cluster number = rank of each component's smallest core id, border points -> smallest neighbouring
cluster, everything else -1.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned
from ..components import components
from ..ordering import global_index
from .metric_index import Meeting, build_index, degrees, knn_distances, least_near, spanning_links


def knee(values: DataFrame, value: str) -> DataFrame:
    """Sorted values d, knee = argmax(d[i+2] - 2 d[i+1] + d[i]) + 1 (first on ties); n < 3 -> n // 2.

    Returns one row (knee_idx, value_at_knee, n)."""
    idx = global_index(values.select(value), [value], "i")
    n = idx.count()
    if n < 3:
        k = n // 2
        return idx.filter(F.col("i") == k).select(F.lit(k).alias("knee_idx"), F.col(value).alias("eps"), F.lit(n).alias("n"))
    a = idx.select("i", F.col(value).alias("d0"))
    b = idx.select((F.col("i") - 1).alias("i"), F.col(value).alias("d1"))
    c = idx.select((F.col("i") - 2).alias("i"), F.col(value).alias("d2"))
    d2 = a.join(b, "i").join(c, "i").select("i", (F.col("d2") - 2 * F.col("d1") + F.col("d0")).alias("dd"))
    arg = d2.agg(F.min_by("i", F.struct(-F.col("dd"), F.col("i"))).alias("k")).select((F.col("k") + 1).alias("knee_idx"))
    return arg.join(idx.select(F.col("i").alias("knee_idx"), F.col(value).alias("eps")), "knee_idx") \
        .select("knee_idx", "eps", F.lit(n).alias("n"))


def auto_eps(points: DataFrame, id_col: str, vec: str, k: int = 5) -> DataFrame:
    """Knee of the sorted k-distances (self counted, k = min(5, n - 1))."""
    n = points.count()
    kk = min(k, n - 1)
    kd = knn_distances(points, id_col, vec, kk)
    return knee(kd, "kdist")


def dbscan(points: DataFrame, id_col: str, vec: str, eps: float, min_samples: int = 3) -> DataFrame:
    """(id, cluster) with -1 for noise."""
    index = build_index(points, id_col, vec)
    if index is None:
        return points.select(id_col, F.lit(-1).alias("cluster"))
    meeting = Meeting(index, radius=float(eps))
    placed = pinned(meeting.points, "dbscan-points")
    core = pinned(degrees(meeting, float(eps)).filter(F.col("deg") >= min_samples).select(F.col("i").alias("u")), "dbscan-core")
    cc = spanning_links(meeting, placed.join(core.withColumnRenamed("u", "id"), "id", "left_semi"), float(eps))
    lab, _ = components(core.select(F.col("u").alias("node")), cc)
    lab = lab.select(F.col("node").alias("u"), F.col("component").alias("lab"))
    num = global_index(lab.select("lab").distinct(), ["lab"], "cluster")
    core_lab = lab.join(num, "lab").select("u", "cluster")
    known = placed.join(core_lab.select(F.col("u").alias("id"), "cluster"), "id", "left").select("id", "vec", "block", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    border = least_near(meeting, known, float(eps))
    out = points.select(F.col(id_col).alias("u")).join(core_lab, "u", "left") \
        .join(border.withColumnRenamed("i", "u"), "u", "left")
    return out.select(F.col("u").alias(id_col), F.coalesce("cluster", "bc", F.lit(-1)).cast("int").alias("cluster"))

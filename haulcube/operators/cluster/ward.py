"""Ward agglomerative clustering by reciprocal-nearest-neighbour rounds (M7, M8).

Ward linkage is reducible: every pair of mutual nearest neighbours can be merged in the same round without
changing the hierarchy, and a merged pair is never nearer to a third cluster than both its halves.  So a table of nearest
neighbours is kept between rounds; only new clusters and those whose neighbour was merged search again (block-tiled).
Equal distances go to the smaller id at every size, so the least pair of all is always mutual and each round merges.
A round is two written tables.  Merge heights are sorted into the usual linkage table at the end.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import pinned
from ..components import flatten
from ..ordering import global_index
from .pairs import BLOCK_ROWS, ward_nearest


def ward_linkage(points: DataFrame, id_col: str, vec: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Linkage table: (step, left, right, height, size); leaves are 0..n-1 by id order."""
    spark = points.sparkSession
    numbered = global_index(points.select(id_col), [id_col], "cid").select(id_col, F.col("cid").cast("long").alias("cid"))
    leaves = pinned(numbered.join(points.select(id_col, vec), id_col), "ward-leaves")
    n = leaves.count()
    if n < 2:                                            # no merges
        return spark.createDataFrame([], "step long, left long, right long, height double, size long"), leaves.select(id_col, "cid")
    active = leaves.select("cid", F.lit(1).cast("long").alias("size"), F.col(vec).cast("array<double>").alias("c"))
    state = pinned(active.join(ward_nearest(active, active, n, block_rows), "cid"), "ward-state")
    merges, left, rounds = None, n, 0
    while left > 1:
        rounds += 1
        a = state.select(F.col("cid").alias("l"), F.col("nn").alias("r"), F.col("d").alias("h"), F.col("size").alias("sl"), F.col("c").alias("cl"))
        b = state.select(F.col("cid").alias("r"), F.col("nn").alias("l"), F.col("size").alias("sr"), F.col("c").alias("cr"))
        tot = F.col("sl") + F.col("sr")
        centre = F.zip_with("cl", "cr", lambda x, y: (x * F.col("sl") + y * F.col("sr")) / tot)
        # a leaf is in one merge a round, so leaf number + round * n is a new id, and above all older ones
        new = a.where("l < r").join(b, ["l", "r"]).select((F.pmod("l", F.lit(n)) + F.lit(rounds * n)).alias("m"), "l", "r", "h", tot.alias("size"), centre.alias("c"))
        new = pinned(new, "ward-merged")
        left -= new.count()
        rec = new.select("m", "l", "r", "h", "size")
        merges = rec if merges is None else merges.unionByName(rec)
        if left == 1:
            break
        gone = new.select(F.explode(F.array("l", "r")).alias("cid"))
        stay = state.join(gone, "cid", "left_anti")
        lost = gone.select(F.col("cid").alias("nn"))
        kept = stay.join(lost, "nn", "left_anti").select("cid", "size", "c", "nn", "d")
        asking = stay.join(lost, "nn", "left_semi").select("cid", "size", "c").unionByName(new.select(F.col("m").alias("cid"), "size", "c"))
        active = kept.select("cid", "size", "c").unionByName(asking)
        state = pinned(kept.unionByName(asking.join(ward_nearest(asking, active, left, block_rows), "cid")), "ward-state")
    # order merges by height; internal ids -> n + step
    steps = pinned(global_index(merges, ["h", "m"], "step"), "ward-steps")
    idmap = steps.select(F.col("m").alias("_m"), (F.lit(n) + F.col("step")).alias("_new"))

    def remap(c):
        return F.when(F.col(c) < n, F.col(c)).otherwise(F.col(f"{c}_new"))
    s = steps.join(idmap.withColumnRenamed("_m", "l").withColumnRenamed("_new", "l_new"), "l", "left") \
        .join(idmap.withColumnRenamed("_m", "r").withColumnRenamed("_new", "r_new"), "r", "left")
    lk = s.select("step", F.least(remap("l"), remap("r")).alias("left"), F.greatest(remap("l"), remap("r")).alias("right"),
                  F.col("h").alias("height"), F.col("size"))
    return pinned(lk, "ward-linkage"), leaves.select(id_col, "cid")


def cut_tree(linkage: DataFrame, leaves: DataFrame, id_col: str, k: int) -> DataFrame:
    """M8: at most k clusters = components after the n - k lowest merges; labels 1..k by the number of their top node."""
    return cut_tree_all(linkage, leaves, id_col, [k]).select(id_col, "cluster")


def cut_tree_all(linkage: DataFrame, leaves: DataFrame, id_col: str, k_values) -> DataFrame:
    """(id, k, cluster) of the cuts at every k, by one chain of pointer jumps."""
    n = leaves.count()
    ks = F.explode(F.array(*(F.lit(int(k)) for k in k_values)))
    if n == 0:
        return leaves.select(id_col, ks.alias("k"), F.lit(1).alias("cluster"))
    at = F.lit(n) + F.col("step")
    merged = linkage.select("step", at.alias("parent"), F.explode(F.array("left", "right")).alias("child"), ks.alias("k")).where(F.col("step") < n - F.col("k"))
    below = merged.select(F.struct("k", F.col("child").alias("id")).alias("node"), F.struct("k", F.col("parent").alias("id")).alias("parent"))
    tops = leaves.select(F.col("cid").alias("id"), ks.alias("k")).unionByName(merged.select(F.col("parent").alias("id"), "k").distinct())
    tops = tops.select(F.struct("k", "id").alias("node"))
    nodes = tops.join(below, "node", "left").select("node", F.coalesce("parent", "node").alias("parent"))
    flat = flatten(pinned(nodes, "cut-nodes")).where(F.col("node.id") < n)
    flat = flat.select(F.col("node.k").alias("k"), F.col("node.id").alias("cid"), F.col("parent.id").alias("top"))
    roots = global_index(flat.select("k", "top").distinct(), ["k", "top"], "i")
    first = roots.groupBy("k").agg(F.min("i").alias("i0"))
    roots = roots.join(first, "k").select("k", "top", (F.col("i") - F.col("i0") + 1).cast("int").alias("cluster"))
    return leaves.join(flat, "cid").join(roots, ["k", "top"]).select(id_col, "k", "cluster")

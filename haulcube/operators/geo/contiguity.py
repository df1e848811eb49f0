"""Queen contiguity, row standardisation and Moran's I.

Adjacency is an equi-join of polygon vertices on their coordinates (each
vertex is shared by a handful of polygons, so the join output is linear in
the number of vertices).  Moran's I and its permutation test are joins of the
edge list with the centred values; the permutations are generated as data
(permutation id x unit), so all of them run as one distributed job.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import global_index


def queen_edges(polys: DataFrame, pid: str) -> DataFrame:
    """Directed pairs (i, j), i != j, of polygons sharing at least one vertex."""
    v = polys.select(F.col(pid).alias("_id"), F.explode(F.flatten("rings")).alias("p")) \
        .select("_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    a, b = v.withColumnRenamed("_id", "i"), v.withColumnRenamed("_id", "j")
    return a.join(b, ["x", "y"]).filter(F.col("i") != F.col("j")).select("i", "j").distinct()


def row_standardise(edges: DataFrame) -> DataFrame:
    """w_ij = 1 / degree(i)."""
    deg = edges.groupBy("i").agg(F.count(F.lit(1)).alias("_deg"))
    return edges.join(deg, "i").select("i", "j", (1.0 / F.col("_deg")).alias("w"))


def centred(values: DataFrame, pid: str, value: str) -> DataFrame:
    """Centred values, one row per unit, checkpointed (reliably) because every
    statistic below reads them several times and the upstream plan is the
    whole fact pipeline."""
    v = values.select(F.col(pid).alias("u"), F.col(value).alias("_v")).checkpoint(eager=True)
    mean = v.agg(F.avg("_v")).first()[0]
    return v.select("u", (F.col("_v") - F.lit(mean)).alias("z"))


def morans_i(values: DataFrame, weights: DataFrame, pid: str, value: str) -> DataFrame:
    """I = n / S0 * sum_ij w_ij z_i z_j / sum_i z_i^2 (units = rows of `values`)."""
    z = centred(values, pid, value)
    n, ss = z.agg(F.count(F.lit(1)), F.sum(F.col("z") * F.col("z"))).first()
    zi, zj = z.select(F.col("u").alias("i"), F.col("z").alias("zi")), z.select(F.col("u").alias("j"), F.col("z").alias("zj"))
    j = weights.join(zi, "i").join(zj, "j")
    agg = j.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0"))
    return agg.select((n / F.col("s0") * F.col("num") / ss).alias("I"), F.lit(n).alias("n"), F.col("s0"))


def moran_permutation_test(values: DataFrame, weights: DataFrame, pid: str, value: str,
                           permutations: int = 999, seed: int = 12345) -> DataFrame:
    """Pseudo p-value and z of I under random relabelling of the values.

    Every unit row is exploded into `permutations` copies (no cross join); in
    permutation p the values are re-ranked by a seeded hash of (p, unit) and
    handed to the unit of the same rank.  One window per permutation holds
    only the units (not the facts), and the edge joins run for all p at once.
    """
    # four scalars of the observed statistic (one-row results) parameterise the permutation job
    z = centred(values, pid, value)
    w = weights.checkpoint(eager=True)
    row = morans_i(values, w, pid, value).first()
    i_obs, n, s0 = F.lit(row["I"]), row["n"], row["s0"]
    ss = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    weights = w
    ranked = global_index(z.select("u", "z"), ["u"], "r")
    rep = ranked.select("u", "r", "z", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    shuffled = rep.select("perm", "z", (F.row_number().over(
        Window.partitionBy("perm").orderBy(F.xxhash64(F.col("perm"), F.col("u"), F.lit(seed)), "u")) - 1).alias("r"))
    perm_vals = shuffled.join(ranked.select("u", "r"), "r").select("perm", "u", "z")
    zi = perm_vals.select("perm", F.col("u").alias("i"), F.col("z").alias("zi"))
    zj = perm_vals.select("perm", F.col("u").alias("j"), F.col("z").alias("zj"))
    per = weights.join(zi, "i").join(zj, ["perm", "j"]).groupBy("perm").agg(
        F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"))
    ip = per.select((n / s0 * F.col("num") / ss).alias("ip"))
    larger = F.count_if(F.col("ip") >= i_obs)
    larger = F.when(larger > permutations / 2, permutations - larger).otherwise(larger)
    return ip.agg(i_obs.alias("I"), ((larger + 1) / F.lit(permutations + 1)).alias("p_sim"),
                  ((i_obs - F.avg("ip")) / F.stddev_pop("ip")).alias("z_sim"),
                  F.avg("ip").alias("mean_perm"), F.count(F.lit(1)).alias("permutations"))

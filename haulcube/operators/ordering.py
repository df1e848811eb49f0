"""Distributed global row index (no single-partition window over the data).

Range-partition by the order key, number rows inside each range partition,
then add the prefix count of the preceding partitions (a table with one row
per partition).  The intermediate is checkpointed so both uses see one
consistent partitioning even after an executor loss.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order_cols, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the total order given by `order_cols`."""
    # a hash of the whole row breaks ties, so a value shared by a third of the rows
    # is still split across range partitions instead of landing in one task
    tb = F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tb")
    order = list(order_cols) + ["_tb"]
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.select("*", tb).repartitionByRange(p, *order).withColumn("_pid", F.spark_partition_id())
    r = r.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    r = r.checkpoint(eager=True)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return r.join(F.broadcast(offs), "_pid").select(
        *[c for c in df.columns], (F.col("_off") + F.col("_lr") - 1).alias(out))


def value_ranks(df: DataFrame, keys, value: str, partitions: int | None = None) -> DataFrame:
    """(keys, value, n, lo, hi, total): counts of the distinct non-null values and the ranks lo..hi-1 they hold.

    The counts combine map-side; ranks are range-partitioned running sums plus the offsets of the
    partitions before (one row per partition and key), so no task holds a key's values at once.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vc = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    r = vc.repartitionByRange(p, *keys, value).withColumn("_pid", F.spark_partition_id())
    r = r.withColumn("_run", F.sum("n").over(Window.partitionBy("_pid", *keys).orderBy(value)
                                             .rowsBetween(Window.unboundedPreceding, 0))).checkpoint(eager=True)
    per = r.groupBy("_pid", *keys).agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*keys)
    offs = per.select("_pid", *keys, F.coalesce(F.sum("_n").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0)).alias("_off"), F.sum("_n").over(w).alias("total"))
    cond = ["_pid", *keys]
    hi = F.col("_off") + F.col("_run")
    return r.join(offs, cond).select(*keys, value, "n", (hi - F.col("n")).alias("lo"), hi.alias("hi"), "total")


def quantiles_of(ranks: DataFrame, keys, value: str, probs) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles with linear interpolation, by rank selection on `value_ranks`."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = F.col(value).cast("double")
    aggs, out = [], []
    for k, p in enumerate(probs):
        at = F.lit(p) * (F.col("total") - 1)
        for name, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), v)).alias(f"_{name}{k}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f{k}"))
        a, b, f = F.col(f"_a{k}"), F.col(f"_b{k}"), F.col(f"_f{k}")
        out.append((a + (b - a) * f).alias(f"q{k}"))
    return ranks.groupBy(*keys).agg(*aggs).select(*keys, *out)


def quantiles(df: DataFrame, keys, value: str, probs) -> DataFrame:
    """Exact quantiles of `value` per key (no keys: one row)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    one = not keys
    src = df.select(F.lit(0).alias("_all"), value) if one else df.select(*keys, value)
    q = quantiles_of(value_ranks(src, ["_all"] if one else keys, value), ["_all"] if one else keys, value, probs)
    return q.drop("_all") if one else q

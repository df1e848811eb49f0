"""Distributed global index: total order, dense 0..n-1, hot values split across partitions."""
from pyspark.sql import functions as F

from haulcube.operators.ordering import global_index


def test_global_index_with_hot_value(spark):
    n = 2000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("v"),
                               F.col("id"))
    idx = global_index(df, ["v"], "i")
    rows = idx.select("v", "i", "_pid").collect() if "_pid" in idx.columns else idx.select("v", "i").collect()
    got = sorted(rows, key=lambda r: r["i"])
    assert [r["i"] for r in got] == list(range(n))
    vals = [r["v"] for r in got]
    assert vals == sorted(vals)
    # the hot value (half of all rows) is not confined to one range partition
    parts = (df.select("v", F.xxhash64("v", "id").alias("_tb")).repartitionByRange(8, "v", "_tb")
             .filter(F.col("v") == 7.0).select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_quantiles_equal_numpy(spark):
    import numpy as np
    from haulcube.operators.ordering import quantiles
    rnd = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rnd.integers(0, 5, 500)] + [("wide", float(x)) for x in rnd.normal(size=301)] + [("one", 4.0), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: list(r)[1:] for r in quantiles(df, "k", "v", probs).collect()}
    for k in ("hot", "wide", "one"):
        assert np.allclose(got[k], np.quantile([v for g, v in rows if g == k and v is not None], probs))
    assert np.allclose(list(quantiles(df, [], "v", probs).first()), np.quantile([v for _, v in rows if v is not None], probs))

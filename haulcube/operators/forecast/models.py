"""Spark ML forecasters.

Global models train on the feature table of all groups at once: a gradient
boosted tree ensemble (two labelled configurations) and a linear regressor on
the flattened, standardised 52 x 3 sequence windows.  Both forecast one step
ahead with the real lagged values of the test period (N21).
"""
from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import pinned
from ..features import SEQ_COLS, cutoff_of, feature_columns, gb_features, seq_scaling, sequences

# Fixed hyper-parameters of the original boosting runs (trees, depth, rate, sampling).
BOOST_TREES, BOOST_DEPTH, BOOST_RATE, BOOST_SAMPLE = 500, 6, 0.05, 0.8
# The two runs differ in how their trees grow: by depth alone, or with at most 2^5 leaves of at least 20 rows.
BOOST_CONFIGS = {"GBT by depth": {"seed": 42}, "GBT by leaves": {"seed": 42, "maxDepth": 5, "minInstancesPerNode": 20, "maxBins": 255}}
#: Rows of the training table in one task: a tree is a chain of short jobs, so few tasks are enough.
ROWS_PER_TASK = 100_000


def assemble(df: DataFrame, features, label: str, out: str = "features") -> DataFrame:
    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip")
    return va.transform(df).withColumn("label", F.col(label).cast("double"))


def gradient_boosting(cube: DataFrame, group: str = "District_Code", y: str = "tons_refuse",
                      trees: int = BOOST_TREES, configs: dict | None = None):
    """Returns (predictions, importance table of the first configuration, {label: model}).

    All fits read one written training table of few partitions and run as concurrent jobs of the session.
    """
    configs = BOOST_CONFIGS if configs is None else configs
    f = gb_features(cube, group, y).dropna("any")           # N22: a null anywhere drops the row
    cols = feature_columns(f)
    f = pinned(f, "boost-features")
    cut = cutoff_of(cube)
    tasks = max(1, math.ceil(f.count() / ROWS_PER_TASK))
    train = assemble(f.filter(F.col("week_start") <= cut), cols, y).select("features", "label").coalesce(tasks).persist()
    test = assemble(f.filter(F.col("week_start") > cut), cols, y)

    def fit(extra):
        settings = {"maxIter": trees, "maxDepth": BOOST_DEPTH, "stepSize": BOOST_RATE, "subsamplingRate": BOOST_SAMPLE,
                    "featureSubsetStrategy": str(BOOST_SAMPLE)}
        return GBTRegressor(**{**settings, **extra}).fit(train)
    try:
        with ThreadPoolExecutor(len(configs)) as pool:
            models = dict(zip(configs, pool.map(inheritable_thread_target(cube.sparkSession)(fit), configs.values())))
    finally:
        train.unpersist()
    preds = None
    for label, m in models.items():
        p = m.transform(test).select(group, "week_start", F.col(y).alias("y_true"),
                                     F.col("prediction").alias("y_pred"), F.lit(label).alias("model"))
        preds = p if preds is None else preds.unionByName(p)
    return preds, importance(next(iter(models.values())), cols), models


def importance(model, cols) -> DataFrame:
    spark = SparkSession.getActiveSession()
    rows = list(zip(cols, [float(v) for v in model.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def sequence_regressor(cube: DataFrame, group: str = "District_Code", lookback: int = 52, reg: float = 1e-3):
    """T7 re-aimed: standardised flattened windows -> ridge regression -> de-standardised forecast."""
    seqs = sequences(cube, group, lookback).checkpoint(eager=True)
    cut = cutoff_of(cube)
    train = seqs.filter(F.col("week_start") <= cut)
    sc = seq_scaling(train).first()                         # train-only statistics (A35)
    mean = [sc[f"{c}_mean"] for c in SEQ_COLS]
    std = [sc[f"{c}_std"] for c in SEQ_COLS]
    flat = F.flatten(F.transform("window", lambda v: F.array(*[(v[i] - F.lit(mean[i])) / F.lit(std[i]) for i in range(len(SEQ_COLS))])))
    d = seqs.select(group, "week_start", "target", array_to_vector(flat).alias("features"),
                    ((F.col("target") - F.lit(sc["y_mean"])) / F.lit(sc["y_std"])).alias("label"))
    m = LinearRegression(regParam=reg, elasticNetParam=0.0).fit(d.filter(F.col("week_start") <= cut))
    out = m.transform(d.filter(F.col("week_start") > cut))
    return out.select(group, "week_start", F.col("target").alias("y_true"),
                      (F.col("prediction") * F.lit(sc["y_std"]) + F.lit(sc["y_mean"])).alias("y_pred"),
                      F.lit("Window ridge").alias("model"))

"""Time-series features per group.

Every window is partitioned by the group key, so one group's series is one
window partition: its size is bounded by the calendar (weeks), not by the
number of loads, because the weekly cube has already aggregated them.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lags, rolling widths and sequence columns of the feature tables.
LAGS = (1, 2, 4, 13, 26, 52)
ROLLS = (4, 13, 52)
SEQ_COLS = ("tons_refuse", "tons_paper", "tons_mgp")


def cutoff_of(df: DataFrame, time: str = "week_start", weeks: int = 52) -> Column:
    """Global max(time) - n weeks as a lazy scalar subquery."""
    return df.select(F.date_sub(F.max(time), 7 * weeks)).scalar()


def temporal_split(df: DataFrame, time: str = "week_start", weeks: int = 52):
    """train = time <= cutoff, test = time > cutoff (global max, not per group)."""
    c = cutoff_of(df, time, weeks)
    return df.filter(F.col(time) <= c), df.filter(F.col(time) > c)


def add_lags(df: DataFrame, group: str, y: str, lags=LAGS, time: str = "week_start") -> DataFrame:
    """lag_n per group (row order, N8)."""
    w = Window.partitionBy(group).orderBy(time)
    return df.select("*", *[F.lag(y, n).over(w).alias(f"lag_{n}") for n in lags])


def add_rolling_excl(df: DataFrame, group: str, y: str, windows=ROLLS, time: str = "week_start",
                     std: bool = True) -> DataFrame:
    """Mean and sample std over the previous n rows, excluding the current one."""
    w = Window.partitionBy(group).orderBy(time)
    cols = []
    for n in windows:
        fr = w.rowsBetween(-n, -1)
        cols.append(F.avg(y).over(fr).alias(f"roll_mean_{n}"))
        if std:
            cols.append(F.stddev_samp(y).over(fr).alias(f"roll_std_{n}"))
    return df.select("*", *cols)


def category_codes(df: DataFrame, group: str, out: str) -> DataFrame:
    """0-based alphabetical code, ranked on the distinct key list only and joined back."""
    codes = df.select(group).distinct().select(
        group, (F.dense_rank().over(Window.orderBy(group)) - 1).alias(out))
    return df.join(F.broadcast(codes), group)


def cyclical(x: Column, period: float):
    """sin/cos encoding."""
    a = 2 * math.pi * x / period
    return F.sin(a), F.cos(a)


def gb_features(cube: DataFrame, group: str = "District_Code", y: str = "tons_refuse",
                code_col: str = "district_encoded") -> DataFrame:
    """Lags, rolling mean/std, calendar parts and cyclical encodings, group code."""
    df = cube.select(group, "week_start", y)
    df = add_rolling_excl(add_lags(df, group, y), group, y)
    ws = F.col("week_start")
    ms, mc = cyclical(F.month(ws), 12)
    wsn, wcs = cyclical(F.weekofyear(ws), 52)
    df = df.select("*", F.month(ws).alias("month"), F.weekofyear(ws).alias("week_of_year"),
                   F.year(ws).alias("year"), ms.alias("month_sin"), mc.alias("month_cos"),
                   wsn.alias("week_sin"), wcs.alias("week_cos"))
    return category_codes(df, group, code_col)


# Names of the model features.
FEATURE_PREFIXES = ("lag_", "roll_", "district_")
CALENDAR_FEATURES = ["year", "month", "week_of_year", "month_sin", "month_cos", "week_sin", "week_cos"]


def feature_columns(df: DataFrame, prefixes=FEATURE_PREFIXES) -> list[str]:
    """Case-sensitive prefix selection from the schema, plus calendar features."""
    cols = [c for c in df.columns if c.startswith(tuple(prefixes))]
    return cols + [c for c in CALENDAR_FEATURES if c in df.columns]


def sequences(cube: DataFrame, group: str = "District_Code", lookback: int = 52,
              cols=SEQ_COLS, target: str = "tons_refuse") -> DataFrame:
    """Previous `lookback` rows x len(cols) as one array, only where all exist."""
    w = Window.partitionBy(group).orderBy("week_start")
    seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w.rowsBetween(-lookback, -1))
    d = cube.select(group, "week_start", F.col(target).alias("target"),
                    F.row_number().over(w).alias("_rn"), seq.alias("window"))
    return d.filter(F.col("_rn") > lookback).drop("_rn")


def even_selection(df: DataFrame, key: str, n: int) -> DataFrame:
    """N evenly spaced keys from the ordered distinct list (numpy linspace, int cast)."""
    d = df.select(key).distinct()
    total = d.select(F.count(F.lit(1))).scalar()
    r = d.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("_i"))
    picks = df.sparkSession.range(n).select(
        F.floor(F.col("id") * (total - 1) / F.lit(max(n - 1, 1))).cast("int").alias("_i"))
    return r.join(picks, "_i", "left_semi").drop("_i")


def acf(df: DataFrame, group: str, time: str, y: str, max_lag: int = 104) -> DataFrame:
    """r_k = sum (x_t - m)(x_{t+k} - m) / sum (x_t - m)^2, biased, per series.

    A series is bounded by the calendar, so each group is collected once (ordered by time) and the
    lags are folded over the array: one shuffle, no self-join.
    """
    s = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(y).cast("double").alias("x")))).alias("s"),
                              F.avg(y).alias("m"))
    s = s.select(group, F.transform("s", lambda p: F.coalesce(p["x"] - F.col("m"), F.lit(0.0))).alias("d"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    s = s.select(group, "d", F.size("d").alias("n"), dot(F.col("d"), F.col("d")).alias("den"))
    s = s.select(group, "d", "n", "den", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_lag), F.col("n") - 1))).alias("k"))
    num = dot(F.slice("d", 1, F.col("n") - F.col("k")), F.slice("d", F.col("k") + 1, F.col("n") - F.col("k")))
    return s.select(group, "k", F.try_divide(num, F.col("den")).alias("acf"))


def seq_scaling(seqs: DataFrame, cols=SEQ_COLS) -> DataFrame:
    """Per-feature mean and population std over all cells of all windows (+1e-8)."""
    cells = seqs.select(F.explode("window").alias("v"))
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col("v")[i]).alias(f"{c}_mean"), (F.stddev_pop(F.col("v")[i]) + 1e-8).alias(f"{c}_std")]
    y_mean = seqs.select(F.avg("target")).scalar()
    y_std = seqs.select(F.stddev_pop("target") + 1e-8).scalar()
    return cells.agg(*aggs).select("*", y_mean.alias("y_mean"), y_std.alias("y_std"))

"""Profiling operators.

All single-pass aggregates with map-side partial aggregation; wide results
(column lists, matrices) are produced long-form so they scale with the data
rather than with a driver-side loop.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullsafe import safe_div
from .ordering import quantiles, quantiles_of, value_ranks

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols, group: str | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max (long form per column with any value)."""
    keys = ["column", *([group] if group else [])]
    long = df.select(*([group] if group else []), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_x")).select(
        *([group] if group else []), "_x.column", "_x.v")
    # the value counts are made in one scan; everything else is read off them
    ranks = value_ranks(long, keys, "v")
    n, m = F.col("n"), F.sum("n")
    # deviations from the mean, and what rounding left in it: no digits are lost when the mean is large against the spread
    means = ranks.groupBy(*keys).agg((F.sum(F.col("v") * n) / m).alias("_m"))
    ranks = ranks.join(means, keys)
    off = F.col("v") - F.col("_m")
    s1, s2 = F.sum(off * n), F.sum(off * off * n)
    base = ranks.groupBy(*keys).agg(
        m.alias("count"), (F.first("_m") + s1 / m).alias("mean"),
        F.when(m > 1, F.sqrt(F.greatest(s2 - s1 * s1 / m, F.lit(0.0)) / F.nullif(m - 1, F.lit(0)))).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles_of(ranks, keys, "v", QUARTILES)
    return base.join(q, keys).select(*([group] if group else []), "column", "count", "mean", "std", "min",
                                     F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent per column (non-zero only), one pass over the data."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    long = wide.unpivot("_n", df.columns, "column", "null_count")
    return (long.filter(F.col("null_count") > 0)
                .select("column", "null_count",
                        F.round(F.col("null_count") * 100.0 / F.col("_n"), 2).alias("null_pct")))


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column with its type (long form).

    The distinct (column, value) rows are made by a first aggregation, which combines before its shuffle, and counted by a second.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if exact:
        value = [F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v"), F.col(c).isNotNull().alias("some")) for c in df.columns]
        rows = df.select(F.explode(F.array(*value)).alias("x")).select("x.*")
        long = rows.distinct().groupBy("column").agg(F.count_if("some").alias("n_distinct"))
    else:
        long = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_distinct")
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return long.select("column", tmap[F.col("column")].alias("dtype"), "n_distinct")


def value_counts(df: DataFrame, col: str, by_key: bool = False) -> DataFrame:
    """Frequencies; ordered by count desc (ties by key) or by key."""
    vc = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return vc.orderBy(col) if by_key else vc.orderBy(F.desc("count"), F.col(col))


def histogram(df: DataFrame, col: str, bins: int = 50, lo: Column | None = None,
              hi: Column | None = None) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), optional clip bounds.

    The bounds are scalar subqueries, so the whole histogram is one lazy plan.
    """
    x = F.col(col).cast("double")
    if lo is not None or hi is not None:
        x = F.greatest(F.least(x, hi if hi is not None else x), lo if lo is not None else x)
    d = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    mn = d.select(F.min("_x")).scalar()
    mx = d.select(F.max("_x")).scalar()
    width = (mx - mn) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - mn) / width), F.lit(bins - 1))).cast("int")
    return (d.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
             .select("bin", (mn + F.col("bin") * width).alias("bin_lo"),
                     (mn + (F.col("bin") + 1) * width).alias("bin_hi"), "count"))


def box_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles (linear), IQR whiskers = most extreme values inside 1.5*IQR."""
    q = quantiles(df, group, value, QUARTILES).toDF(group, "q1", "median", "q3")
    j = df.select(group, value).join(q, group)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))


def corr_long(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every column pair, long form (a, b, r), one pass."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                         F.col(f"{a}__{b}").alias("r")) for a, b in pairs]))
    return wide.select(stack.alias("s")).select("s.a", "s.b", "s.r")


#: Series in one tile of the correlation matrix.
CORR_TILE = 256


def group_corr(df: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """(g1, g2, r, n): Pearson correlation between the series of every pair of groups, pairwise complete.

    A series is one row (the calendar bounds it); pairs of tiles of at most CORR_TILE series meet in a call, which works on
    deviations from each series' own mean, so no digits are lost when means are large.  Only the pairs' results leave it.
    """
    import numpy as np
    import pandas as pd
    from ..session import pinned
    from .cluster.pairs import tile_apply

    s = df.select(group, F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).alias("t"), F.col(value).cast("double").alias("v"))
    rows = s.groupBy(group).agg(F.collect_list(F.struct("t", F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("o"))
    rows = pinned(rows.select(F.col(group).alias("g"), F.col("o.t").alias("t"), F.col("o.v").alias("v")), "corr-series")

    def dense(pdf, at):
        X = np.full((len(pdf), len(at)), np.nan)
        for i, (t, v) in enumerate(zip(pdf["t"], pdf["v"])):
            X[i, np.searchsorted(at, t)] = v
        M = ~np.isnan(X)
        X = np.where(M, X, 0.0)
        X -= M * (X.sum(1) / np.maximum(M.sum(1), 1))[:, None]
        return X, M.astype(float)

    def fn(l, r):
        out = pd.DataFrame({"g1": pd.Series(dtype=object), "g2": pd.Series(dtype=object), "r": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        if l.empty or r.empty:
            return out
        at = np.unique(np.concatenate([*l["t"], *r["t"]]))
        (X, M), (Y, N) = dense(l, at), dense(r, at)
        n, sx, sy = M @ N.T, X @ N.T, M @ Y.T
        vx, vy = n * ((X * X) @ N.T) - sx * sx, n * (M @ (Y * Y).T) - sy * sy
        cov = n * (X @ Y.T) - sx * sy
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.where((n > 1) & (vx > 0) & (vy > 0), cov / np.sqrt(vx * vy), np.nan)
        g1, g2 = l["g"].to_numpy(), r["g"].to_numpy()
        a, b = np.nonzero((n > 0) & (g1[:, None] <= g2[None, :]))
        return pd.DataFrame({"g1": g1[a], "g2": g2[b], "r": c[a, b], "n": n[a, b].astype("int64")}) if len(a) else out
    kind = df.schema[group].dataType.simpleString()
    got = tile_apply(rows.where("g IS NOT NULL"), ["g", "t", "v"], fn, f"g1 {kind}, g2 {kind}, r double, n long", CORR_TILE)
    return got.select("g1", "g2", F.when(~F.isnan("r"), F.col("r")).alias("r"), "n")


def zscore(c: str, part, ddof: int = 1) -> Column:
    """W5/W6 helper: (x - mean) / std over a partition (std 0 -> divide by 1 for ddof 0)."""
    w = Window.partitionBy(*part) if part else Window.partitionBy()
    mu = F.avg(c).over(w)
    if ddof == 1:
        return safe_div(F.col(c) - mu, F.stddev_samp(c).over(w))
    sd = F.stddev_pop(c).over(w)
    return (F.col(c) - mu) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def argmax_by(df: DataFrame, key: str, measure: str, group: str | None = None,
              smallest: bool = False) -> DataFrame:
    """O3: arg-max (or arg-min) with a deterministic tie rule (smallest key wins)."""
    m = F.col(measure) if smallest else -F.col(measure)
    pick = F.min_by(F.col(key), F.struct(m, F.col(key)))
    g = df.groupBy(group) if group else df.groupBy()
    return g.agg(pick.alias(key))


def calendar_counts(df: DataFrame, date: str) -> DataFrame:
    """Counts per weekday in fixed Monday..Sunday order; missing days -> null count."""
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    cnt = df.groupBy(F.date_format(F.col(date).cast("date"), "EEEE").alias("day_name")).agg(
        F.count(F.lit(1)).alias("count"))
    cal = df.sparkSession.createDataFrame([(i, d) for i, d in enumerate(days)], "day_idx int, day_name string")
    return cal.join(F.broadcast(cnt), "day_name", "left")  # at most 7 aggregated rows

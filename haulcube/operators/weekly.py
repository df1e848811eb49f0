"""Weekly cube per group with trailing averages.

Plan at scale: one hash aggregate on (group, week_start) with map-side
partial aggregation (so a hot group is pre-reduced before the shuffle), the
three-stream pivot folded into that same aggregate as conditional sums, then
one small shuffle on the group for the row-frame windows.  Weeks without
loads stay absent (N8): windows count rows, not calendar weeks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import week_start
from ..functions.codes import MEASURES, STREAM_COLUMNS, STREAM_ORDER

MA_WINDOWS = {"4wk": 4, "13wk": 13, "52wk": 52}


def stream_sums(df: DataFrame, keys, code: str = "Material_Type_Code",
                value: str = "Tons_Collected") -> DataFrame:
    """A1+A2+A3+P15: sums per stream as columns (missing stream -> 0.0) and total."""
    sums = [F.sum(F.when(F.col(code) == k, F.col(value)).otherwise(F.lit(0.0))).alias(name)
            for k, name in STREAM_COLUMNS.items()]
    out = df.groupBy(*keys).agg(*sums)
    return out.withColumn("tons_total", sum((F.col(c) for c in STREAM_ORDER), F.lit(0.0)))


def trailing_means(df: DataFrame, group: str, order: str = "week_start",
                   measures=MEASURES, windows=MA_WINDOWS) -> DataFrame:
    """Trailing mean over the last n rows (min 1 row) per group."""
    base = Window.partitionBy(group).orderBy(order)
    cols = [F.avg(m).over(base.rowsBetween(-(n - 1), 0)).alias(f"{m}_ma_{s}")
            for s, n in windows.items() for m in measures]
    return df.select("*", *cols)


def weekly_cube(clean: DataFrame, group: str, date: str = "Collection_Date",
                code: str = "Material_Type_Code", value: str = "Tons_Collected") -> DataFrame:
    """A4: (group, week_start, 3 streams, total, 12 trailing means)."""
    keyed = clean.select(F.col(group), week_start(F.col(date)).alias("week_start"),
                         F.col(code), F.col(value))
    return trailing_means(stream_sums(keyed, [group, "week_start"], code, value), group)


def weekly_cube_sql(src: str, group: str, name: str = "cube") -> str:
    ma = ",\n    ".join(
        f"avg({m}) OVER (PARTITION BY {group} ORDER BY week_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {m}_ma_{s}"
        for s, n in MA_WINDOWS.items() for m in MEASURES)
    sums = ", ".join(f"sum(CASE WHEN Material_Type_Code = {k} THEN Tons_Collected ELSE 0.0 END) AS {n}"
                     for k, n in STREAM_COLUMNS.items())
    return f"""{name}_0 AS (
  SELECT {group}, CAST(Collection_Date - CAST(isodow(Collection_Date) - 1 AS INTEGER) AS DATE) AS week_start, {sums}
  FROM {src} GROUP BY 1, 2
),
{name}_w AS (
  SELECT *, tons_refuse + tons_paper + tons_mgp AS tons_total FROM {name}_0
),
{name} AS (
  SELECT *,
    {ma}
  FROM {name}_w
)"""


def citywide_weekly(cube: DataFrame, measures=MEASURES) -> DataFrame:
    """A5: sums of the measures across groups per week."""
    return cube.groupBy("week_start").agg(*[F.sum(m).alias(m) for m in measures])


def densify(df: DataFrame, group: str, time: str, value: str, fill=0.0) -> DataFrame:
    """Every group on every week seen anywhere; missing -> fill.

    Without a cross join: each group's rows carry the global first/last week
    (a one-row scalar), the full Monday sequence is exploded per group and
    semi-joined to the weeks that actually occur, then left-joined back.
    """
    # the slice is read four times below; pin it once (it is aggregated data)
    df = df.select(group, time, value).checkpoint(eager=True)
    weeks = df.select(time).distinct()
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    groups = df.select(group).distinct()
    grid = groups.select(group, F.explode(F.sequence(F.lit(lo), F.lit(hi), F.expr("INTERVAL 7 DAYS"))).alias(time))
    grid = grid.join(weeks, time, "left_semi")
    return (grid.join(df.select(group, time, value), [group, time], "left")
                .select(group, time, F.coalesce(F.col(value), F.lit(fill)).alias(value)))


def regrid(df: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """Per series, every Monday between its own first and last week; gaps null."""
    span = df.groupBy(group).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    grid = span.select(group, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 7 DAYS"))).alias(time))
    return grid.join(df.select(group, time, value), [group, time], "left")


def interpolate(df: DataFrame, group: str, time: str, value: str, out: str | None = None) -> DataFrame:
    """Linear interpolation of inner gaps by position; trailing gap holds the
    last value, leading gap stays null (pandas ``interpolate()`` default)."""
    out = out or value
    w = Window.partitionBy(group).orderBy(time)
    pos = F.row_number().over(w)
    d = df.withColumn("_pos", pos).withColumn("_kp", F.when(F.col(value).isNotNull(), F.col("_pos")))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    d = d.select("*",
                 F.last(value, True).over(back).alias("_pv"), F.last("_kp", True).over(back).alias("_pp"),
                 F.first(value, True).over(fwd).alias("_nv"), F.first("_kp", True).over(fwd).alias("_np"))
    interp = F.when(F.col(value).isNotNull(), F.col(value)) \
        .when(F.col("_pv").isNull(), F.lit(None)) \
        .when(F.col("_nv").isNull(), F.col("_pv")) \
        .otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_pos") - F.col("_pp")) / (F.col("_np") - F.col("_pp")))
    return d.withColumn(out, interp).drop("_pos", "_kp", "_pv", "_pp", "_nv", "_np")

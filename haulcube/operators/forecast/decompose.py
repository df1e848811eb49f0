"""Robust seasonal-trend split of weekly series by window expressions.

Trend: centred moving mean over one period (the two ends count half), over what there is of it at the series' ends.
Seasonal part: mean of each place in the period over the detrended values (at first, with robust rounds, their median), less its mean.  Each pass takes the trend of the
values without the last seasonal part.  Robust rounds weight every value by the bisquare of its remainder against six
median absolute remainders.  All windows are partitioned by the series, which the calendar bounds: one shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD, ROBUST, INNER = 52, 2, 2
#: Weights keep this floor, so that every mean stays defined.
FLOOR = 1e-6


def decompose(df: DataFrame, group: str, time: str, value: str, period: int = PERIOD, robust: int = ROBUST) -> DataFrame:
    """(group, time, observed, trend, seasonal, resid, status).

    A series with a null value (status `gaps`) or under two periods (`short`) keeps its rows without components.
    """
    series, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(time)
    half = period // 2
    middle = order.rowsBetween(-half + 1, half - 1) if period % 2 == 0 else order.rowsBetween(-half, half)

    def moving(c):
        total = F.sum(c).over(middle)
        if period % 2 == 0:
            total = total + (F.coalesce(F.lag(c, half).over(order), F.lit(0.0)) + F.coalesce(F.lead(c, half).over(order), F.lit(0.0))) / 2
        return total
    d = df.select(group, time, F.col(value).cast("double").alias("observed"))
    d = d.withColumn("_pos", F.row_number().over(order) - 1)
    n, gaps = F.count(F.lit(1)).over(series), F.count_if(F.col("observed").isNull()).over(series)
    d = d.withColumn("status", F.when(gaps > 0, "gaps").when(n < 2 * period, "short").otherwise("ok"))
    x = F.when(F.col("status") == "ok", F.col("observed"))
    d = d.select("*", x.alias("_x"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("seasonal"), (F.col("_pos") % period).alias("_phase"))
    phase = Window.partitionBy(group, "_phase")
    for k in range(robust + 1):
        for _ in range(INNER):
            d = d.withColumn("_wy", F.col("_w") * (F.col("_x") - F.col("seasonal")))
            d = d.withColumn("trend", moving("_wy") / moving("_w"))
            d = d.withColumn("_d", F.col("_x") - F.col("trend"))
            # before there are weights, a median keeps one outlier from bending the whole place
            centre = F.sum(F.col("_w") * F.col("_d")).over(phase) / F.sum("_w").over(phase) if k or not robust else F.median("_d").over(phase)
            d = d.withColumn("_mean", centre)
            d = d.withColumn("seasonal", F.col("_mean") - F.avg("_mean").over(series))
        d = d.withColumn("resid", F.col("_x") - F.col("trend") - F.col("seasonal"))
        if k < robust:
            d = d.withColumn("_h", 6 * F.median(F.abs("resid")).over(series))
            u = F.col("resid") / F.col("_h")
            d = d.withColumn("_w", F.when(F.col("_h") == 0, 1.0).when(F.abs(u) < 1, F.greatest(F.pow(1 - u * u, F.lit(2.0)), F.lit(FLOOR))).otherwise(FLOOR))
    ok = F.col("status") == "ok"
    return d.select(group, time, "observed", *(F.when(ok, F.col(c)).alias(c) for c in ("trend", "seasonal", "resid")), "status")


def decompose_sql(source: str, group: str, time: str, value: str, period: int = PERIOD, robust: int = ROBUST) -> str:
    """The same steps as DuckDB common table expressions; the last is `split`."""
    half = period // 2
    series, order = f"PARTITION BY {group}", f"PARTITION BY {group} ORDER BY {time}"

    def moving(c):
        return (f"(sum({c}) OVER ({order} ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING) + "
                f"(coalesce(lag({c}, {half}) OVER ({order}), 0) + coalesce(lead({c}, {half}) OVER ({order}), 0)) / 2)")
    ctes = [f"""dec0 AS (SELECT *, CASE WHEN status = 'ok' THEN observed END AS x, 1.0::DOUBLE AS w, 0.0::DOUBLE AS seasonal, pos % {period} AS phase FROM (
  SELECT {group}, {time}, {value}::DOUBLE AS observed, row_number() OVER ({order}) - 1 AS pos,
    CASE WHEN count(*) FILTER (WHERE {value} IS NULL) OVER ({series}) > 0 THEN 'gaps' WHEN count(*) OVER ({series}) < {2 * period} THEN 'short' ELSE 'ok' END AS status
  FROM {source}))"""]
    keys, last = f"{group}, {time}, observed, status, x, phase", 0
    for k in range(robust + 1):
        for _ in range(INNER):
            a, place = last + 1, f"OVER (PARTITION BY {group}, phase)"
            centre = f"sum(w * (x - trend)) {place} / sum(w) {place}" if k or not robust else f"median(x - trend) {place}"
            ctes += [f"dec{a} AS (SELECT *, w * (x - seasonal) AS wy FROM dec{last})",
                     f"dec{a + 1} AS (SELECT {keys}, w, {moving('wy')} / {moving('w')} AS trend FROM dec{a})",
                     f"dec{a + 2} AS (SELECT *, {centre} AS m FROM dec{a + 1})",
                     f"dec{a + 3} AS (SELECT {keys}, w, trend, m - avg(m) OVER ({series}) AS seasonal FROM dec{a + 2})"]
            last = a + 3
        ctes.append(f"dec{last + 1} AS (SELECT *, x - trend - seasonal AS resid FROM dec{last})")
        last += 1
        if k < robust:
            ctes += [f"dec{last + 1} AS (SELECT *, 6 * median(abs(resid)) OVER ({series}) AS h FROM dec{last})",
                     f"dec{last + 2} AS (SELECT {keys}, seasonal, CASE WHEN h = 0 THEN 1.0 WHEN abs(resid / h) < 1 "
                     f"THEN greatest(pow(1 - (resid / h) * (resid / h), 2), {FLOOR}) ELSE {FLOOR} END AS w FROM dec{last + 1})"]
            last += 2
    return ",\n".join(ctes) + f",\nsplit AS (SELECT * FROM dec{last})"

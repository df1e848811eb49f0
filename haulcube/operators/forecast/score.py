"""Forecast scoring.

Metrics are one grouped pass with partial aggregation: SSE, MAE and MAPE as
sums, SST as population variance times count.  No join and no window over a
model's rows, so a model with billions of predictions is split over many tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..features import cutoff_of


def valid_pairs(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Both values present and not NaN."""
    return pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(y) & ~F.isnan(p))


def errors(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """signed, absolute and percent error (percent null when y = 0)."""
    e = F.col(y) - F.col(p)
    return pred.select("*", e.alias("error"), F.abs(e).alias("abs_error"),
                       F.when(F.col(y) != 0, F.abs(e) / F.abs(F.col(y)) * 100).alias("pct_error"))


def metrics(pred: DataFrame, keys, y: str = "y_true", p: str = "y_pred", digits: int | None = 6) -> DataFrame:
    """RMSE, MAE, MAPE (fraction, zeros excluded), R2 (null when SST = 0)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = valid_pairs(pred, y, p).select(*keys, F.col(y).alias("_y"), F.col(p).alias("_p"))
    e = F.col("_y") - F.col("_p")
    agg = v.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.col("_y") != 0, F.abs(e) / F.abs(F.col("_y")))).alias("mape"),
        F.sum(e * e).alias("_sse"), (F.var_pop("_y") * F.count("_y")).alias("_sst"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    out = agg.select(*keys, "rmse", "mae", "mape", r2.alias("r2"))
    if digits is not None:
        out = out.select(*keys, *[F.round(c, digits).alias(c) for c in ("rmse", "mae", "mape", "r2")])
    return out


def comparison_table(pred: DataFrame, model: str = "model") -> DataFrame:
    """Models x metrics rounded to 4 digits."""
    return metrics(pred, model, digits=4)


def best_model(table: DataFrame, model: str = "model", order: DataFrame | None = None) -> DataFrame:
    """Arg-min of the rounded RMSE, ties -> earliest model in `order` (else by name)."""
    t = table if order is None else table.join(F.broadcast(order), model)
    tie = F.col("model_order") if order is not None else F.col(model)
    return t.agg(F.min_by(model, F.struct("rmse", tie)).alias(model))


def fixed_predictions(cube: DataFrame, group: str = "District_Code", y: str = "tons_refuse",
                      horizon: int = 52) -> DataFrame:
    """T8 analogue: seasonal-naive (lag 52) and shifted 4-week mean on the hold-out weeks."""
    w = Window.partitionBy(group).orderBy("week_start")
    f = cube.select(group, "week_start", F.col(y).alias("y_true"),
                    F.lag(y, 52).over(w).alias("_naive"),
                    F.avg(y).over(w.rowsBetween(-4, -1)).alias("_ma4"))
    f = f.checkpoint(eager=True)            # both model branches and every metric read it
    test = f.filter(F.col("week_start") > f.select(F.date_sub(F.max("week_start"), 7 * horizon)).scalar())
    base = [group, "week_start", "y_true"]
    return (test.select(*base, F.col("_naive").alias("y_pred"), F.lit("NAIVE52").alias("model"))
                .unionByName(test.select(*base, F.col("_ma4").alias("y_pred"), F.lit("MA4").alias("model"))))


PREDS_SQL = """preds0 AS (
  SELECT District_Code, week_start, tons_refuse AS y_true,
    lag(tons_refuse, 52) OVER (PARTITION BY District_Code ORDER BY week_start) AS naive,
    avg(tons_refuse) OVER (PARTITION BY District_Code ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ma4
  FROM cube),
preds AS (
  SELECT District_Code, week_start, y_true, naive AS y_pred, 'NAIVE52' AS model FROM preds0
  WHERE week_start > (SELECT max(week_start) - 364 FROM cube)
  UNION ALL
  SELECT District_Code, week_start, y_true, ma4 AS y_pred, 'MA4' AS model FROM preds0
  WHERE week_start > (SELECT max(week_start) - 364 FROM cube))"""


def metrics_sql(src: str, keys: str, digits: int = 6) -> str:
    k = keys + ", " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    on = f"USING ({keys})" if keys else "ON TRUE"
    return f"""mv AS (SELECT * FROM {src} WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND NOT isnan(y_true) AND NOT isnan(y_pred)),
mmu AS (SELECT {k}avg(y_true) AS m FROM mv {g}),
met AS (SELECT {k}round(sqrt(avg((y_true - y_pred)*(y_true - y_pred))), {digits}) AS rmse,
  round(avg(abs(y_true - y_pred)), {digits}) AS mae,
  round(avg(CASE WHEN y_true <> 0 THEN abs(y_true - y_pred) / abs(y_true) END), {digits}) AS mape,
  round(CASE WHEN sum((y_true - m)*(y_true - m)) > 0 THEN 1 - sum((y_true - y_pred)*(y_true - y_pred)) / sum((y_true - m)*(y_true - m)) END, {digits}) AS r2
  FROM mv JOIN mmu {on} {g})"""

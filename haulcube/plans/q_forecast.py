"""Forecasting queries with fitted models."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import temporal_split
from ..operators.forecast.models import BOOST_CONFIGS, gradient_boosting, sequence_regressor
from ..operators.forecast.score import comparison_table, fixed_predictions, metrics
from ..operators.forecast.decompose import decompose, decompose_sql
from ..operators.forecast.series import arma_orders, change_points, pacf, per_group_forecast
from ..operators.weekly import interpolate, regrid
from .base import DCUBE_CTE, district_cube, sql
from .q_agg import INTERPOLATED_SQL
from .registry import query

G = "District_Code"


def _cube(spark, sf):
    return district_cube(spark, sf).select(G, "week_start", "tons_refuse", "tons_paper", "tons_mgp").checkpoint(eager=True)


@query("t3_seasonal_ar_per_group")
def t3(spark, sf):
    tr, te = temporal_split(_cube(spark, sf))
    return per_group_forecast(tr, te, G, "tons_refuse", "sar", "Seasonal AR")


@query("t4_trend_fourier_per_group")
def t4(spark, sf):
    tr, te = temporal_split(_cube(spark, sf))
    return per_group_forecast(tr, te, G, "tons_refuse", "trend", "Trend + Fourier")


@query("t3_orders_per_group")
def t3_orders(spark, sf):
    return arma_orders(temporal_split(_cube(spark, sf))[0], G, "tons_refuse")


@query("t4_change_points")
def t4_change_points(spark, sf):
    return change_points(temporal_split(_cube(spark, sf))[0], G, "tons_refuse")


@query("t5_gradient_boosting")
def t5(spark, sf):
    p, _, _ = gradient_boosting(_cube(spark, sf))
    return p


@query("t6_feature_importance")
def t6(spark, sf):
    first = next(iter(BOOST_CONFIGS.items()))                # only this model is read
    return gradient_boosting(_cube(spark, sf), configs=dict([first]))[1]


@query("t7_sequence_regressor")
def t7(spark, sf):
    return sequence_regressor(_cube(spark, sf))


@query("t9_model_comparison_all")
def t9all(spark, sf):
    cube = _cube(spark, sf)
    tr, te = temporal_split(cube)
    parts = [per_group_forecast(tr, te, G, "tons_refuse", "sar", "Seasonal AR"),
             per_group_forecast(tr, te, G, "tons_refuse", "trend", "Trend + Fourier"),
             gradient_boosting(cube)[0], sequence_regressor(cube), fixed_predictions(cube)]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return comparison_table(allp.checkpoint(eager=True))


@query("t10_stl_decomposition", sql(DCUBE_CTE, INTERPOLATED_SQL, decompose_sql("interpolated", G, "week_start", "tons_refuse"), select=
    "SELECT District_Code, week_start, round(observed, 3) + 0.0 AS observed, round(trend, 3) + 0.0 AS trend, round(seasonal, 3) + 0.0 AS seasonal, "
    "round(resid, 3) + 0.0 AS resid, status FROM split"))
def t10(spark, sf):
    g = interpolate(regrid(_cube(spark, sf), G, "week_start", "tons_refuse"), G, "week_start", "tons_refuse")
    d = decompose(g, G, "week_start", "tons_refuse")
    return d.select(G, "week_start", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("observed", "trend", "seasonal", "resid")), "status")


@query("w13_partial_autocorrelation")
def w13(spark, sf):
    return pacf(_cube(spark, sf), G, "week_start", "tons_refuse", 52)

"""Per-series operators: partial autocorrelations, seasonal-trend split, seasonal AR, stable moments."""
import datetime

import numpy as np

from haulcube.operators.forecast.decompose import decompose
from haulcube.operators.forecast.series import pacf, seasonal_ar_forecast
from haulcube.operators.profile import describe, distinct_counts, group_corr

DAY = datetime.date(2001, 1, 1)


def weekly(spark, **series):
    rows = [(g, DAY + datetime.timedelta(7 * i), None if v is None else float(v)) for g, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, t date, v double")


def plain_pacf(x, nlags):
    """Last coefficient of the Yule-Walker equations of each order."""
    x = np.asarray(x) - np.mean(x)
    r = np.array([(x[:len(x) - k] * x[k:]).sum() for k in range(nlags + 1)]) / (x * x).sum()
    return [1.0] + [np.linalg.solve(r[np.abs(np.subtract.outer(range(k), range(k)))], r[1:k + 1])[-1] for k in range(1, nlags + 1)]


def test_pacf_solves_yule_walker(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(400)
    for i in range(1, 400):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    got = pacf(weekly(spark, a=x, b=x[:21], c=[1, 2], d=[5] * 30), "g", "t", "v", 12).orderBy("g", "lag").collect()
    by = {g: [r.pacf for r in got if r.g == g] for g in "abcd"}
    assert np.allclose(by["a"], plain_pacf(x, 12)) and np.allclose(by["b"], plain_pacf(x[:21], 9)) and by["c"] == [1.0]
    assert by["d"][0] == 1.0 and by["d"][1:] == [None] * 12


def test_decomposition_finds_trend_and_season(spark):
    rng = np.random.default_rng(2)
    t = np.arange(312)
    season = 2 * np.sin(2 * np.pi * t / 52)
    y = 5 + 0.02 * t + season + rng.normal(0, 0.05, 312)
    spoiled = y.copy()
    spoiled[[60, 150, 200]] += 40
    df = weekly(spark, a=y, b=spoiled, short=[1, 2, 3], gaps=[*y[:200], None])
    plan = decompose(df, "g", "t", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1
    got = {g: [] for g in ("a", "b", "short", "gaps")}
    for r in decompose(df, "g", "t", "v").orderBy("g", "t").collect():
        got[r.g].append(r)
    for g, x in (("a", y), ("b", spoiled)):
        tr, se, re = (np.array([r[c] for r in got[g]]) for c in ("trend", "seasonal", "resid"))
        assert np.allclose(tr + se + re, x) and abs(se.mean()) < 1e-6
        inner = slice(40, -40)
        assert np.abs(se - season)[inner].max() < 0.25 and np.abs(tr - 5 - 0.02 * t)[inner].max() < 0.2
    assert len(got["short"]) == 3 and {(r.status, r.trend) for r in got["short"]} == {("short", None)}
    assert len(got["gaps"]) == 201 and {(r.status, r.seasonal) for r in got["gaps"]} == {("gaps", None)}


def test_seasonal_naive_special_case():
    season = np.tile(np.arange(52, dtype=float), 4)
    fc = seasonal_ar_forecast(season, 10)
    assert np.allclose(fc, season[-52:-42], atol=1e-6)


def test_moments_with_a_large_mean(spark):
    rng = np.random.default_rng(3)
    x, y = 1e9 + rng.normal(size=500), rng.normal(size=500)
    z = x + y
    df = weekly(spark, x=x, z=z, few=[None] * 400 + list(x[400:]))
    std = {r.g: (r.std, r["mean"]) for r in describe(df, ["v"], "g").collect()}
    assert abs(std["x"][0] - np.std(x, ddof=1)) < 1e-9 and abs(std["x"][1] - x.mean()) < 1e-6
    r = {(a.g1, a.g2): (a.r, a.n) for a in group_corr(df, "g", "t", "v").collect()}
    centred = x - 1e9, z - 1e9
    assert abs(r["x", "z"][0] - np.corrcoef(*centred)[0, 1]) < 1e-9 and r["x", "z"][1] == 500
    assert abs(r["few", "z"][0] - np.corrcoef(centred[0][400:], centred[1][400:])[0, 1]) < 1e-9 and r["few", "z"][1] == 100
    assert set(r) == {("x", "x"), ("x", "z"), ("z", "z"), ("few", "x"), ("few", "z"), ("few", "few")}


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "", None), (2, None, None), (None, "a", None)], "a int, b string, c date")
    assert {(r["column"], r.dtype, r.n_distinct) for r in distinct_counts(df).collect()} == {("a", "int", 2), ("b", "string", 2), ("c", "date", 0)}

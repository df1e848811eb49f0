"""Per-series solvers run as grouped Arrow functions (T3, T4), and partial autocorrelations.

Each group is one weekly series (bounded by the calendar, not by the facts),
so `groupBy(group).applyInPandas` / `cogroup` gives one task call per series
and the numpy work is vectorised inside it.  The kernels are small: a
seasonal ARMA model by two-stage regression, chosen by AIC, and a line with
sparse slope changes + Fourier regression.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON = 52


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by the group key into an explicit number of partitions.

    The per-series work is CPU-bound while its input is tiny, so AQE would
    coalesce it into one task; an explicit partition count keeps the series
    spread over all cores (and the following groupBy reuses the partitioning)."""
    n = max(df.sparkSession.sparkContext.defaultParallelism,
            int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.col(key))


# ----------------------------------------------------------- seasonal ARMA
def _diff(y: np.ndarray, d: int, D: int, season: int) -> np.ndarray:
    """Differences of `y`, of its length; the first d + D * season values are zero and no model reads them."""
    z = y.copy()
    if D:
        z[season:] = y[season:] - y[:-season]
        z[:season] = 0.0
    if d:
        z[1:] = np.diff(z)
        z[:d + D * season] = 0.0
    return z


def _lagged(x: np.ndarray, lags, start: int) -> list:
    return [x[start - k:len(x) - k] for k in lags]


def _design(z, e, lags, start, const):
    """Columns constant (if any), values at lags[0], residuals at lags[1], for the weeks from `start`."""
    cols = [np.ones(len(z) - start)] if const else []
    return np.column_stack(cols + _lagged(z, lags[0], start) + _lagged(e, lags[1], start) or [np.empty((len(z) - start, 0))])


def _residuals(z, lags, coef, start, const):
    """One-step errors of the recursion, zero before `start`."""
    c0, ar, ma = coef[0] if const else 0.0, coef[const:const + len(lags[0])], coef[const + len(lags[0]):]
    base = z[start:] - c0 - sum((a * x for a, x in zip(ar, _lagged(z, lags[0], start))), np.zeros(len(z) - start))
    e = [0.0] * len(z)
    for t, v in enumerate(base.tolist(), start):
        e[t] = v - sum(m * e[t - k] for m, k in zip(ma, lags[1]))
    return np.array(e)


def _inside(lags, coef) -> bool:
    """Whether the recursion x[t] = sum coef * x[t - lag] dies out."""
    if not len(lags):
        return True
    poly = np.zeros(max(lags) + 1)
    poly[0], poly[list(lags)] = 1.0, -np.asarray(coef)
    return bool(np.abs(np.roots(poly)).max() < 0.9999)


def seasonal_arma_fit(y: np.ndarray, max_p: int = 3, max_q: int = 3, season: int = SEASON, refine: int = 3):
    """Order search of an ARMA model with seasonal and plain differences; None for fewer than 10 values.

    Two-stage regression: a long autoregression gives residuals, then each candidate regresses the series on its
    lags 1..p and residual lags 1..q, with lag `season` of either one where four seasons are given (P, Q).  All
    candidates solve parts of one set of normal equations for the same weeks; their errors are one-step errors
    of `y`, so the AIC values are comparable across differences.  Candidates whose recursions do not die out are passed over.
    The coefficients of the best one are fitted again on its own residuals while that lowers their squares.
    """
    n = len(y)
    if n < 10:
        return None
    scale = float(np.std(y)) or 1.0
    x = (y - y.mean()) / scale
    long = max(1, min(12, n // 8))
    max_p, max_q = min(max_p, long), min(max_q, long)
    seasonal, terms = n >= season + 3 * (long + max_q) + 1, n >= 4 * season
    first = 1 + long + max(max_q, season if terms else 0) + (season if seasonal else 0)
    if n - first < 4:
        max_p = max_q = 0
        first = 1
    found = []
    for D in (0, 1) if seasonal else (0,):
        for d in (0, 1):
            z, const = _diff(x, d, D, season), int(d + D < 2)
            held = d + D * season
            stage = min(held + long, n - 1)
            X = _design(z, z, (range(1, long + 1), ()), stage, const)
            e = np.zeros(n)
            e[stage:] = z[stage:] - X @ np.linalg.lstsq(X, z[stage:], rcond=None)[0]
            value_lags = list(range(1, max_p + 1)) + [season] * terms
            error_lags = list(range(1, max_q + 1)) + [season] * terms
            start = max(first, held + max([0, *value_lags, *error_lags]))
            X, t = _design(z, e, (value_lags, error_lags), start, const), z[start:]
            gram, dot, square, m = X.T @ X, X.T @ t, float(t @ t), len(t)
            for p in range(max_p + 1):
                for q in range(max_q + 1):
                    for P in range(terms + 1):
                        for Q in range(terms + 1):
                            lags = [*range(1, p + 1), *[season] * P], [*range(1, q + 1), *[season] * Q]
                            at = [*range(const), *(const + value_lags.index(k) for k in lags[0]),
                                  *(const + len(value_lags) + error_lags.index(k) for k in lags[1])]
                            if m <= len(at) + 2:
                                continue
                            coef = np.linalg.lstsq(gram[np.ix_(at, at)], dot[at], rcond=None)[0] if at else np.empty(0)
                            rss = max(square - float(dot[at] @ coef), 0.0)
                            aic = m * np.log(max(rss / m, 1e-10)) + 2 * (len(at) + 1)
                            found.append((aic, len(found), dict(d=d, D=D, p=p, q=q, P=P, Q=Q), lags, const, start, coef, z))
    for aic, _, order, lags, const, start, coef, z in sorted(found, key=lambda f: f[:2]):
        k = const + len(lags[0])
        if not (_inside(lags[0], coef[const:k]) and _inside(lags[1], -coef[k:])):
            continue
        run_from = max(order["d"] + order["D"] * season + max([0, *lags[0], *lags[1]]), 1)
        e = _residuals(z, lags, coef, run_from, const)
        for _ in range(refine if lags[1] else 0):
            X = _design(z, e, lags, start, const)
            again = np.linalg.lstsq(X, z[start:], rcond=None)[0]
            if not (_inside(lags[0], again[const:k]) and _inside(lags[1], -again[k:])):
                break
            e2 = _residuals(z, lags, again, run_from, const)
            if float(e2[start:] @ e2[start:]) >= float(e[start:] @ e[start:]):
                break
            coef, e = again, e2
        return dict(order=order, aic=float(aic), lags=lags, const=float(coef[0] * scale) if const else 0.0, ar=coef[const:k],
                    ma=coef[k:], values=z * scale, errors=e * scale, mean=float(y.mean()))
    return None


def seasonal_ar_forecast(y: np.ndarray, h: int, max_p: int = 3, season: int = SEASON, max_q: int = 3) -> np.ndarray:
    """Forecast of the model that `seasonal_arma_fit` finds; nulls as NaN where it finds none."""
    fit = seasonal_arma_fit(y, max_p, max_q, season)
    if fit is None:
        return np.full(h, np.nan)
    d, D = fit["order"]["d"], fit["order"]["D"]
    z, e, hist = list(fit["values"]), list(fit["errors"]), list(y)
    for _ in range(h):
        zt = fit["const"] + sum(a * z[-k] for a, k in zip(fit["ar"], fit["lags"][0])) + sum(m * e[-k] for m, k in zip(fit["ma"], fit["lags"][1]))
        z.append(zt)
        e.append(0.0)
        if not d and not D:
            zt += fit["mean"]
        if d:
            zt += hist[-1] - (hist[-season - 1] if D else 0.0)
        if D:
            zt += hist[-season]
        hist.append(zt)
    return np.array(hist[len(y):])


# --------------------------------------------------------- trend + Fourier (T4)
def _soft_descent(Q, c, penalty, beta, sweeps: int = 400, tol: float = 1e-7):
    """Coordinate descent for 1/2 b'Qb - c'b + penalty * sum|b|, from `beta`."""
    diag = np.diag(Q)
    slope = Q @ beta
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(diag > 1e-12):
            r = c[j] - slope[j] + diag[j] * beta[j]
            new = np.sign(r) * max(abs(r) - penalty, 0.0) / diag[j]
            if new != beta[j]:
                slope += Q[:, j] * (new - beta[j])
                moved = max(moved, abs(new - beta[j]) * np.sqrt(diag[j]))
                beta[j] = new
        if moved < tol:
            break
    return beta


def trend_fourier_fit(t: np.ndarray, y: np.ndarray, n_knots: int = 25, knot_range: float = 0.8, order: int = 10,
                      period_days: float = 365.25, ridge: float = 1.0, n_penalties: int = 20):
    """Line with sparse slope changes (candidates in the first 80 %) + yearly Fourier terms.

    The slope changes carry an absolute-value penalty (coordinate descent after the line and the yearly terms are projected
    out); of a falling series of penalties, that whose surviving changes, fitted again without it, have the least BIC is kept.
    Returns (change points, slope change per day at each, predict function); no other slope change differs from zero.
    """
    t = t.astype(float)
    t0, span = t.min(), max(t.max() - t.min(), 1.0)
    knots = t0 + np.linspace(0, knot_range * span, n_knots + 2)[1:-1]
    mu, sd = y.mean(), y.std() or 1.0
    v, n = (y - mu) / sd, len(y)

    def free(x):
        a = 2 * np.pi * np.outer(x, np.arange(1, order + 1)) / period_days
        return np.column_stack([np.ones_like(x), (x - t0) / span, np.sin(a), np.cos(a)])

    def hinges(x, at):
        return np.maximum(0.0, (x[:, None] - at[None, :]) / span)
    A, H = free(t), hinges(t, knots)
    pen = np.full(A.shape[1], ridge)
    pen[:2] = 1e-9
    S = np.linalg.solve(A.T @ A + np.diag(pen), A.T)
    MH, Mv = H - A @ (S @ H), v - A @ (S @ v)
    Q, c = H.T @ MH, H.T @ Mv
    top = float(np.abs(c).max())
    beta, best = np.zeros(n_knots), None
    for penalty in top * np.geomspace(1.0, 1e-3, n_penalties) if top > 0 else [1.0]:
        beta = _soft_descent(Q, c, penalty, beta)
        at = np.flatnonzero(beta)
        if best is not None and np.array_equal(at, best[3]):
            continue
        if len(at) > n // 4:
            break
        part = np.linalg.lstsq(Q[np.ix_(at, at)], c[at], rcond=None)[0] if len(at) else np.empty(0)
        rest = v - H[:, at] @ part
        rest = rest - A @ (S @ rest)
        bic = n * np.log(max(float(rest @ rest) / n, 1e-10)) + len(at) * np.log(n)
        if best is None or bic < best[0]:
            best = (bic, part, S @ (v - H[:, at] @ part), at)
    _, part, alpha, at = best
    keep = np.abs(part) > 1e-12
    at, part = at[keep], part[keep]
    return knots[at], part * sd / span, lambda x: (free(x.astype(float)) @ alpha + hinges(x.astype(float), knots[at]) @ part) * sd + mu


def trend_fourier_forecast(t_train: np.ndarray, y: np.ndarray, t_test: np.ndarray, **settings) -> np.ndarray:
    """Forecast of `trend_fourier_fit`."""
    return trend_fourier_fit(t_train, y, **settings)[2](t_test)


def _days(s) -> np.ndarray:
    return (pd.to_datetime(s) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(np.float64)


def arma_orders(train: DataFrame, group: str, y: str, min_train: int = 104) -> DataFrame:
    """The order found for each group of at least `min_train` weeks: (group, n, d, D, p, q, P, Q, aic)."""
    names = ["d", "D", "p", "q", "P", "Q"]

    def fn(tr: pd.DataFrame) -> pd.DataFrame:
        fit = seasonal_arma_fit(tr.sort_values("week_start")[y].to_numpy(np.float64)) if len(tr) >= min_train else None
        rows = [] if fit is None else [[tr[group].iloc[0], len(tr), *(fit["order"][k] for k in names), fit["aic"]]]
        return pd.DataFrame(rows, columns=[group, "n", *(n if n.islower() else "seasonal_" + n.lower() for n in names), "aic"])
    schema = f"{group} string, n long, d int, seasonal_d int, p int, q int, seasonal_p int, seasonal_q int, aic double"
    return spread(train.select(group, "week_start", y), group).groupBy(group).applyInPandas(fn, schema)


def change_points(train: DataFrame, group: str, y: str, min_train: int = 104) -> DataFrame:
    """T4: the slope changes kept for each group of at least `min_train` weeks: (group, change_date, slope_change per week)."""
    def fn(tr: pd.DataFrame) -> pd.DataFrame:
        cols = [group, "change_date", "slope_change"]
        if len(tr) < min_train:
            return pd.DataFrame(columns=cols)
        tr = tr.sort_values("week_start")
        at, slope, _ = trend_fourier_fit(_days(tr["week_start"]), tr[y].to_numpy(np.float64))
        dates = (pd.Timestamp("1970-01-01") + pd.to_timedelta(np.floor(at), unit="D")).date
        return pd.DataFrame({group: tr[group].iloc[0], "change_date": dates, "slope_change": 7 * slope}, columns=cols)
    return spread(train.select(group, "week_start", y), group).groupBy(group).applyInPandas(
        fn, f"{group} string, change_date date, slope_change double")


def _forecast_fn(kind: str, group: str, y: str, model: str, min_train: int = 104):
    def fn(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        cols = [group, "week_start", "y_true", "y_pred", "model"]
        if len(tr) < min_train or len(te) == 0:          # P18 guard
            return pd.DataFrame(columns=cols)
        tr, te = tr.sort_values("week_start"), te.sort_values("week_start")
        yt = tr[y].to_numpy(np.float64)
        try:
            if kind == "sar":
                fc = seasonal_ar_forecast(yt, len(te))
            else:
                fc = trend_fourier_forecast(_days(tr["week_start"]), yt, _days(te["week_start"]))
        except np.linalg.LinAlgError:                     # a group without a solution is skipped
            return pd.DataFrame(columns=cols)
        return pd.DataFrame({group: te[group].to_numpy(), "week_start": te["week_start"].to_numpy(),
                             "y_true": te[y].to_numpy(np.float64), "y_pred": fc, "model": model})
    return fn


def per_group_forecast(train: DataFrame, test: DataFrame, group: str, y: str, kind: str, model: str) -> DataFrame:
    """One model per group; forecasts matched to the test weeks by position."""
    schema = f"{group} string, week_start date, y_true double, y_pred double, model string"
    # fresh aliases on both sides: train and test come from one plan, and shared
    # attribute ids would let the optimizer prune one side's columns in the cogroup
    cols = [F.col(c).alias(c) for c in (group, "week_start", y)]
    a = spread(train.select(*cols), group)
    b = spread(test.select(*[F.col(c).alias(c) for c in (group, "week_start", y)]), group)
    return a.groupBy(group).cogroup(b.groupBy(group)).applyInPandas(_forecast_fn(kind, group, y, model), schema)


# ------------------------------------------------------------------- PACF
def pacf(df: DataFrame, group: str, time: str, y: str, nlags: int = 52) -> DataFrame:
    """Yule-Walker (biased acf) partial autocorrelations: (group, lag, pacf), lag 0 is 1.

    The Durbin-Levinson recursion is a fold over the lags of each series' autocorrelations; a series of one value throughout has nulls.
    """
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(time, F.col(y).cast("double").alias("v")))).alias("_s"))
    rows = rows.select(group, F.col("_s.v").alias("x"))
    rows = rows.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.size("x"))
    rows = rows.select(group, F.transform("x", lambda v: v - F.col("m")).alias("x"))
    rows = rows.withColumn("k", F.greatest(F.least(F.lit(nlags), F.floor(F.size("x") / 2) - 1), F.lit(0)).cast("int"))
    dot = "aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    lagged = dot.format(a="slice(x, 1, size(x) - i)", b="slice(x, i + 1, size(x) - i)")
    rows = rows.withColumn("r", F.expr(f"transform(sequence(0, k), i -> {lagged} / nullif({dot.format(a='x', b='x')}, 0D))"))
    # phi holds the coefficients of the order before, p the results
    a = f"""(r[i] - {dot.format(a='s.phi', b='reverse(slice(r, 2, i - 1))')}) / (1D - {dot.format(a='s.phi', b='slice(r, 2, i - 1)')})"""
    step = f"""aggregate(if(k > 0, sequence(1, k), array()), named_struct('phi', cast(array() as array<double>), 'p', slice(array(1D, cast(null as double)), 1, 1)),
        (s, i) -> transform(array({a}), a -> named_struct('phi', concat(zip_with(s.phi, reverse(s.phi), (u, v) -> u - a * v), array(a)), 'p', concat(s.p, array(a))))[0], s -> s.p)"""
    return rows.select(group, F.posexplode(F.expr(step)).alias("lag", "pacf")).select(group, F.col("lag").cast("long").alias("lag"), "pacf")

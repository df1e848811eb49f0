"""Model operators against numpy: k-means inertia, PCA share, trend and seasonal forecasts, permutation test, sample."""
import numpy as np

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from haulcube.operators.cluster.kmeans import fit_all, kmeans_best_of, nearest, pca_95
from haulcube.operators.forecast.series import (arma_orders, change_points, seasonal_ar_forecast, seasonal_arma_fit,
                                                 trend_fourier_fit, trend_fourier_forecast)
from haulcube.operators.cluster.features import STREAM_ORDER
from haulcube.operators.geo import contiguity as C


def test_kmeans_inertia_and_labels(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(c, 0.3, (30, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    lab, cost, _ = kmeans_best_of(df, "v", 3, n_init=3)
    label = np.array([r.cluster for r in lab.orderBy("id").collect()])
    assert all(len(set(label[k:k + 30])) == 1 for k in (0, 30, 60)) and len(set(label)) == 3
    inertia = sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in set(label))
    assert np.isclose(cost, inertia)


def noise(spark, n, d):
    x = np.random.default_rng(5).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").coalesce(1)


def test_kmeans_starts_share_their_rounds(spark):
    # F8: rounds were jobs of each start; now one more round is one more pass over the rows, however many starts there are
    _, df = noise(spark, 1500, 6)
    df = df.checkpoint(eager=True)
    jobs = []
    for rounds in (1, 9):
        spark.sparkContext.setJobGroup(f"kmeans-{rounds}", "")
        fit_all(df, "v", [6, 7], n_init=3, max_iter=rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"kmeans-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] - jobs[0] <= 8


def test_kmeans_equals_the_best_run_of_the_library(spark):
    x, df = noise(spark, 400, 4)
    for rounds in (4, 300):     # stopped by the rounds, and by the tolerance
        lab, cost, centres = kmeans_best_of(df, "v", 5, n_init=4, max_iter=rounds)
        v = df.select(array_to_vector("v").alias("f")).cache()
        runs = [KMeans(k=5, seed=42 + s, maxIter=rounds, tol=1e-6, featuresCol="f").fit(v) for s in range(4)]
        best = min(runs, key=lambda m: m.summary.trainingCost)
        assert np.isclose(cost, best.summary.trainingCost, rtol=1e-10)
        assert np.allclose(centres, np.array(best.clusterCenters()), atol=1e-9)
        of = np.array([r.cluster for r in lab.orderBy("id").collect()])
        assert (of == np.square(x[:, None] - centres[None]).sum(axis=2).argmin(axis=1)).all()


def test_nearest_centre_where_products_cancel():
    rnd = np.random.default_rng(6)
    C = np.array([[1e8, 0.0], [1e8 + 1, 0.0], [1e8 + 2, 0.0], [0.0, 0.0], [1.0, 1.0]])
    x = np.concatenate([C[rnd.integers(0, 5, 500)] + rnd.normal(0, 0.2, (500, 2)), [[0.5, 0.5], [1e8 + 0.5, 0.0]]])
    got = nearest(x, C, [0, 3, 5])
    for g, c in enumerate((C[:3], C[3:])):
        assert (got[g] == np.square(x[:, None] - c[None]).sum(axis=2).argmin(axis=1)).all()
    assert got[1][500] == 0 and got[0][501] == 0        # the first of equals


def test_pca_keeps_the_fewest_components(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 2)) @ rnd.normal(size=(2, 6)) + 0.05 * rnd.normal(size=(60, 6))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    _, k, model = pca_95(df, "v")
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = share / share.sum()
    assert np.allclose(model.explainedVariance.toArray(), share, atol=1e-9)
    assert share[:k].sum() >= 0.95 and (k == 1 or share[:k - 1].sum() < 0.95)


def test_seasonal_ar_recovers_a_seasonal_series():
    t = np.arange(52 * 4)
    y = 100 + 10 * np.sin(2 * np.pi * t / 52)
    assert np.allclose(seasonal_ar_forecast(y[:-52], 52), y[-52:], atol=1e-3)
    rnd = np.random.default_rng(3)
    z = [0.0]
    for _ in range(400):
        z.append(5 + 0.8 * z[-1] + rnd.normal(0, 0.1))
    assert abs(seasonal_ar_forecast(np.array(z), 60)[-1] - 25) < 1.5


def test_trend_forecast_follows_a_line():
    t = np.arange(0, 7 * 200, 7.0)
    y = 3 + 0.02 * t
    assert np.allclose(trend_fourier_forecast(t[:-20], y[:-20], t[-20:]), y[-20:], atol=0.3)


def test_moving_average_terms_are_found():
    for theta in (0.6, -0.5):
        rnd = np.random.default_rng(7)
        e = rnd.normal(size=601)
        y = 20 + e[1:] + theta * e[:-1]
        fit = seasonal_arma_fit(y)
        assert fit["order"]["d"] == fit["order"]["D"] == 0 and fit["order"]["q"] >= 1
        only = seasonal_arma_fit(y, max_p=0, max_q=1)
        assert only["order"]["q"] == 1 and abs(only["ma"][0] - theta) < 0.1
        fc = seasonal_ar_forecast(y, 5)
        assert abs(fc[0] - (20 + theta * e[-1])) < 0.6 and abs(fc[4] - 20) < 0.8


def test_arma_of_odd_series():
    assert np.isnan(seasonal_ar_forecast(np.arange(9.0), 2)).all()
    assert np.allclose(seasonal_ar_forecast(np.full(120, 4.0), 3), 4.0)
    assert np.allclose(seasonal_ar_forecast(np.arange(12.0), 3), [12, 13, 14], atol=0.5)
    rnd = np.random.default_rng(8)
    walk = np.cumsum(1 + 0.1 * rnd.normal(size=300))
    assert seasonal_arma_fit(walk)["order"]["d"] + seasonal_arma_fit(walk)["order"]["D"] >= 1
    assert np.allclose(seasonal_ar_forecast(walk, 10), walk[-1] + np.arange(1, 11), atol=3)


def test_trend_keeps_few_change_points():
    rnd = np.random.default_rng(9)
    t = np.arange(0, 7 * 310, 7.0)
    season = 2 * np.sin(2 * np.pi * t / 365.25)
    line = 50 + 0.01 * t
    bent = line + 0.05 * np.maximum(0, t - 900)
    for base, most in ((line, 0), (bent, 3)):
        at, slope, predict = trend_fourier_fit(t, base + season + 0.3 * rnd.normal(size=len(t)))
        assert len(at) <= most
        ahead = t + 364
        assert np.abs(predict(ahead) - (base[-1] + (0.01 + (0.05 if most else 0)) * (ahead - t[-1]) + season))[-52:].max() < 2.5
    assert abs(slope.sum() - 0.05) < 0.005 and np.abs(at - 900).min() < 100


def test_orders_and_change_points_of_each_group(spark):
    import datetime
    rnd = np.random.default_rng(10)
    e = rnd.normal(size=261)
    bend = 30 + 0.2 * np.maximum(0, np.arange(260) - 130) + 0.2 * rnd.normal(size=260)
    day = datetime.date(2001, 1, 1)
    rows = [(g, day + datetime.timedelta(7 * i), float(v)) for g, x in
            {"ma": 9 + e[1:] + 0.7 * e[:-1], "bend": bend, "short": e[:50]}.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, week_start date, v double")
    orders = {r.g: r for r in arma_orders(df, "g", "v").collect()}
    assert set(orders) == {"ma", "bend"} and orders["ma"].n == 260 and orders["ma"].p + orders["ma"].q >= 1
    points = change_points(df, "g", "v").collect()
    bends = [r for r in points if r.g == "bend"]
    assert 1 <= len(bends) <= 3 and abs(sum(r.slope_change for r in bends) - 0.2) < 0.03
    assert min(abs((r.change_date - day).days / 7 - 130) for r in bends) < 15 and not [r for r in points if r.g == "short"]


def test_permutation_test_of_a_patterned_grid(spark):
    cells = [(f"c{x}{y}", float(x < 3), x, y) for x in range(6) for y in range(6)]
    edges = [(a, b) for a, _, x, y in cells for b, _, u, v in cells if a != b and abs(x - u) <= 1 and abs(y - v) <= 1]
    w = C.row_standardise(spark.createDataFrame(edges, "i string, j string"))
    v = spark.createDataFrame([c[:2] for c in cells], "u string, v double")
    r = C.moran_permutation_test(v, w, "u", "v", 199).first()
    z = {a: x - 0.5 for a, x, *_ in cells}
    deg = {a: sum(a == i for i, _ in edges) for a in z}
    want = len(z) / len(z) * sum(z[i] * z[j] / deg[i] for i, j in edges) / sum(x * x for x in z.values())
    assert np.isclose(r.I, want) and r.permutations == 199
    assert r.p_sim == 1 / 200 and r.z_sim > 5 and abs(r.mean_perm + 1 / 35) < 0.05


def test_seeded_sample_repeats(spark):
    df = spark.range(20_000).repartition(4, "id")
    a, b = (df.sample(fraction=0.1, seed=42).toPandas()["id"].tolist() for _ in range(2))
    assert a == b and abs(len(a) - 2000) < 200


def test_window_regression_learns_a_planted_rule(spark):
    import datetime

    from haulcube.operators.forecast.models import sequence_regressor
    rnd = np.random.default_rng(11)
    day, rows, truth = datetime.date(2001, 1, 1), [], {}
    for g in ("a", "b", "c", "d"):
        paper, mgp = rnd.normal(5, 1, 300), rnd.normal(3, 1, 300)
        refuse = np.concatenate([[20.0], 20 + 2 * (paper[:-1] - 5) - (mgp[:-1] - 3)])
        rows += [(g, day + datetime.timedelta(7 * i), *map(float, v)) for i, v in enumerate(zip(refuse, paper, mgp))]
        truth[g] = refuse
    cube = spark.createDataFrame(rows, "District_Code string, week_start date, tons_refuse double, tons_paper double, tons_mgp double")
    out = sequence_regressor(cube).collect()
    assert sorted((r.District_Code, (r.week_start - day).days // 7) for r in out) == [(g, i) for g in "abcd" for i in range(248, 300)]
    assert all(r.y_true == truth[r.District_Code][(r.week_start - day).days // 7] for r in out)
    err = np.array([r.y_true - r.y_pred for r in out])
    assert np.sqrt((err ** 2).mean()) < 0.1 * np.std(np.concatenate(list(truth.values())))


def test_stream_matrices_stand_side_by_side(spark):
    import datetime

    from haulcube.operators.cluster.features import multistream_matrix
    rnd = np.random.default_rng(12)
    day, rows, want = datetime.date(2001, 1, 1), [], {}
    for g in ("a", "b", "few"):
        x = rnd.uniform(1, 9, (3, 20))
        if g == "few":
            x[1, :10] = 0                                      # half of one stream's weeks are empty
        if g == "b":
            x[2] = 4                                           # no variance
        rows += [(g, day + datetime.timedelta(7 * i), *map(float, v)) for i, v in enumerate(x.T)]
        sd = x.std(axis=1, keepdims=True)
        want[g] = np.where(sd > 1e-12, (x - x.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, 1), 0).ravel()
    cube = spark.createDataFrame(rows, "g string, week_start date, tons_refuse double, tons_paper double, tons_mgp double")
    got = {r.g: r.features for r in multistream_matrix(cube, "g").collect()}
    order = [("tons_refuse", "tons_paper", "tons_mgp").index(s) for s in STREAM_ORDER]
    assert set(got) == {"a", "b"}
    assert all(np.allclose(got[g], want[g].reshape(3, 20)[order].ravel()) for g in got)

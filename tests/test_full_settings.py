"""The registered queries run the original's settings: k 2-15, 10 starts, 30 and 50 DTW rounds, 500 trees."""
import inspect

import numpy as np
import pytest

from haulcube.operators.cluster import kmeans, level
from haulcube.operators.forecast import models
from haulcube.plans import q_cluster, q_forecast

SMALL = "/root/testdata/sf0.001"


class Called(Exception):
    pass


def settings(monkeypatch, module, name, query, spark):
    """Arguments of the first call of `name`, defaults included."""
    signature = inspect.signature(getattr(module, name))

    def stop(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        raise Called(bound.arguments)
    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Called) as e:
        query(spark, SMALL)
    return e.value.args[0]


def test_queries_use_the_full_settings(spark, monkeypatch):
    cube = q_forecast.district_cube(spark, SMALL).checkpoint(eager=True)
    for plans in (q_cluster, q_forecast):
        monkeypatch.setattr(plans, "district_cube", lambda *_: cube)
    for query in (q_cluster.m12, q_cluster.m12a, q_cluster.m12c):
        with monkeypatch.context() as m:
            got = settings(m, level, "cluster_level", query, spark)
        assert (list(got["k_values"]), got["n_init"], got["dtw_iter"], got["dtw_final_iter"]) == (list(range(2, 16)), 10, 30, 50)
    with monkeypatch.context() as m:
        got = settings(m, kmeans, "silhouette_by_k", q_cluster.m5, spark)
    assert (list(got["k_values"]), got["n_init"]) == (list(range(2, 16)), 10)
    twenty = spark.range(20).selectExpr("string(id) AS District_Code", "array(double(id)) AS features", "id AS gid")
    monkeypatch.setattr(level, "keyed", lambda *_: twenty)
    for name, query in (("dtw_search", q_cluster.m6), ("ward_search", q_cluster.m8)):
        with monkeypatch.context() as m:
            got = settings(m, level, name, query, spark)
        assert list(got["k_values"]) == list(range(2, 16)) and (got.get("max_iter", 30), got.get("final_iter", 50)) == (30, 50)
    for query in (q_forecast.t5, q_forecast.t6):
        with monkeypatch.context() as m:
            m.setattr(models, "GBTRegressor", lambda maxIter, **_: (_ for _ in ()).throw(Called(maxIter)))
            with pytest.raises(Called) as e:
                query(spark, SMALL)
        assert e.value.args[0] == 500


def test_searches_find_more_than_four_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in 100 * np.eye(6)[i % 6] + rng.normal(0, 0.1, 6)]) for i in range(24)]
    X = spark.createDataFrame(rows, "gid long, v array<double>").checkpoint(eager=True)
    cut, k, curve = level.ward_search(X, "gid", "v", level.capped(range(2, 9), 24))
    assert k == 6 and [c[0] for c in curve] == list(range(2, 9))
    got = {r.gid: r.cluster for r in cut.collect()}
    assert all((got[i] == got[j]) == (i % 6 == j % 6) for i in got for j in got)
    final, k, curve = level.dtw_search(X, "gid", "v", [2, 3], max_iter=2, final_iter=3)
    assert k == max(curve, key=lambda c: c[1])[0] and final.count() == 24

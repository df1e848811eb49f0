"""A sample of registered queries against their DuckDB oracles on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from haulcube.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"

SAMPLE = ["a4_weekly_cube", "p2_clean_loads", "a26_forecast_metrics", "t2_feature_table", "a24_group_correlation",
          "w8_interpolate_gaps", "j11_densify_calendar", "s1_csv_scan", "j7_overlay_intersection",
          "a31_population_allocation", "g6_dissolve", "m9_cluster_metrics", "m11_dbscan", "m13_adjusted_rand_matrix",
          "w12_autocorrelation", "w7_sequence_windows", "a35_sequence_scaling", "a20_histogram"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(E.oracle_sql()[name])
    want = _rows([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert got == want


def test_every_query_has_a_builder_and_entry_runs(spark):
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 150
    assert E.entry(spark).count() > 0

"""Readers: headed raw files and layers of more than one document."""
import pytest
from pyspark.sql import functions as F

from haulcube.session import scratch_dir
from haulcube.sources import io
from haulcube.sources.geo_fixtures import rect_ring


def test_raw_csv_takes_columns_by_name(spark):
    path = scratch_dir(spark, "csv-test")
    head = "Extra,Tons_Collected,Truck_ID,District_Code"
    spark.createDataFrame([(head,), ("x,5.5,T1,BK1",), ("y,bad,T2,BK2,long",), ("z",)], "value string").coalesce(1).write.text(path)
    rows = io.read_raw_csv(spark, path, header=True).orderBy(F.col("Truck_ID").asc_nulls_last()).collect()
    assert [(r.Truck_ID, r.Tons_Collected, r.District_Code, r.Net_Weight) for r in rows] == [("T1", 5.5, "BK1", None), ("T2", None, "BK2", None), (None, None, None, None)]
    assert io.read_raw_csv(spark, path, header=True, strict=True).count() == 2


def test_split_ingest_keeps_every_line_once(spark, tmp_path):
    from haulcube.streaming.ingest import ingest_split
    head = "Note,Tons_Collected,Truck_ID,Collection_Date,Material_Type_Code,District_Code,Section_Code"

    def add(name, *lines):
        src.joinpath(name).write_text("\n".join([head, *lines]) + "\n")
    src = tmp_path / "in"
    src.mkdir()
    add("a.csv", "x,5.5,T1,2020-01-06,1,MN01,MN011", "x,5.5,T1,2020-01-06,1,MN01,MN011,more", "x,5.5,9999999,2020-01-06,1,MN01,MN011",
        "x,5.5,T1,,1,MN01,MN011", "x,5.5,T1,someday,1,MN01,MN011", "x,-1,T1,2020-01-06,1,MN01,MN011", "x,bad,T1,2020-01-06,1,MN01,MN011",
        "x,5.5,T1,2020-01-06,7,MN01,MN011", "x,5.5", '"x,y",2,T2,01/07/2021 03:04:05 PM,33,MN01,MN011')
    out, bad, ckpt = (str(tmp_path / d) for d in ("out", "bad", "ckpt"))
    want = {"too_many_fields": 1, "placeholder_truck": 1, "no_date": 2, "bad_date": 1, "tons_not_positive": 2, "other_material": 1}

    def run():
        ingest_split(spark, str(src), out, bad, ckpt, header=True)
        rows = spark.read.parquet(bad).collect()
        return spark.read.parquet(out).count(), {w: sum(r.reason == w for r in rows) for w in {r.reason for r in rows}}, rows
    n, reasons, rows = run()
    assert (n, reasons) == (2, want) and n + sum(reasons.values()) == 10
    assert {r._line for r in rows if r.reason == "too_many_fields"} == {"x,5.5,T1,2020-01-06,1,MN01,MN011,more"}
    assert {str(r.Collection_Date) for r in spark.read.parquet(out).collect()} == {"2020-01-06", "2021-01-07"}
    assert run()[:2] == (2, want)                              # nothing new: nothing added
    (tmp_path / "ckpt" / "commits" / "0").unlink()             # stopped before the batch was marked as done: it runs again
    (tmp_path / "ckpt" / "commits" / ".0.crc").unlink(missing_ok=True)
    assert run()[:2] == (2, want)
    add("b.csv", "x,1,T3,2020-02-03,31,MN01,MN011")
    assert run()[:2] == (3, want)


def test_geojson_of_many_documents(spark):
    n = 12_345
    layer = spark.range(n).select(F.col("id").cast("string").alias("GEOID"), F.col("id").cast("double").alias("population"),
                                  rect_ring(F.col("id"), F.col("id"), 1, 1).alias("rings"))
    path = io.write_geojson(layer, scratch_dir(spark, "geojson-test"), "GEOID", ["population"])
    back = io.read_geojson(spark, path, "GEOID", {"population": "double"})
    assert back.count() == n and back.select(F.sum("population")).first()[0] == n * (n - 1) / 2


@pytest.fixture
def tables(spark, tmp_path):
    """1,200 line items of 20 suppliers in 5 nations, in 6 files."""
    n = spark.range(0, 1200, 1, 6)
    n.selectExpr("id AS l_orderkey", "id % 300 AS l_partkey", "id % 20 + 1 AS l_suppkey", "cast(id % 3 + 1 as int) AS l_linenumber", "cast(id % 40 as double) AS l_quantity",
                 "0.05D AS l_discount", "if(id % 2 = 0, 'A', 'N') AS l_returnflag",
                 "cast(timestamp'1996-01-01' + make_interval(0, 0, 0, cast(id % 700 as int)) as timestamp_ntz) AS l_shipdate") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 21).selectExpr("id AS s_suppkey", "cast(id % 5 as int) AS s_nationkey", "10.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(5).selectExpr("cast(id as int) AS n_nationkey", "'N' AS n_name", "1 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_headed_raw_files_come_straight_from_the_tasks(spark, tables):
    """Not dealt into a fixed number of files, each sorted by one task."""
    from haulcube.plans import q_io
    path = q_io.write_headed_csv(spark, tables)
    lines = spark.read.text(path).selectExpr("value", "input_file_name() AS f").collect()
    head = ",".join(q_io.HEADED)
    heads = [r.f for r in lines if r.value == head]
    assert len(heads) == len(set(heads)) == len({r.f for r in lines}) and len(lines) == 1200 + len(heads)
    assert not any("/file=" in f for f in heads)             # no deal by file number, so no sort
    got = sorted(map(repr, q_io.s1(spark, tables).collect()))
    assert len(got) == 1200 and sum("Tons_Collected=None" in r for r in got) == 12
    assert q_io.s1s(spark, tables).count() == 1200 - sum(r.value.endswith(",EXTRA") for r in lines)


def test_split_and_permutation_test_read_the_loads_once(spark, tables, monkeypatch):
    from haulcube.plans import q_agg, q_geo
    from haulcube.plans.base import clean_df
    assert "ExistingRDD" not in clean_df(spark, tables)._jdf.queryExecution().toString()       # no Python on the executors
    seen, split, test = [], q_agg.FT.temporal_split, q_geo.C.moran_permutation_test
    monkeypatch.setattr(q_agg.FT, "temporal_split", lambda cube: seen.append(cube) or split(cube))
    monkeypatch.setattr(q_geo.C, "moran_permutation_test", lambda v, *rest: seen.append(v) or test(v, *rest))
    assert {r["split"] for r in q_agg.t1(spark, tables).collect()} == {"train", "test"}
    assert q_geo.g9(spark, tables).first()["permutations"] == 999
    assert len(seen) == 2 and not any("lineitem" in f for df in seen for f in df.inputFiles())

"""Source and sink queries (S1-S15): write to a scratch folder under the
cluster's checkpoint directory, read back with Spark, compare with SQL on the
original tables."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import RAW_COLUMNS, clean_loads, clean_sql, reject_sql
from ..operators.cluster.features import feature_matrix
from ..operators.forecast.score import PREDS_SQL, metrics, metrics_sql
from ..operators.geo.rings import n_vertices, polygon_area
from ..session import scratch_dir
from ..sources import io
from ..sources.analogue import LOADS_SQL, loads
from ..sources.geo_fixtures import section_layer, sections_sql, tract_layer, TRACTS_SQL
from ..sources.tables import table
from .base import CLEAN_CTE, DCUBE_CTE, SCUBE_ONLY, clean_df, district_cube, section_cube, sql
from .q_agg import MLONG_SQL
from .q_basic import preds
from .registry import query


def dirty_lines(raw):
    """Raw loads as CSV text with a bad number, short lines and over-long lines."""
    rc = F.col("Route_Code").cast("long")
    f = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RAW_COLUMNS}
    f["Tons_Collected"] = F.when(rc % 211 == 0, F.lit("abc")).otherwise(f["Tons_Collected"])
    full = F.concat_ws(",", *[f[c] for c in RAW_COLUMNS])
    short = F.concat_ws(",", *[f[c] for c in RAW_COLUMNS[:7]])
    line = (F.when(rc % 211 == 0, full).when(rc % 223 == 0, short)
            .when(rc % 227 == 0, F.concat(full, F.lit(",EXTRA"))).otherwise(full))
    return raw.select(line.alias("value"))


def write_dirty_csv(spark, sf):
    path = scratch_dir(spark, "raw-csv")
    dirty_lines(loads(spark, sf)).write.mode("overwrite").text(path)
    return path


#: File order of the headed raw files: another column first, the ten in reverse order.
HEADED = ["Site_Note", *reversed(RAW_COLUMNS)]


def write_headed_csv(spark, sf):
    """The same dirty rows in files with a header line, an extra column and another column order; every task writes its own file."""
    raw = loads(spark, sf)
    rc = F.col("Route_Code").cast("long")
    f = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RAW_COLUMNS}
    f["Tons_Collected"] = F.when((rc % 211 == 0) | (rc % 223 == 0), F.lit("abc")).otherwise(f["Tons_Collected"])
    f["Net_Weight"] = F.when((rc % 211 != 0) & (rc % 223 == 0), F.lit("")).otherwise(f["Net_Weight"])
    f["Site_Note"] = F.lit("x")
    line = F.concat_ws(",", *[f[c] for c in HEADED])
    line = F.when((rc % 211 != 0) & (rc % 223 != 0) & (rc % 227 == 0), F.concat(line, F.lit(",EXTRA"))).otherwise(line)
    path = scratch_dir(spark, "raw-csv-headed")
    # one column whose name is the header: its lines are written as they are, without quotes
    (raw.select(line.alias(",".join(HEADED))).write.mode("overwrite").option("header", True).option("sep", "\u0001").option("quote", "")
     .option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


RC = "CAST(Route_Code AS BIGINT)"
DIRTY_SQL = f"""dirty AS (SELECT Truck_ID, Collection_Date, Shift_ID, District_Code, Section_Code, Route_Code, Material_Type_Code,
  CASE WHEN {RC} % 211 = 0 OR {RC} % 223 = 0 THEN NULL ELSE Tons_Collected END AS Tons_Collected,
  CASE WHEN {RC} % 211 <> 0 AND {RC} % 223 = 0 THEN NULL ELSE Net_Weight END AS Net_Weight,
  Dump_Time_Stamp, ({RC} % 211 <> 0 AND {RC} % 223 <> 0 AND {RC} % 227 = 0) AS overlong FROM loads)"""
COLS = ", ".join(RAW_COLUMNS)


@query("s1_csv_scan", sql(LOADS_SQL, DIRTY_SQL, select=f"SELECT {COLS} FROM dirty"))
def s1(spark, sf):
    return io.read_raw_csv(spark, write_headed_csv(spark, sf), header=True)


@query("s1_csv_scan_strict", sql(LOADS_SQL, DIRTY_SQL, select=f"SELECT {COLS} FROM dirty WHERE NOT overlong"))
def s1s(spark, sf):
    return io.read_raw_csv(spark, write_headed_csv(spark, sf), header=True, strict=True)


@query("s1_csv_scan_by_position", sql(LOADS_SQL, DIRTY_SQL, select=f"SELECT {COLS} FROM dirty"))
def s1p(spark, sf):
    return io.read_raw_csv(spark, write_dirty_csv(spark, sf))


@query("s1_stream_ingest", sql(LOADS_SQL, DIRTY_SQL, clean_sql("dirty"), select=
    "SELECT year, count(*) AS n, sum(Tons_Collected) AS tons FROM clean GROUP BY 1"))
def s1_stream(spark, sf):
    from ..streaming.ingest import ingest
    src = write_dirty_csv(spark, sf)
    out = scratch_dir(spark, "clean-stream")
    ingest(spark, src, out, scratch_dir(spark, "stream-ckpt"))
    return spark.read.parquet(out).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("Tons_Collected").alias("tons"))


@query("s1_rejected_lines", sql(LOADS_SQL, DIRTY_SQL, reject_sql("dirty", "overlong"), select=
    "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1"))
def s1_rejected(spark, sf):
    from ..streaming.ingest import ingest_split
    src, out, bad = write_headed_csv(spark, sf), scratch_dir(spark, "clean-split"), scratch_dir(spark, "rejected")
    ingest_split(spark, src, out, bad, scratch_dir(spark, "split-ckpt"), header=True, max_files_per_trigger=2)
    kept = spark.read.parquet(out).select(F.lit("kept").alias("reason"))
    return kept.unionByName(spark.read.parquet(bad).select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s2_prefix_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def s2(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity") \
        .orderBy("l_orderkey", "l_linenumber").limit(1000)


@query("s3_rows_read_kept", sql(CLEAN_CTE, select=
    "SELECT (SELECT count(*) FROM loads) AS rows_read, (SELECT count(*) FROM clean) AS rows_kept, "
    "round(1 - (SELECT count(*) FROM clean) / (SELECT count(*) FROM loads), 6) AS drop_rate"))
def s3(spark, sf):
    raw = loads(spark, sf)
    read = raw.select(F.count(F.lit(1))).scalar()
    kept = clean_loads(raw).select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(read.alias("rows_read"), kept.alias("rows_kept"),
                                 F.round(1 - kept / read, 6).alias("drop_rate"))


@query("s4_hash_sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
       "('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8))::BIGINT % 100 < 10")
def s4(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return io.hash_sample(li, key, 10).select("l_orderkey", "l_linenumber")


@query("s4_seeded_sample")
def s4b(spark, sf):
    return loads(spark, sf).sample(fraction=0.1, seed=42)


@query("s5_parquet_partitioned_write", sql(CLEAN_CTE, select="SELECT year, count(*) AS n, sum(Tons_Collected) AS tons FROM clean GROUP BY 1"))
def s5(spark, sf):
    path = io.write_parquet(clean_df(spark, sf), scratch_dir(spark, "clean"), "year")
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("Tons_Collected").alias("tons"))


@query("s6_parquet_read_pushdown", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def s6(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_shipdate", "l_quantity")


@query("s7_weekly_write_read", sql(DCUBE_CTE, select="SELECT District_Code, week_start, tons_total, tons_total_ma_52wk FROM cube"))
def s7(spark, sf):
    path = io.write_parquet(district_cube(spark, sf), scratch_dir(spark, "weekly-district"))
    return spark.read.parquet(path).select("District_Code", "week_start", "tons_total", "tons_total_ma_52wk")


METRIC_SCHEMA = T.StructType([T.StructField("model", T.StringType())] +
                             [T.StructField(c, T.DoubleType()) for c in ("rmse", "mae", "mape", "r2")])


@query("s8_csv_metrics_roundtrip", sql(DCUBE_CTE, PREDS_SQL, metrics_sql("preds", "model"), select="SELECT * FROM met"))
def s8(spark, sf):
    path = io.write_csv(metrics(preds(spark, sf), "model"), scratch_dir(spark, "metrics"))
    return io.read_csv(spark, path, METRIC_SCHEMA)


@query("s10_glob_read_levels", sql(CLEAN_CTE, select=
    "SELECT 'district' AS level, count(DISTINCT District_Code) AS n_groups, count(*) AS n_rows FROM clean "
    "UNION ALL SELECT 'section' AS level, count(DISTINCT Section_Code) AS n_groups, count(*) AS n_rows FROM clean"))
def s10(spark, sf):
    base = scratch_dir(spark, "results")
    c = clean_df(spark, sf)
    for level, g in (("district", "District_Code"), ("section", "Section_Code")):
        summ = c.agg(F.count_distinct(g).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))
        io.write_csv(summ, f"{base}/summary_{level}")
    schema = "n_groups long, n_rows long"
    r = io.read_csv(spark, f"{base}/summary_*", schema)
    return r.select(F.regexp_extract(F.input_file_name(), r"summary_([a-z]+)/", 1).alias("level"), "n_groups", "n_rows")


@query("s11_matrix_roundtrip", sql(DCUBE_CTE, MLONG_SQL.replace("{v}", "tons_total"), select=
    "SELECT District_Code, CAST(count(*) AS INTEGER) AS n_features, round(sum(z * z), 6) AS sum_sq FROM flong GROUP BY 1"))
def s11(spark, sf):
    m = feature_matrix(district_cube(spark, sf), "District_Code", "tons_total")
    path = io.write_parquet(m, scratch_dir(spark, "features"))
    r = spark.read.parquet(path)
    return r.select("District_Code", F.size("features").alias("n_features"),
                    F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sum_sq"))


@query("s12_geojson_read", sql(TRACTS_SQL, select=
    "SELECT GEOID, population, 5 AS n_vertices, (x1 - x0) * (y1 - y0) AS area FROM tracts"))
def s12(spark, sf):
    path = io.write_geojson(tract_layer(spark, sf), scratch_dir(spark, "tracts-geojson"), "GEOID", ["population"])
    g = io.read_geojson(spark, path, "GEOID", {"population": "double"})
    return g.select("GEOID", "population", n_vertices(F.col("rings")).alias("n_vertices"),
                    polygon_area(F.col("rings")).alias("area"))


@query("s13_header_rows_json", "SELECT CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE n_nationkey * 12 END AS value, n_name AS name, "
       "'36' || lpad(CAST(n_regionkey AS VARCHAR), 3, '0') || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS GEOID FROM nation")
def s13(spark, sf):
    n = table(spark, sf, "nation")
    header = F.array(*[F.lit(h) for h in ("value", "name", "state", "county", "tract")])
    row = F.array(F.when(F.col("n_nationkey") % 7 == 0, F.lit("x")).otherwise((F.col("n_nationkey") * 12).cast("string")),
                  F.col("n_name"), F.lit("36"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0"),
                  F.lpad(F.col("n_nationkey").cast("string"), 6, "0"))
    # one payload document per region, as an API returns one document per county
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.concat(F.array(header), F.collect_list(row))).alias("body"))
    t = io.header_rows_table(docs, "body", ["value", "name", "state", "county", "tract"])
    from ..operators.clean import lenient_number
    return t.select(lenient_number(F.col("value"), "int", 0).alias("value"), "name",
                    F.concat("state", "county", "tract").alias("GEOID"))


@query("s14_model_persistence")
def s14(spark, sf):
    from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
    from ..operators.forecast.models import assemble
    from ..operators.features import gb_features, feature_columns
    f = gb_features(district_cube(spark, sf)).dropna("any")
    data = assemble(f, feature_columns(f), "tons_refuse")
    model = GBTRegressor(maxIter=10, maxDepth=4, seed=42).fit(data)
    path = scratch_dir(spark, "model-gbt")
    model.write().overwrite().save(path)
    return GBTRegressionModel.load(path).transform(data).select("District_Code", "week_start", "prediction")


@query("s15_polygon_layer_roundtrip", sql(sections_sql(), select=
    "SELECT Section_Code, population, 1 AS n_rings, 5 AS n_vertices FROM sections"))
def s15(spark, sf):
    path = io.write_parquet(section_layer(spark, sf), scratch_dir(spark, "sections"))
    r = spark.read.parquet(path)
    return r.select("Section_Code", "population", F.size("rings").alias("n_rings"), n_vertices(F.col("rings")).alias("n_vertices"))


@query("s9_csv_read_schema", sql(DCUBE_CTE, PREDS_SQL, metrics_sql("preds", "District_Code"), select="SELECT * FROM met"))
def s9(spark, sf):
    schema = T.StructType([T.StructField("District_Code", T.StringType())] +
                          [T.StructField(c, T.DoubleType()) for c in ("rmse", "mae", "mape", "r2")])
    path = io.write_csv(metrics(preds(spark, sf), "District_Code"), scratch_dir(spark, "metrics-district"))
    return io.read_csv(spark, path, schema)

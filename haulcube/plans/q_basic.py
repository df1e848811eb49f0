"""Projection, filter, join, scalar-function, sort and set-operation queries.

Each query reads the given tables through the loads analogue or the weekly
cube derived from it; each SQL string is the DuckDB oracle of the same result.
"""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.codes import (BOROUGH_PREFIXES, DROP_SECTIONS, MATERIAL_NAMES, PRIMARY_STREAMS,
                               borough_of, material_label, normalise_code, stream_name)
from ..functions.nullsafe import neq_keep_null, positive
from ..operators.clean import RAW_COLUMNS, lenient_date, lenient_number, trim_strings
from ..operators.features import category_codes, cutoff_of
from ..operators.forecast.score import PREDS_SQL, errors, fixed_predictions, valid_pairs
from ..operators.weekly import densify, regrid, stream_sums
from ..sources.analogue import LOADS_SQL, loads
from ..sources.geo_fixtures import section_layer, sections_sql
from ..functions.codes import normalise_sql
from .base import (CLEAN_CTE, SCUBE_ONLY, clean_df, district_cube, section_cube, sql, with_clean,
                   with_dcube)
from .registry import query


def r6(c):
    return F.round(c, 6)


def L(select: str) -> str:
    return f"WITH {LOADS_SQL}\n{select}"


def preds(spark, sf):
    return fixed_predictions(district_cube(spark, sf))


def with_preds(select: str, extra: str = "") -> str:
    return with_dcube(select, PREDS_SQL + ((",\n" + extra) if extra else ""))


def assignments(cube):
    """A deterministic labelling of the groups (stands in for a fitted clustering)."""
    codes = category_codes(cube.select("District_Code").distinct(), "District_Code", "_c")
    return codes.select("District_Code", (F.col("_c") % 4).alias("cluster"),
                        borough_of(F.col("District_Code")).alias("borough"))


ASSIGN_SQL = """assign AS (
  SELECT District_Code, CAST((dense_rank() OVER (ORDER BY District_Code) - 1) % 4 AS INTEGER) AS cluster,
         {borough} AS borough
  FROM (SELECT DISTINCT District_Code FROM cube))"""


def assign_sql():
    from ..functions.codes import borough_sql
    return ASSIGN_SQL.replace("{borough}", borough_sql("District_Code"))


# ----------------------------------------------------------------- P: filters
@query("p1_project_columns", L(f"SELECT {', '.join(RAW_COLUMNS)} FROM loads"))
def p1(spark, sf):
    return loads(spark, sf).select(*RAW_COLUMNS)


@query("p2_trim_strings", L("SELECT trim(Truck_ID) AS Truck_ID, Collection_Date, trim(Shift_ID) AS Shift_ID, "
                            "trim(District_Code) AS District_Code, trim(Section_Code) AS Section_Code, "
                            "Route_Code, Material_Type_Code, Tons_Collected FROM loads"))
def p2(spark, sf):
    return trim_strings(loads(spark, sf).select(*RAW_COLUMNS[:8]))


@query("p3_drop_placeholder_keep_null",
       L("SELECT Truck_ID, Route_Code FROM loads WHERE Truck_ID IS DISTINCT FROM '9999999'"))
def p3(spark, sf):
    return loads(spark, sf).filter(neq_keep_null(F.col("Truck_ID"), "9999999")).select("Truck_ID", "Route_Code")


@query("p4_dropna_subset", L("SELECT Collection_Date, District_Code, Route_Code FROM loads "
                             "WHERE Collection_Date IS NOT NULL AND District_Code IS NOT NULL"))
def p4(spark, sf):
    return loads(spark, sf).dropna(subset=["Collection_Date", "District_Code"]) \
        .select("Collection_Date", "District_Code", "Route_Code")


@query("p5_dropna_any", L(f"SELECT {', '.join(RAW_COLUMNS[:9])} FROM loads WHERE "
                          + " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLUMNS[:9])))
def p5(spark, sf):
    return loads(spark, sf).select(*RAW_COLUMNS[:9]).dropna("any")


@query("p6_lenient_date", L("SELECT Route_Code, Collection_Date AS raw_date, "
                            "CAST(try_strptime(trim(Collection_Date), '%Y-%m-%d') AS DATE) AS parsed_date FROM loads"))
def p6(spark, sf):
    return loads(spark, sf).select("Route_Code", F.col("Collection_Date").alias("raw_date"),
                                   lenient_date(F.btrim("Collection_Date")).alias("parsed_date"))


@query("p7_lenient_number", L(
    "SELECT Route_Code, TRY_CAST(CASE WHEN Truck_ID IS NULL THEN 'abc' ELSE trim(Shift_ID) END AS INTEGER) AS shift_num, "
    "coalesce(TRY_CAST(CASE WHEN Truck_ID IS NULL THEN 'abc' ELSE trim(Shift_ID) END AS INTEGER), 0) AS shift_num0 FROM loads"))
def p7(spark, sf):
    s = F.when(F.col("Truck_ID").isNull(), F.lit("abc")).otherwise(F.btrim("Shift_ID"))
    return loads(spark, sf).select("Route_Code", lenient_number(s, "int").alias("shift_num"),
                                   lenient_number(s, "int", 0).alias("shift_num0"))


@query("p8_positive_filter", L("SELECT Route_Code, Tons_Collected FROM loads "
                               "WHERE Tons_Collected > 0 AND NOT isnan(Tons_Collected)"))
def p8(spark, sf):
    return loads(spark, sf).filter(positive(F.col("Tons_Collected"))).select("Route_Code", "Tons_Collected")


@query("p9_stream_membership", L("SELECT Material_Type_Code, count(*) AS n FROM loads "
                                 "WHERE Material_Type_Code IN (1, 31, 33) GROUP BY 1"))
def p9(spark, sf):
    return loads(spark, sf).filter(F.col("Material_Type_Code").isin(*PRIMARY_STREAMS)) \
        .groupBy("Material_Type_Code").agg(F.count(F.lit(1)).alias("n"))


@query("p10_drop_sections", with_clean("SELECT Section_Code, count(*) AS n FROM clean GROUP BY 1"))
def p10(spark, sf):
    return clean_df(spark, sf).groupBy("Section_Code").agg(F.count(F.lit(1)).alias("n"))


@query("p11_time_range", with_dcube("SELECT District_Code, week_start, tons_refuse FROM cube "
                                    "WHERE week_start <= (SELECT max(week_start) - 364 FROM cube)"))
def p11(spark, sf):
    cube = district_cube(spark, sf)
    return cube.filter(F.col("week_start") <= cutoff_of(cube)).select("District_Code", "week_start", "tons_refuse")


@query("p12_compound_predicate", with_preds(
    "SELECT District_Code, week_start, y_true, round(y_pred, 6) AS y_pred FROM preds "
    "WHERE model = 'MA4' AND District_Code = (SELECT min(District_Code) FROM preds)"))
def p12(spark, sf):
    p = preds(spark, sf)
    first = p.select(F.min("District_Code")).scalar()
    return p.filter((F.col("model") == "MA4") & (F.col("District_Code") == first)) \
        .select("District_Code", "week_start", "y_true", r6(F.col("y_pred")).alias("y_pred"))


@query("p14_id_column_discovery", "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS Section_Code, s_name, s_acctbal FROM supplier")
def p14(spark, sf):
    from ..operators.geo.layers import discover_id
    from ..sources.tables import table
    layer = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("SEC_CODE"), "s_name", "s_acctbal")
    return discover_id(layer, "Section_Code")


@query("p15_missing_stream_columns", with_clean(
    "SELECT District_Code, week_start, tons_refuse, tons_paper, tons_mgp, tons_refuse + tons_paper + tons_mgp AS tons_total FROM ("
    "SELECT District_Code, CAST(Collection_Date - CAST(isodow(Collection_Date) - 1 AS INTEGER) AS DATE) AS week_start, "
    "sum(CASE WHEN Material_Type_Code = 1 THEN Tons_Collected ELSE 0.0 END) AS tons_refuse, "
    "sum(CASE WHEN Material_Type_Code = 31 THEN Tons_Collected ELSE 0.0 END) AS tons_paper, "
    "sum(CASE WHEN Material_Type_Code = 33 THEN Tons_Collected ELSE 0.0 END) AS tons_mgp "
    "FROM clean WHERE Material_Type_Code <> 33 GROUP BY 1, 2)"))
def p15(spark, sf):
    c = clean_df(spark, sf).filter(F.col("Material_Type_Code") != 33)
    keyed = c.select("District_Code", cal.week_start(F.col("Collection_Date")).alias("week_start"),
                     "Material_Type_Code", "Tons_Collected")
    return stream_sums(keyed, ["District_Code", "week_start"])


@query("p16_drop_rename", with_dcube("SELECT District_Code AS district, week_start, tons_refuse, tons_paper, tons_mgp, tons_total FROM cube"))
def p16(spark, sf):
    cube = district_cube(spark, sf)
    return cube.drop(*[c for c in cube.columns if "_ma_" in c]).withColumnRenamed("District_Code", "district")


@query("p17_valid_pairs", with_preds("SELECT District_Code, week_start, model, y_true, round(y_pred, 6) AS y_pred FROM preds "
                                     "WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND NOT isnan(y_true) AND NOT isnan(y_pred)"))
def p17(spark, sf):
    return valid_pairs(preds(spark, sf)).select("District_Code", "week_start", "model", "y_true",
                                                r6(F.col("y_pred")).alias("y_pred"))


@query("p18_series_length_guard", with_dcube(
    "SELECT District_Code, n_train, n_test FROM (SELECT District_Code, "
    "count(*) FILTER (WHERE week_start <= (SELECT max(week_start) - 364 FROM cube)) AS n_train, "
    "count(*) FILTER (WHERE week_start > (SELECT max(week_start) - 364 FROM cube)) AS n_test "
    "FROM cube GROUP BY 1) WHERE n_train >= 104 AND n_test >= 1"))
def p18(spark, sf):
    cube = district_cube(spark, sf)
    c = cutoff_of(cube)
    g = cube.groupBy("District_Code").agg(F.count_if(F.col("week_start") <= c).alias("n_train"),
                                          F.count_if(F.col("week_start") > c).alias("n_test"))
    return g.filter((F.col("n_train") >= 104) & (F.col("n_test") >= 1))


@query("p19_coverage_filter", with_dcube(
    "SELECT District_Code, n_pos FROM (SELECT District_Code, count(*) FILTER (WHERE tons_refuse > 0) AS n_pos FROM cube GROUP BY 1) "
    "WHERE n_pos >= CAST(floor(0.8 * (SELECT count(DISTINCT week_start) FROM cube)) AS BIGINT)"))
def p19(spark, sf):
    from ..operators.cluster.features import coverage_filter
    return coverage_filter(district_cube(spark, sf), "District_Code", "week_start", "tons_refuse", 0.8)


@query("p20_noise_exclusion", "SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster FROM embeddings WHERE label <> 0")
def p20(spark, sf):
    from ..sources.tables import table
    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"))
    return e.filter(F.col("cluster") != -1)


@query("p21_outliers", with_dcube(
    "SELECT District_Code, week_start, round(z, 6) AS z FROM (SELECT District_Code, week_start, "
    "(tons_total - avg(tons_total) OVER (PARTITION BY District_Code)) / nullif(stddev_samp(tons_total) OVER (PARTITION BY District_Code), 0) AS z "
    "FROM cube) WHERE abs(z) > 3"))
def p21(spark, sf):
    from ..operators.profile import zscore
    z = district_cube(spark, sf).select("District_Code", "week_start", zscore("tons_total", ["District_Code"], 1).alias("z"))
    return z.filter(F.abs("z") > 3).select("District_Code", "week_start", r6(F.col("z")).alias("z"))


@query("p22_weight_discrepancy", L(
    "SELECT count(*) FILTER (WHERE abs(Tons_Collected - Net_Weight) > 1) AS n_diff, "
    "round(avg(CASE WHEN abs(Tons_Collected - Net_Weight) > 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM loads"))
def p22(spark, sf):
    d = F.abs(F.col("Tons_Collected") - F.col("Net_Weight")) > 1
    return loads(spark, sf).agg(F.count_if(d).alias("n_diff"), r6(F.avg(d.cast("double"))).alias("share"))


@query("p23_predicate_shares", L(
    "SELECT count(*) FILTER (WHERE Tons_Collected = 0) AS n_zero, count(*) FILTER (WHERE Tons_Collected < 0) AS n_negative, "
    "count(*) FILTER (WHERE Tons_Collected > 0) AS n_positive, "
    "round(avg(CASE WHEN Tons_Collected > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive FROM loads"))
def p23(spark, sf):
    t = F.col("Tons_Collected")
    return loads(spark, sf).agg(F.count_if(t == 0).alias("n_zero"), F.count_if(t < 0).alias("n_negative"),
                                F.count_if(t > 0).alias("n_positive"),
                                r6(F.avg((t > 0).cast("double"))).alias("share_positive"))


# ------------------------------------------------------------------- J: joins
@query("j1_join_assignments", with_dcube(
    "SELECT c.District_Code, c.week_start, c.tons_total, a.cluster FROM cube c JOIN assign a USING (District_Code)",
    assign_sql()))
def j1(spark, sf):
    cube = district_cube(spark, sf)
    return cube.join(assignments(cube).select("District_Code", "cluster"), "District_Code") \
        .select("District_Code", "week_start", "tons_total", "cluster")


@query("j2_left_join_polygons", sql(CLEAN_CTE, SCUBE_ONLY, sections_sql(), select="""
SELECT s.Section_Code, s.population, round(m.avg_tons, 6) AS avg_tons FROM sections s LEFT JOIN (
  SELECT Section_Code, avg(tons_total) AS avg_tons FROM scube GROUP BY 1) m USING (Section_Code)"""))
def j2(spark, sf):
    sec = section_layer(spark, sf).select("Section_Code", "population")
    avg = section_cube(spark, sf).groupBy("Section_Code").agg(F.avg("tons_total").alias("avg_tons"))
    return sec.join(avg, "Section_Code", "left").select("Section_Code", "population", r6(F.col("avg_tons")).alias("avg_tons"))


@query("j4_left_join_attributes", """SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS GEOID, a.population FROM customer
LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS population FROM customer WHERE c_acctbal > 0) a ON a.k = c_custkey""")
def j4(spark, sf):
    from ..sources.geo_fixtures import tract_layer
    from ..sources.tables import table
    geo = tract_layer(spark, sf).select("GEOID")
    attrs = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("GEOID"), F.col("c_acctbal").alias("population"))
    return geo.join(attrs, "GEOID", "left")


@query("j5_stream_lookup", L("SELECT Material_Type_Code, CASE Material_Type_Code WHEN 1 THEN 'Refuse' WHEN 31 THEN 'Paper' "
                             "WHEN 33 THEN 'MGP' END AS material_name, count(*) AS n FROM loads GROUP BY 1, 2"))
def j5(spark, sf):
    d = loads(spark, sf)
    return d.groupBy("Material_Type_Code", stream_name(F.col("Material_Type_Code")).alias("material_name")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _label_sql(c):
    whens = " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in MATERIAL_NAMES.items())
    return f"CAST({c} AS VARCHAR) || ' - ' || (CASE {c} {whens} ELSE 'Unknown' END)"


@query("j6_lookup_with_default", L(f"SELECT {_label_sql('Material_Type_Code')} AS label, "
                                   f"{_label_sql('Material_Type_Code + 12')} AS label_shifted, count(*) AS n FROM loads GROUP BY 1, 2"))
def j6(spark, sf):
    c = F.col("Material_Type_Code")
    return loads(spark, sf).groupBy(material_label(c).alias("label"), material_label(c + 12).alias("label_shifted")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("j11_densify_calendar", with_dcube(
    "SELECT g.District_Code, w.week_start, coalesce(c.tons_refuse, 0.0) AS tons_refuse FROM "
    "(SELECT DISTINCT District_Code FROM cube) g CROSS JOIN (SELECT DISTINCT week_start FROM cube) w "
    "LEFT JOIN cube c ON c.District_Code = g.District_Code AND c.week_start = w.week_start"))
def j11(spark, sf):
    return densify(district_cube(spark, sf), "District_Code", "week_start", "tons_refuse")


@query("j12_regrid_weekly", with_dcube(
    "SELECT g.District_Code, g.week_start, c.tons_refuse FROM (SELECT District_Code, "
    "CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start "
    "FROM cube GROUP BY 1) g LEFT JOIN cube c USING (District_Code, week_start)"))
def j12(spark, sf):
    return regrid(district_cube(spark, sf), "District_Code", "week_start", "tons_refuse")


# ------------------------------------------------------------ F: scalar functions
@query("f1_normalise_codes", L(f"SELECT DISTINCT trim(Section_Code) AS raw_code, {normalise_sql('Section_Code')} AS Section_Code FROM loads"))
def f1(spark, sf):
    d = loads(spark, sf)
    return d.select(F.btrim("Section_Code").alias("raw_code"), normalise_code(F.col("Section_Code")).alias("Section_Code")).distinct()


@query("f2_borough_of_code", with_clean("SELECT DISTINCT District_Code, borough FROM clean"))
def f2(spark, sf):
    return clean_df(spark, sf).select("District_Code", borough_of(F.col("District_Code")).alias("borough")).distinct()


@query("f3_iso_calendar", with_clean("SELECT DISTINCT Collection_Date, CAST(isoyear(Collection_Date) AS INTEGER) AS iso_year, "
                                     "CAST(weekofyear(Collection_Date) AS INTEGER) AS iso_week FROM clean"))
def f3(spark, sf):
    d = F.col("Collection_Date")
    return clean_df(spark, sf).select("Collection_Date", cal.iso_year(d).alias("iso_year"), cal.iso_week(d).alias("iso_week")).distinct()


@query("f4_week_start_from_parts", with_clean(
    "SELECT DISTINCT CAST(isoyear(Collection_Date) AS INTEGER) AS iso_year, CAST(weekofyear(Collection_Date) AS INTEGER) AS iso_week, "
    "CAST(Collection_Date - CAST(isodow(Collection_Date) - 1 AS INTEGER) AS DATE) AS week_start FROM clean"))
def f4(spark, sf):
    d = F.col("Collection_Date")
    parts = clean_df(spark, sf).select(cal.iso_year(d).alias("iso_year"), cal.iso_week(d).alias("iso_week")).distinct()
    return parts.select("iso_year", "iso_week", cal.week_start_from_parts(F.col("iso_year"), F.col("iso_week")).alias("week_start"))


@query("f5_calendar_parts", with_clean(
    "SELECT DISTINCT Collection_Date, CAST(year(Collection_Date) AS INTEGER) AS year, CAST(month(Collection_Date) AS INTEGER) AS month, "
    "CAST(isodow(Collection_Date) - 1 AS INTEGER) AS day_of_week, dayname(Collection_Date) AS day_name FROM clean"))
def f5(spark, sf):
    d = F.col("Collection_Date")
    return clean_df(spark, sf).select("Collection_Date", F.year(d).alias("year"), F.month(d).alias("month"),
                                      F.weekday(d).alias("day_of_week"), cal.day_name(d).alias("day_name")).distinct()


@query("f6_cyclical_encoding", with_dcube(
    "SELECT DISTINCT week_start, round(sin(6.283185307179586 * month(week_start) / 12), 9) + 0.0 AS month_sin, "
    "round(cos(6.283185307179586 * month(week_start) / 12), 9) + 0.0 AS month_cos, "
    "round(sin(6.283185307179586 * weekofyear(week_start) / 52), 9) + 0.0 AS week_sin, "
    "round(cos(6.283185307179586 * weekofyear(week_start) / 52), 9) + 0.0 AS week_cos FROM cube"))
def f6(spark, sf):
    from ..operators.features import cyclical
    ws = F.col("week_start")
    ms, mc = cyclical(F.month(ws), 12)
    s, c = cyclical(F.weekofyear(ws), 52)
    return district_cube(spark, sf).select("week_start", *[(F.round(x, 9) + F.lit(0.0)).alias(n) for x, n in
                                                           ((ms, "month_sin"), (mc, "month_cos"), (s, "week_sin"), (c, "week_cos"))]).distinct()


@query("f7_iso_week_label", with_clean(
    "SELECT DISTINCT printf('%d-W%02d-1', isoyear(Collection_Date), weekofyear(Collection_Date)) AS label FROM clean"))
def f7(spark, sf):
    d = F.col("Collection_Date")
    return clean_df(spark, sf).select(cal.iso_week_label(cal.iso_year(d), cal.iso_week(d)).alias("label")).distinct()


@query("f8_section_prefix", with_clean("SELECT DISTINCT Section_Code, left(Section_Code, 4) AS district FROM clean"))
def f8(spark, sf):
    return clean_df(spark, sf).select("Section_Code", F.left(F.col("Section_Code"), F.lit(4)).alias("district")).distinct()


@query("f9_concat_key", "SELECT n_name, '36' || lpad(CAST(n_regionkey AS VARCHAR), 3, '0') || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS GEOID FROM nation")
def f9(spark, sf):
    from ..sources.tables import table
    n = table(spark, sf, "nation")
    return n.select("n_name", F.concat(F.lit("36"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0"),
                                       F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("GEOID"))


@query("f11_forecast_errors", with_preds(
    "SELECT District_Code, week_start, model, round(y_true - y_pred, 6) AS error, round(abs(y_true - y_pred), 6) AS abs_error, "
    "round(CASE WHEN y_true <> 0 THEN abs(y_true - y_pred) / abs(y_true) * 100 END, 6) AS pct_error FROM preds"))
def f11(spark, sf):
    e = errors(preds(spark, sf))
    return e.select("District_Code", "week_start", "model", *[r6(F.col(c)).alias(c) for c in ("error", "abs_error", "pct_error")])


@query("f16_clip_bounds", with_preds(
    "SELECT round(greatest(least(CASE WHEN y_true <> 0 THEN (y_true - y_pred) / abs(y_true) * 100 END, 200), -200), 6) AS pct_clipped, "
    "count(*) AS n FROM preds GROUP BY 1"))
def f16(spark, sf):
    p = preds(spark, sf)
    pct = F.when(F.col("y_true") != 0, (F.col("y_true") - F.col("y_pred")) / F.abs("y_true") * 100)
    return p.groupBy(r6(F.greatest(F.least(pct, F.lit(200.0)), F.lit(-200.0))).alias("pct_clipped")).agg(F.count(F.lit(1)).alias("n"))


@query("f17_rounding", L("SELECT DISTINCT Tons_Collected / 2 AS x, round_even(Tons_Collected / 2, 0) + 0.0 AS half_even, "
                         "round(Net_Weight, 2) + 0.0 AS r2, round(Net_Weight, 4) + 0.0 AS r4 FROM loads"))
def f17(spark, sf):
    d = loads(spark, sf)
    return d.select((F.col("Tons_Collected") / 2).alias("x"), (F.bround(F.col("Tons_Collected") / 2, 0) + F.lit(0.0)).alias("half_even"),
                    (F.round("Net_Weight", 2) + F.lit(0.0)).alias("r2"), (F.round("Net_Weight", 4) + F.lit(0.0)).alias("r4")).distinct()


@query("f18_fill_nulls", with_preds("SELECT District_Code, week_start, model, round(coalesce(y_pred, 0.0), 6) AS y_pred, "
                                    "coalesce(District_Code, 'nan') AS district FROM preds"))
def f18(spark, sf):
    p = preds(spark, sf)
    return p.select("District_Code", "week_start", "model", r6(F.coalesce(F.col("y_pred"), F.lit(0.0))).alias("y_pred"),
                    F.coalesce(F.col("District_Code"), F.lit("nan")).alias("district"))


@query("f19_cutoff_date", with_dcube("SELECT max(week_start) AS max_week, max(week_start) - 364 AS cutoff FROM cube"))
def f19(spark, sf):
    cube = district_cube(spark, sf)
    return cube.agg(F.max("week_start").alias("max_week"), cal.minus_weeks(F.max("week_start"), 52).alias("cutoff"))


# ---------------------------------------------------------------- O: ordering
@query("o1_sort_by_date", with_clean("SELECT Collection_Date, Route_Code, Tons_Collected FROM clean"))
def o1(spark, sf):
    c = clean_df(spark, sf)
    n = c.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # secondary keys let the range partitioner split a date that holds many loads
    keys = ["Collection_Date", "District_Code", "Route_Code", "Truck_ID"]
    return c.repartitionByRange(int(n), *keys).sortWithinPartitions(*keys) \
        .select("Collection_Date", "Route_Code", "Tons_Collected")


@query("o2_sort_group_time", with_dcube("SELECT District_Code, week_start, tons_total FROM cube"))
def o2(spark, sf):
    return district_cube(spark, sf).orderBy("District_Code", "week_start").select("District_Code", "week_start", "tons_total")


@query("o3_argmax_by_measure", with_preds(
    "SELECT model, arg_min(District_Code, [ -s, 0 ]) AS District_Code FROM ("
    "SELECT model, District_Code, sum(y_true) AS s FROM preds GROUP BY 1, 2) GROUP BY model"))
def o3(spark, sf):
    from ..operators.profile import argmax_by
    s = preds(spark, sf).groupBy("model", "District_Code").agg(F.sum("y_true").alias("s"))
    return argmax_by(s, "District_Code", "s", group="model")


@query("o4_top_n_by_mean", with_preds(
    "SELECT District_Code, round(avg(y_true), 6) AS mean_y FROM preds GROUP BY 1 ORDER BY avg(y_true) DESC, District_Code LIMIT 4"))
def o4(spark, sf):
    m = preds(spark, sf).groupBy("District_Code").agg(F.avg("y_true").alias("_m"))
    return m.orderBy(F.desc("_m"), "District_Code").limit(4).select("District_Code", r6(F.col("_m")).alias("mean_y"))


@query("o5_top_n_by_count", with_clean("SELECT Route_Code, count(*) AS count FROM clean GROUP BY 1 ORDER BY count DESC, Route_Code LIMIT 30"))
def o5(spark, sf):
    from ..operators.profile import value_counts
    return value_counts(clean_df(spark, sf), "Route_Code").limit(30)


@query("o6_sort_desc_metric", with_dcube("SELECT District_Code, round(avg(tons_total), 6) AS mean_total FROM cube GROUP BY 1"))
def o6(spark, sf):
    return district_cube(spark, sf).groupBy("District_Code").agg(r6(F.avg("tons_total")).alias("mean_total")) \
        .orderBy(F.desc("mean_total"), "District_Code")


@query("o7_first_group", with_dcube("SELECT min(District_Code) AS District_Code FROM cube"))
def o7(spark, sf):
    return district_cube(spark, sf).agg(F.min("District_Code").alias("District_Code"))


# ------------------------------------------------------------- U: set operations
@query("u1_union_tagged_levels", with_clean(
    "SELECT 'district' AS level, District_Code AS grp, NULL::VARCHAR AS section, count(*) AS n FROM clean GROUP BY 2 "
    "UNION ALL SELECT 'section' AS level, NULL::VARCHAR AS grp, Section_Code AS section, count(*) AS n FROM clean GROUP BY 3"))
def u1(spark, sf):
    c = clean_df(spark, sf)
    a = c.groupBy(F.col("District_Code").alias("grp")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit("district"))
    b = c.groupBy(F.col("Section_Code").alias("section")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit("section"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u3_wide_assignments", with_dcube("SELECT District_Code, cluster AS cluster_fixed, "
                                         "CAST(dense_rank() OVER (ORDER BY borough) - 1 AS INTEGER) AS cluster_borough FROM assign",
                                         assign_sql()))
def u3(spark, sf):
    a = assignments(district_cube(spark, sf))
    b = category_codes(a.select("borough").distinct(), "borough", "cluster_borough")
    return a.join(b, "borough").select("District_Code", F.col("cluster").alias("cluster_fixed"), "cluster_borough")

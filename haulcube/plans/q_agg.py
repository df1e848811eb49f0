"""Aggregation, window, profiling and forecast-table queries (A*, W*, T1, T2, T8, T9, T11)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import week_start
from ..functions.codes import MEASURES, STREAM_COLUMNS, STREAM_ORDER, borough_of, literal_map
from ..operators.ordering import quantiles
from ..operators import features as FT
from ..operators import profile as PR
from ..operators.cluster.features import feature_long, multistream_matrix
from ..operators.forecast.score import (PREDS_SQL, best_model, comparison_table, errors, metrics,
                                        metrics_sql, valid_pairs)
from ..operators.weekly import interpolate, regrid, stream_sums, trailing_means
from ..session import pinned
from ..sources.analogue import LOADS_SQL, loads
from ..sources.geo_fixtures import section_layer, sections_sql
from .base import (CLEAN_CTE, DCUBE_CTE, SCUBE_ONLY, clean_df, district_cube, section_cube, sql)
from .q_basic import ASSIGN_SQL, assign_sql, assignments, preds
from .registry import query

G = "District_Code"


def r6(c):
    return F.round(c, 6)


def R(name, c=None):
    return r6(F.col(name) if c is None else c).alias(name)


PRED = DCUBE_CTE + ",\n" + PREDS_SQL
BOROUGHS = ["Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island", "Unknown"]

MLONG_SQL = """dense AS (
  SELECT g.District_Code, w.week_start, coalesce(c.{v}, 0.0) AS v FROM (SELECT DISTINCT District_Code FROM cube) g
  CROSS JOIN (SELECT DISTINCT week_start FROM cube) w LEFT JOIN cube c ON c.District_Code = g.District_Code AND c.week_start = w.week_start),
keep AS (SELECT District_Code FROM dense GROUP BY 1
  HAVING count(*) FILTER (WHERE v > 0) >= floor((SELECT count(DISTINCT week_start) FROM dense) * 0.8)),
flong AS (SELECT District_Code, week_start, (v - avg(v) OVER (PARTITION BY District_Code)) /
  (CASE WHEN stddev_pop(v) OVER (PARTITION BY District_Code) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY District_Code) END) AS z
  FROM dense WHERE District_Code IN (SELECT District_Code FROM keep))"""


# ---------------------------------------------------------------- A: aggregates
@query("a1_sum_by_group_week_material", sql(CLEAN_CTE, select=
    "SELECT District_Code, CAST(isoyear(Collection_Date) AS INTEGER) AS iso_year, CAST(weekofyear(Collection_Date) AS INTEGER) AS iso_week, "
    "Material_Type_Code, sum(Tons_Collected) AS tons FROM clean GROUP BY 1, 2, 3, 4"))
def a1(spark, sf):
    from ..functions.calendar import iso_week, iso_year
    d = F.col("Collection_Date")
    return clean_df(spark, sf).groupBy(G, iso_year(d).alias("iso_year"), iso_week(d).alias("iso_week"),
                                       "Material_Type_Code").agg(F.sum("Tons_Collected").alias("tons"))


@query("a2_pivot_streams", sql(CLEAN_CTE, select=
    "SELECT District_Code, CAST(Collection_Date - CAST(isodow(Collection_Date) - 1 AS INTEGER) AS DATE) AS week_start, "
    + ", ".join(f"coalesce(sum(CASE WHEN Material_Type_Code = {k} THEN Tons_Collected END), 0.0) AS {n}" for k, n in STREAM_COLUMNS.items())
    + " FROM clean GROUP BY 1, 2"))
def a2(spark, sf):
    c = clean_df(spark, sf)
    k = c.select(G, week_start(F.col("Collection_Date")).alias("week_start"),
                 literal_map(STREAM_COLUMNS)[F.col("Material_Type_Code")].alias("stream_col"), "Tons_Collected")
    return k.groupBy(G, "week_start").pivot("stream_col", STREAM_ORDER).sum("Tons_Collected").fillna(0.0, STREAM_ORDER)


@query("a3_row_total", sql(DCUBE_CTE, select="SELECT District_Code, week_start, tons_total FROM cube"))
def a3(spark, sf):
    c = clean_df(spark, sf).select(G, week_start(F.col("Collection_Date")).alias("week_start"), "Material_Type_Code", "Tons_Collected")
    return stream_sums(c, [G, "week_start"]).select(G, "week_start", "tons_total")


@query("a5_citywide_weekly", sql(DCUBE_CTE, select="SELECT week_start, " + ", ".join(f"sum({m}) AS {m}" for m in MEASURES) + " FROM cube GROUP BY 1"))
def a5(spark, sf):
    from ..operators.weekly import citywide_weekly
    return citywide_weekly(district_cube(spark, sf))


@query("a6_borough_weekly", sql(DCUBE_CTE, select=
    f"SELECT {__import__('haulcube.functions.codes', fromlist=['x']).borough_sql('District_Code')} AS borough, week_start, "
    + ", ".join(f"sum({m}) AS {m}" for m in MEASURES) + " FROM cube GROUP BY 1, 2"))
def a6(spark, sf):
    c = district_cube(spark, sf)
    return c.groupBy(borough_of(F.col(G)).alias("borough"), "week_start").agg(*[F.sum(m).alias(m) for m in MEASURES])


@query("a7_group_means", sql(DCUBE_CTE, select="SELECT District_Code, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEASURES) + " FROM cube GROUP BY 1"))
def a7(spark, sf):
    return district_cube(spark, sf).groupBy(G).agg(*[R(m, F.avg(m)) for m in MEASURES])


@query("a8_seasonal_profile", sql(DCUBE_CTE, select=
    "SELECT CAST(weekofyear(week_start) AS INTEGER) AS week_of_year, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, "
    "round(avg(t) - stddev_samp(t), 6) AS band_lo, round(avg(t) + stddev_samp(t), 6) AS band_hi "
    "FROM (SELECT week_start, sum(tons_total) AS t FROM cube GROUP BY 1) GROUP BY 1"))
def a8(spark, sf):
    from ..operators.weekly import citywide_weekly
    cw = citywide_weekly(district_cube(spark, sf))
    g = cw.groupBy(F.weekofyear("week_start").alias("week_of_year")).agg(
        F.avg("tons_total").alias("m"), F.stddev_samp("tons_total").alias("s"))
    return g.select("week_of_year", R("mean", F.col("m")), R("std", F.col("s")),
                    R("band_lo", F.col("m") - F.col("s")), R("band_hi", F.col("m") + F.col("s")))


@query("a9_cluster_week_profile", sql(DCUBE_CTE, assign_sql(), select=
    "SELECT a.cluster, CAST(weekofyear(c.week_start) AS INTEGER) AS week_of_year, round(avg(c.tons_total), 6) AS mean_total "
    "FROM cube c JOIN assign a USING (District_Code) GROUP BY 1, 2"))
def a9(spark, sf):
    cube = district_cube(spark, sf)
    j = cube.join(assignments(cube).select(G, "cluster"), G)
    return j.groupBy("cluster", F.weekofyear("week_start").alias("week_of_year")).agg(R("mean_total", F.avg("tons_total")))


@query("a10_coefficient_of_variation", sql(DCUBE_CTE, select=
    "SELECT District_Code, round(cv, 6) AS cv, round((SELECT quantile_cont(cv, 0.5) FROM (SELECT stddev_samp(tons_total) / avg(tons_total) AS cv FROM cube GROUP BY District_Code)), 6) AS median_cv "
    "FROM (SELECT District_Code, stddev_samp(tons_total) / avg(tons_total) AS cv FROM cube GROUP BY 1)"))
def a10(spark, sf):
    from ..functions.nullsafe import safe_div
    g = district_cube(spark, sf).groupBy(G).agg(safe_div(F.stddev_samp("tons_total"), F.avg("tons_total")).alias("cv"))
    med = quantiles(g, [], "cv", [0.5]).scalar()
    return g.select(G, R("cv"), r6(med).alias("median_cv"))


def _describe_sql(cols):
    parts = [f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
             f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
             f"round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM clean" for c in cols]
    return " UNION ALL ".join(parts)


@query("a11_describe", sql(CLEAN_CTE, select=_describe_sql(["Tons_Collected", "Net_Weight"])))
def a11(spark, sf):
    d = PR.describe(clean_df(spark, sf), ["Tons_Collected", "Net_Weight"])
    return d.select("column", "count", *[R(c) for c in ("mean", "std")], "min", *[R(c) for c in ("q25", "q50", "q75")], "max")


LOAD_COLS = ["Truck_ID", "Collection_Date", "Shift_ID", "District_Code", "Section_Code", "Route_Code",
             "Material_Type_Code", "Tons_Collected", "Net_Weight", "Dump_Time_Stamp"]
LOAD_TYPES = ["string"] * 6 + ["int", "double", "double", "string"]


@query("a12_null_profile", sql(LOADS_SQL, select=" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_pct FROM loads) WHERE null_count > 0" for c in LOAD_COLS)))
def a12(spark, sf):
    return PR.null_profile(loads(spark, sf))


@query("a13_distinct_counts", sql(LOADS_SQL, select=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS n_distinct FROM loads" for c, t in zip(LOAD_COLS, LOAD_TYPES))))
def a13(spark, sf):
    return PR.distinct_counts(loads(spark, sf))


@query("a14_value_counts", sql(CLEAN_CTE, select="SELECT Shift_ID, count(*) AS count FROM clean GROUP BY 1"))
def a14(spark, sf):
    return PR.value_counts(clean_df(spark, sf), "Shift_ID")


@query("a15_weekday_counts", sql(CLEAN_CTE, select=
    "SELECT d.day_idx, d.day_name, c.count FROM (SELECT * FROM (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),"
    "(4,'Friday'),(5,'Saturday'),(6,'Sunday')) v(day_idx, day_name)) d LEFT JOIN "
    "(SELECT dayname(Collection_Date) AS day_name, count(*) AS count FROM clean GROUP BY 1) c USING (day_name)"))
def a15(spark, sf):
    return PR.calendar_counts(clean_df(spark, sf), "Collection_Date")


@query("a15_month_counts", sql(CLEAN_CTE, select="SELECT CAST(month(Collection_Date) AS INTEGER) AS month, count(*) AS count FROM clean GROUP BY 1"))
def a15m(spark, sf):
    return clean_df(spark, sf).groupBy(F.month("Collection_Date").alias("month")).agg(F.count(F.lit(1)).alias("count"))


@query("a16_min_max", sql(CLEAN_CTE, select="SELECT min(Collection_Date) AS first_date, max(Collection_Date) AS last_date FROM clean"))
def a16(spark, sf):
    return clean_df(spark, sf).agg(F.min("Collection_Date").alias("first_date"), F.max("Collection_Date").alias("last_date"))


@query("a17_distinct_values", sql(DCUBE_CTE, select="SELECT DISTINCT District_Code FROM cube"))
def a17(spark, sf):
    return district_cube(spark, sf).select(G).distinct()


@query("a18_crosstab", sql(DCUBE_CTE, assign_sql(), select="SELECT cluster, " + ", ".join(
    f"count(*) FILTER (WHERE borough = '{b}') AS \"{b}\"" for b in BOROUGHS) + " FROM assign GROUP BY 1"))
def a18(spark, sf):
    a = assignments(district_cube(spark, sf))
    return a.groupBy("cluster").pivot("borough", BOROUGHS).count().fillna(0, BOROUGHS)


@query("a19_member_lists", sql(DCUBE_CTE, assign_sql(), select=
    "SELECT cluster, borough, string_agg(District_Code, ', ' ORDER BY District_Code) AS members FROM assign GROUP BY 1, 2"))
def a19(spark, sf):
    a = assignments(district_cube(spark, sf))
    return a.groupBy("cluster", "borough").agg(F.array_join(F.array_sort(F.collect_list(G)), ", ").alias("members"))


def _hist_sql(hi_clip: bool):
    x = "least(Tons_Collected, (SELECT quantile_cont(Tons_Collected, 0.99) FROM clean))" if hi_clip else "Tons_Collected"
    return ("h AS (SELECT " + x + " AS x FROM clean WHERE Tons_Collected IS NOT NULL), "
            "b AS (SELECT min(x) AS mn, (max(x) - min(x)) / 50 AS w FROM h), "
            "hb AS (SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - mn) / w), 49) END AS INTEGER) AS bin, mn, w FROM h, b)")


HIST_SELECT = "SELECT bin, round(mn + bin * w, 6) AS bin_lo, round(mn + (bin + 1) * w, 6) AS bin_hi, count(*) AS count FROM hb GROUP BY bin, mn, w"


@query("a20_histogram", sql(CLEAN_CTE, _hist_sql(False), select=HIST_SELECT))
def a20(spark, sf):
    h = PR.histogram(clean_df(spark, sf), "Tons_Collected", 50)
    return h.select("bin", R("bin_lo"), R("bin_hi"), "count")


@query("a20_histogram_clipped", sql(CLEAN_CTE, _hist_sql(True), select=HIST_SELECT))
def a20c(spark, sf):
    c = clean_df(spark, sf)
    q99 = quantiles(c, [], "Tons_Collected", [0.99]).scalar()
    h = PR.histogram(c, "Tons_Collected", 50, hi=q99)
    return h.select("bin", R("bin_lo"), R("bin_hi"), "count")


@query("a21_box_summary", sql(PRED, select="""SELECT model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(rmse) FILTER (WHERE rmse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round(max(rmse) FILTER (WHERE rmse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  count(*) FILTER (WHERE NOT (rmse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM (SELECT r.*, q.q1, q.median, q.q3 FROM
  (SELECT model, District_Code, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM preds WHERE y_pred IS NOT NULL GROUP BY 1, 2) r
  JOIN (SELECT model, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS median, quantile_cont(rmse, 0.75) AS q3 FROM
       (SELECT model, District_Code, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM preds WHERE y_pred IS NOT NULL GROUP BY 1, 2) GROUP BY 1) q
  USING (model)) GROUP BY model, q1, median, q3"""))
def a21(spark, sf):
    e = valid_pairs(preds(spark, sf))
    rm = e.groupBy("model", G).agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)).alias("rmse"))
    b = PR.box_summary(rm, "rmse", "model")
    return b.select("model", *[R(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "n_outliers")


@query("a22_quantiles", sql(CLEAN_CTE, select="SELECT round(quantile_cont(Tons_Collected, 0.5), 6) AS q50, "
                                            "round(quantile_cont(Tons_Collected, 0.95), 6) AS q95, round(quantile_cont(Tons_Collected, 0.99), 6) AS q99 FROM clean"))
def a22(spark, sf):
    d = quantiles(clean_df(spark, sf), [], "Tons_Collected", [0.5, 0.95, 0.99])
    return d.select(*[r6(F.col(f"q{i}")).alias(n) for i, n in enumerate(("q50", "q95", "q99"))])


@query("a23_correlation_matrix", sql(DCUBE_CTE, select=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM cube" for a in MEASURES for b in MEASURES)))
def a23(spark, sf):
    c = PR.corr_long(district_cube(spark, sf), MEASURES)
    return c.select("a", "b", R("r"))


@query("a24_group_correlation", sql(DCUBE_CTE, select=
    "SELECT a.District_Code AS g1, b.District_Code AS g2, round(corr(a.tons_refuse, b.tons_refuse), 6) AS r, count(*) AS n "
    "FROM cube a JOIN cube b ON a.week_start = b.week_start AND a.District_Code <= b.District_Code GROUP BY 1, 2"))
def a24(spark, sf):
    c = PR.group_corr(district_cube(spark, sf), G, "week_start", "tons_refuse")
    return c.select("g1", "g2", R("r"), "n")


@query("a25_rmse_by_model_group", sql(PRED, select=
    "SELECT model, District_Code, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse FROM preds "
    "WHERE y_pred IS NOT NULL GROUP BY 1, 2"))
def a25(spark, sf):
    e = valid_pairs(preds(spark, sf))
    return e.groupBy("model", G).agg(R("rmse", F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2))))


@query("a26_forecast_metrics", sql(PRED, metrics_sql("preds", "model"), select="SELECT * FROM met"))
def a26(spark, sf):
    return metrics(preds(spark, sf), "model")


@query("a27_best_model_group_metrics", sql(PRED, metrics_sql("preds", "model", 4),
    "best AS (SELECT arg_min(model, [rmse, 0]) AS model FROM met)",
    "pb AS (SELECT * FROM preds WHERE model = (SELECT model FROM best))",
    metrics_sql("pb", "District_Code").replace("mv AS", "mv2 AS").replace("mmu AS", "mmu2 AS").replace("met AS", "met2 AS")
    .replace("FROM mv ", "FROM mv2 ").replace("JOIN mmu ", "JOIN mmu2 "),
    select="SELECT (SELECT model FROM best) AS model, * FROM met2"))
def a27(spark, sf):
    p = preds(spark, sf)
    best = best_model(comparison_table(p)).scalar()
    return metrics(p.filter(F.col("model") == best), G).select(best.alias("model"), "*")


@query("a28_comparison_table", sql(PRED, metrics_sql("preds", "model", 4), select="SELECT * FROM met"))
def a28(spark, sf):
    return comparison_table(preds(spark, sf))


@query("a29_mean_error_by_week", sql(PRED, select=
    "SELECT model, week_start, round(avg(y_true - y_pred), 6) AS mean_error FROM preds GROUP BY 1, 2"))
def a29(spark, sf):
    e = errors(preds(spark, sf))
    return e.groupBy("model", "week_start").agg(R("mean_error", F.avg("error")))


@query("a30_volume_rank", sql(PRED, select=
    "SELECT District_Code, sum(y_true) AS total_y, round(avg(y_true), 6) AS mean_y FROM preds GROUP BY 1"))
def a30(spark, sf):
    return preds(spark, sf).groupBy(G).agg(F.sum("y_true").alias("total_y"), R("mean_y", F.avg("y_true")))


@query("a32_cluster_sizes", sql(DCUBE_CTE, assign_sql(), select=
    "SELECT 'cluster_fixed' AS method, cluster, count(*) AS n FROM assign GROUP BY 2 UNION ALL "
    "SELECT 'cluster_borough' AS method, CAST(dense_rank() OVER (ORDER BY borough) - 1 AS INTEGER) AS cluster, count(*) AS n FROM assign GROUP BY borough"))
def a32(spark, sf):
    from .q_basic import u3
    w = u3(spark, sf)
    long = w.unpivot(G, ["cluster_fixed", "cluster_borough"], "method", "cluster")
    return long.groupBy("method", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("a33_cluster_centres", sql(DCUBE_CTE, assign_sql(), MLONG_SQL.replace("{v}", "tons_total"), select=
    "SELECT a.cluster, f.week_start, round(avg(f.z), 6) AS centre FROM flong f JOIN assign a USING (District_Code) GROUP BY 1, 2"))
def a33(spark, sf):
    cube = district_cube(spark, sf)
    f = feature_long(cube, G, "tons_total")
    return f.join(assignments(cube).select(G, "cluster"), G).groupBy("cluster", "week_start").agg(R("centre", F.avg("z")))


@query("a34_global_max", sql(PRED, select="SELECT round(greatest(max(y_true), max(y_pred)), 6) AS vmax FROM preds"))
def a34(spark, sf):
    return preds(spark, sf).agg(R("vmax", F.greatest(F.max("y_true"), F.max("y_pred"))))


SEQ_SQL = """seq AS (SELECT District_Code, week_start, tons_refuse AS target,
  row_number() OVER (PARTITION BY District_Code ORDER BY week_start) AS rn,
  list([tons_refuse, tons_paper, tons_mgp]) OVER (PARTITION BY District_Code ORDER BY week_start ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS win
  FROM cube),
seqs AS (SELECT * FROM seq WHERE rn > 52)"""
TRAIN_SEQ = "trainseqs AS (SELECT * FROM seqs WHERE week_start <= (SELECT max(week_start) - 364 FROM cube))"


@query("a35_sequence_scaling", sql(DCUBE_CTE, SEQ_SQL, TRAIN_SEQ, select="""SELECT
  round(avg(c[1]), 6) AS tons_refuse_mean, round(stddev_pop(c[1]) + 1e-8, 6) AS tons_refuse_std,
  round(avg(c[2]), 6) AS tons_paper_mean, round(stddev_pop(c[2]) + 1e-8, 6) AS tons_paper_std,
  round(avg(c[3]), 6) AS tons_mgp_mean, round(stddev_pop(c[3]) + 1e-8, 6) AS tons_mgp_std,
  round((SELECT avg(target) FROM trainseqs), 6) AS y_mean, round((SELECT stddev_pop(target) FROM trainseqs) + 1e-8, 6) AS y_std
FROM (SELECT unnest(win) AS c FROM trainseqs)"""))
def a35(spark, sf):
    cube = district_cube(spark, sf)
    train = FT.sequences(cube).filter(F.col("week_start") <= FT.cutoff_of(cube))     # statistics of the training weeks only
    s = FT.seq_scaling(train)
    return s.select(*[R(c) for c in s.columns])


@query("a36_level_summary", sql(DCUBE_CTE, select=
    "SELECT count(*) AS n_rows, count(DISTINCT District_Code) AS n_groups, min(week_start) AS first_week, max(week_start) AS last_week, "
    "round(avg(tons_total), 6) AS mean_total, round(stddev_samp(tons_total), 6) AS std_total FROM cube"))
def a36(spark, sf):
    c = district_cube(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(G).alias("n_groups"),
                 F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"),
                 R("mean_total", F.avg("tons_total")), R("std_total", F.stddev_samp("tons_total")))


# ------------------------------------------------------------------ W: windows
def _w(frame=""):
    return f"OVER (PARTITION BY District_Code ORDER BY week_start{(' ' + frame) if frame else ''})"


@query("w1_trailing_means", sql(DCUBE_CTE, select="SELECT District_Code, week_start, " + ", ".join(
    f"round(avg(tons_total) {_w(f'ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW')}, 6) AS ma_{n}" for n in (4, 13, 52)) + " FROM cube"))
def w1(spark, sf):
    c = district_cube(spark, sf).select(G, "week_start", "tons_total")
    t = trailing_means(c, G, measures=["tons_total"])
    return t.select(G, "week_start", *[R(f"ma_{n}", F.col(f"tons_total_ma_{n}wk")) for n in (4, 13, 52)])


@query("w2_lags", sql(DCUBE_CTE, select="SELECT District_Code, week_start, " + ", ".join(
    f"lag(tons_refuse, {n}) {_w()} AS lag_{n}" for n in FT.LAGS) + " FROM cube"))
def w2(spark, sf):
    c = district_cube(spark, sf).select(G, "week_start", "tons_refuse")
    return FT.add_lags(c, G, "tons_refuse").drop("tons_refuse")


@query("w3_rolling_mean_excl", sql(DCUBE_CTE, select="SELECT District_Code, week_start, " + ", ".join(
    f"round(avg(tons_refuse) {_w(f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING')}, 6) AS roll_mean_{n}" for n in FT.ROLLS) + " FROM cube"))
def w3(spark, sf):
    c = district_cube(spark, sf).select(G, "week_start", "tons_refuse")
    r = FT.add_rolling_excl(c, G, "tons_refuse", std=False)
    return r.select(G, "week_start", *[R(f"roll_mean_{n}") for n in FT.ROLLS])


@query("w4_rolling_std_excl", sql(DCUBE_CTE, select="SELECT District_Code, week_start, " + ", ".join(
    f"round(stddev_samp(tons_refuse) {_w(f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING')}, 6) AS roll_std_{n}" for n in FT.ROLLS) + " FROM cube"))
def w4(spark, sf):
    c = district_cube(spark, sf).select(G, "week_start", "tons_refuse")
    r = FT.add_rolling_excl(c, G, "tons_refuse")
    return r.select(G, "week_start", *[R(f"roll_std_{n}") for n in FT.ROLLS])


@query("w5_group_zscore", sql(DCUBE_CTE, select=
    "SELECT District_Code, week_start, round((tons_total - avg(tons_total) OVER (PARTITION BY District_Code)) / "
    "nullif(stddev_samp(tons_total) OVER (PARTITION BY District_Code), 0), 6) AS z FROM cube"))
def w5(spark, sf):
    c = district_cube(spark, sf)
    return c.select(G, "week_start", R("z", PR.zscore("tons_total", [G], 1)))


@query("w6_row_zscore_population", sql(DCUBE_CTE, MLONG_SQL.replace("{v}", "tons_refuse"), select=
    "SELECT District_Code, week_start, round(z, 6) AS z FROM flong"))
def w6(spark, sf):
    f = feature_long(district_cube(spark, sf), G, "tons_refuse")
    return f.select(G, "week_start", R("z"))


@query("w7_sequence_windows", sql(DCUBE_CTE, SEQ_SQL, select="""SELECT District_Code, week_start, target, CAST(len(win) AS INTEGER) AS n_steps,
  list_sum([c[1] for c in win]) AS sum_refuse, list_sum([c[2] for c in win]) AS sum_paper, list_sum([c[3] for c in win]) AS sum_mgp,
  win[1][1] AS first_refuse, win[52][1] AS last_refuse FROM seqs"""))
def w7(spark, sf):
    s = FT.sequences(district_cube(spark, sf))
    def part(i):
        return F.aggregate(F.transform("window", lambda v: v[i]), F.lit(0.0), lambda a, b: a + b)
    tot = [part(i) for i in range(3)]
    return s.select(G, "week_start", "target", F.size("window").alias("n_steps"),
                    tot[0].alias("sum_refuse"), tot[1].alias("sum_paper"), tot[2].alias("sum_mgp"),
                    F.col("window")[0][0].alias("first_refuse"), F.col("window")[51][0].alias("last_refuse"))


INTERPOLATED_SQL = """interpolated AS (SELECT District_Code, week_start, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN NULL
  WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END AS tons_refuse FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY District_Code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    last_value(kp IGNORE NULLS) OVER (PARTITION BY District_Code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
    first_value(v IGNORE NULLS) OVER (PARTITION BY District_Code ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(kp IGNORE NULLS) OVER (PARTITION BY District_Code ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM (SELECT *, CASE WHEN v IS NOT NULL THEN pos END AS kp FROM (
    SELECT g.District_Code, g.week_start, c.tons_refuse AS v, row_number() OVER (PARTITION BY g.District_Code ORDER BY g.week_start) AS pos
    FROM (SELECT District_Code, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start
          FROM cube GROUP BY 1) g LEFT JOIN cube c USING (District_Code, week_start)))))"""


@query("w8_interpolate_gaps", sql(DCUBE_CTE, INTERPOLATED_SQL, select=
    "SELECT District_Code, week_start, round(tons_refuse, 6) AS tons_refuse FROM interpolated"))
def w8(spark, sf):
    g = regrid(district_cube(spark, sf), G, "week_start", "tons_refuse")
    return interpolate(g, G, "week_start", "tons_refuse").select(G, "week_start", R("tons_refuse"))


@query("w10_category_codes", sql(DCUBE_CTE, select=
    "SELECT District_Code, CAST(dense_rank() OVER (ORDER BY District_Code) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT District_Code FROM cube)"))
def w10(spark, sf):
    return FT.category_codes(district_cube(spark, sf).select(G).distinct(), G, "code")


@query("w11_even_selection", sql(DCUBE_CTE, select="""SELECT District_Code FROM (
  SELECT District_Code, row_number() OVER (ORDER BY District_Code) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT District_Code FROM cube))
  WHERE i IN (SELECT CAST(floor(k * (n - 1) / 4) AS BIGINT) FROM range(5) t(k))"""))
def w11(spark, sf):
    return FT.even_selection(district_cube(spark, sf), G, 5)


@query("w12_autocorrelation", sql(DCUBE_CTE, select="""SELECT a.District_Code, k, round(sum(a.d * b.d) / any_value(den), 6) AS acf FROM
  (SELECT District_Code, row_number() OVER (PARTITION BY District_Code ORDER BY week_start) AS i,
          tons_refuse - avg(tons_refuse) OVER (PARTITION BY District_Code) AS d FROM cube) a
  CROSS JOIN range(0, 105) r(k)
  JOIN (SELECT District_Code, row_number() OVER (PARTITION BY District_Code ORDER BY week_start) AS i,
          tons_refuse - avg(tons_refuse) OVER (PARTITION BY District_Code) AS d FROM cube) b
    ON a.District_Code = b.District_Code AND b.i = a.i + k
  JOIN (SELECT District_Code, sum(d * d) AS den FROM (SELECT District_Code, tons_refuse - avg(tons_refuse) OVER (PARTITION BY District_Code) AS d FROM cube) GROUP BY 1) s
    ON s.District_Code = a.District_Code
  GROUP BY 1, 2"""))
def w12(spark, sf):
    a = FT.acf(district_cube(spark, sf), G, "week_start", "tons_refuse", 104)
    return a.select(G, F.col("k").cast("bigint").alias("k"), R("acf"))


@query("w15_year_overlay", sql(DCUBE_CTE, select=
    "SELECT District_Code, CAST(year(week_start) AS INTEGER) AS year, CAST(weekofyear(week_start) AS INTEGER) AS week, week_start, tons_refuse FROM cube"))
def w15(spark, sf):
    c = district_cube(spark, sf)
    return c.select(G, F.year("week_start").alias("year"), F.weekofyear("week_start").alias("week"), "week_start", "tons_refuse")


# ----------------------------------------------------------------- T: forecasting tables
@query("t1_temporal_split", sql(DCUBE_CTE, select="""SELECT CASE WHEN week_start <= (SELECT max(week_start) - 364 FROM cube) THEN 'train' ELSE 'test' END AS split,
  count(*) AS n, min(week_start) AS first_week, max(week_start) AS last_week FROM cube GROUP BY 1"""))
def t1(spark, sf):
    cube = pinned(district_cube(spark, sf).select(G, "week_start"), "split-cube")      # read for the cutoff and for both sides
    tr, te = FT.temporal_split(cube)
    s = lambda d, n: d.agg(F.lit(n).alias("split"), F.count(F.lit(1)).alias("n"), F.min("week_start").alias("first_week"),
                           F.max("week_start").alias("last_week"))
    return s(tr, "train").unionByName(s(te, "test"))


def _feat_sql():
    lags = ", ".join(f"lag(tons_refuse, {n}) {_w()} AS lag_{n}" for n in FT.LAGS)
    rolls = ", ".join(f"avg(tons_refuse) {_w(f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING')} AS roll_mean_{n}, "
                      f"stddev_samp(tons_refuse) {_w(f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING')} AS roll_std_{n}" for n in FT.ROLLS)
    cyc = ("sin(6.283185307179586 * month(week_start) / 12) AS month_sin, cos(6.283185307179586 * month(week_start) / 12) AS month_cos, "
           "sin(6.283185307179586 * weekofyear(week_start) / 52) AS week_sin, cos(6.283185307179586 * weekofyear(week_start) / 52) AS week_cos")
    return (f"feat0 AS (SELECT District_Code, week_start, tons_refuse, {lags}, {rolls}, CAST(month(week_start) AS INTEGER) AS month, "
            f"CAST(weekofyear(week_start) AS INTEGER) AS week_of_year, CAST(year(week_start) AS INTEGER) AS year, {cyc} FROM cube), "
            "feat AS (SELECT f.*, c.district_encoded FROM feat0 f JOIN (SELECT District_Code, CAST(dense_rank() OVER (ORDER BY District_Code) - 1 AS INTEGER) "
            "AS district_encoded FROM (SELECT DISTINCT District_Code FROM cube)) c USING (District_Code))")


FEAT_COLS = (["tons_refuse"] + [f"lag_{n}" for n in FT.LAGS] + [c for n in FT.ROLLS for c in (f"roll_mean_{n}", f"roll_std_{n}")]
             + ["month", "week_of_year", "year", "month_sin", "month_cos", "week_sin", "week_cos", "district_encoded"])
FLOAT_FEATS = {c for c in FEAT_COLS if c.startswith("roll_") or c.endswith(("_sin", "_cos"))}


@query("t2_feature_table", sql(DCUBE_CTE, _feat_sql(), select="SELECT District_Code, week_start, " + ", ".join(
    (f"round({c}, 6) + 0.0 AS {c}" if c in FLOAT_FEATS else c) for c in FEAT_COLS) + " FROM feat WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEAT_COLS)))
def t2(spark, sf):
    f = FT.gb_features(district_cube(spark, sf)).dropna("any")
    return f.select(G, "week_start", *[((r6(F.col(c)) + F.lit(0.0)).alias(c) if c in FLOAT_FEATS else F.col(c)) for c in FEAT_COLS])


@query("p13_prefix_columns", sql(DCUBE_CTE, _feat_sql(), select="SELECT " + ", ".join(
    (f"round({c}, 6) + 0.0 AS {c}" if c in FLOAT_FEATS else c) for c in FEAT_COLS if c != "tons_refuse") + " FROM feat"))
def p13(spark, sf):
    f = FT.gb_features(district_cube(spark, sf))
    cols = FT.feature_columns(f)
    return f.select(*[((r6(F.col(c)) + F.lit(0.0)).alias(c) if c in FLOAT_FEATS else F.col(c)) for c in cols])


@query("t8_prediction_table", sql(PRED, select="SELECT District_Code, week_start, y_true, round(y_pred, 6) AS y_pred, model FROM preds"))
def t8(spark, sf):
    return preds(spark, sf).withColumn("y_pred", r6(F.col("y_pred")))


@query("t9_ensemble_scores", sql(PRED, metrics_sql("preds", "model", 4), select=
    "SELECT *, model = (SELECT model FROM met ORDER BY rmse, list_position(['NAIVE52', 'MA4'], model) LIMIT 1) AS is_best FROM met"))
def t9(spark, sf):
    t = comparison_table(preds(spark, sf))
    order = spark.createDataFrame([("NAIVE52", 0), ("MA4", 1)], "model string, model_order int")   # ties: the earlier model
    best = best_model(t, order=order).scalar()
    return t.withColumn("is_best", F.col("model") == best)


@query("t11_forecast_vs_actual", sql(PRED, select="""SELECT District_Code, week_start, model, y_true, round(y_pred, 6) AS y_pred FROM preds
  WHERE District_Code = (SELECT arg_min(District_Code, [-s, 0]) FROM (SELECT District_Code, sum(y_true) AS s FROM preds GROUP BY 1))"""))
def t11(spark, sf):
    p = preds(spark, sf)
    top = PR.argmax_by(p.groupBy(G).agg(F.sum("y_true").alias("s")), G, "s").scalar()
    return p.filter(F.col(G) == top).select(G, "week_start", "model", "y_true", R("y_pred"))


# ----------------------------------------------------------------- U2, F10, F12-F15
@query("u2_multistream_concat", sql(DCUBE_CTE, *[MLONG_SQL.replace("{v}", s).replace("dense", f"dense_{s}").replace("keep", f"keep_{s}")
                                                .replace("flong", f"flong_{s}") for s in STREAM_ORDER], select=
    "SELECT District_Code, CAST(count(*) AS INTEGER) AS n_features, round(sum(z * z), 6) AS sum_sq FROM ("
    + " UNION ALL ".join(f"SELECT District_Code, z FROM flong_{s} WHERE District_Code IN (SELECT District_Code FROM keep_tons_refuse) "
                         "AND District_Code IN (SELECT District_Code FROM keep_tons_paper) AND District_Code IN (SELECT District_Code FROM keep_tons_mgp)"
                         for s in STREAM_ORDER) + ") GROUP BY 1"))
def u2(spark, sf):
    m = multistream_matrix(district_cube(spark, sf), G)
    return m.select(G, F.size("features").alias("n_features"),
                    R("sum_sq", F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)))


@query("f10_method_labels", sql(DCUBE_CTE, assign_sql(), select=
    "SELECT DISTINCT m AS method, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(replace(regexp_replace(m, '^cluster_', ''), '_', ' '), ' ')], ' ') AS label FROM (SELECT unnest(['cluster_fixed', 'cluster_by_borough']) AS m FROM assign)"))
def f10(spark, sf):
    from .q_basic import u3
    w = u3(spark, sf).withColumnRenamed("cluster_borough", "cluster_by_borough")
    cols = [c for c in w.columns if c.startswith("cluster_")]
    long = w.unpivot(G, cols, "method", "cluster")
    return long.select("method", F.initcap(F.replace(F.regexp_replace("method", "^cluster_", ""), F.lit("_"), F.lit(" "))).alias("label")).distinct()


@query("f12_per_capita_rate", sql(CLEAN_CTE, SCUBE_ONLY, __import__("haulcube.sources.geo_fixtures", fromlist=["x"]).sections_sql(), select=
    "SELECT s.Section_Code, round(CASE WHEN s.population > 0 THEN m.avg_tons / s.population * 2000 END, 6) AS per_capita FROM sections s "
    "LEFT JOIN (SELECT Section_Code, avg(tons_total) AS avg_tons FROM scube GROUP BY 1) m USING (Section_Code)"))
def f12(spark, sf):
    sec = section_layer(spark, sf)
    avg = section_cube(spark, sf).groupBy("Section_Code").agg(F.avg("tons_total").alias("avg_tons"))
    j = sec.join(avg, "Section_Code", "left")
    return j.select("Section_Code", R("per_capita", F.when(F.col("population") > 0, F.col("avg_tons") / F.col("population") * 2000)))


@query("f13_intensity_colour", sql(CLEAN_CTE, SCUBE_ONLY, __import__("haulcube.sources.geo_fixtures", fromlist=["x"]).sections_sql(),
    "sa AS (SELECT s.Section_Code, coalesce(m.avg_tons, 0.0) AS v, m.avg_tons AS raw FROM sections s LEFT JOIN (SELECT Section_Code, avg(tons_total) AS avg_tons FROM scube GROUP BY 1) m USING (Section_Code))",
    "q AS (SELECT quantile_cont(raw, 0.95) AS q95 FROM sa)",
    select="SELECT Section_Code, '#ff' || lower(lpad(hex(g), 2, '0')) || lower(lpad(hex(g), 2, '0')) AS colour FROM ("
           "SELECT Section_Code, CAST(trunc(255 * (1 - CASE WHEN q95 > 0 THEN least(v / q95, 1.0) ELSE 0 END)) AS INTEGER) AS g FROM sa, q)"))
def f13(spark, sf):
    sec = section_layer(spark, sf).select("Section_Code")
    avg = section_cube(spark, sf).groupBy("Section_Code").agg(F.avg("tons_total").alias("raw"))
    j = sec.join(avg, "Section_Code", "left")
    q95 = quantiles(j, [], "raw", [0.95]).scalar()
    inten = F.when(q95 > 0, F.least(F.coalesce(F.col("raw"), F.lit(0.0)) / q95, F.lit(1.0))).otherwise(F.lit(0.0))
    g = F.lower(F.lpad(F.hex((255 * (1 - inten)).cast("int")), 2, "0"))
    return j.select("Section_Code", F.concat(F.lit("#ff"), g, g).alias("colour"))


# The 15-colour cluster palette of the original maps, in order.
PALETTE = ["#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00",
           "#ffff33", "#a65628", "#f781bf", "#999999", "#66c2a5",
           "#fc8d62", "#8da0cb", "#e78ac3", "#a6d854", "#ffd92f"]


@query("f14_palette_colour", "SELECT DISTINCT cluster, CASE WHEN cluster < 0 THEN '#cccccc' ELSE (["
       + ", ".join(f"'{c}'" for c in PALETTE) + "])[cluster % 15 + 1] END AS colour FROM "
       "(SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS cluster FROM embeddings)")
def f14(spark, sf):
    from ..sources.tables import table
    e = table(spark, sf, "embeddings").select(F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"))
    pal = F.array(*[F.lit(c) for c in PALETTE])
    return e.select("cluster", F.when(F.col("cluster") < 0, F.lit("#cccccc"))
                    .otherwise(F.element_at(pal, F.col("cluster") % 15 + 1)).alias("colour")).distinct()


@query("f15_label_text", "SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS GEOID, format('{:,}', c_custkey * 100 + 100) AS pop_label, "
       "printf('%.1f', c_acctbal) AS value_label FROM customer")
def f15(spark, sf):
    from ..sources.tables import table
    c = table(spark, sf, "customer")
    return c.select(F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("GEOID"),
                    F.format_number((F.col("c_custkey") * 100 + 100).cast("long"), 0).alias("pop_label"),
                    F.regexp_replace(F.format_number(F.col("c_acctbal"), 1), ",", "").alias("value_label"))

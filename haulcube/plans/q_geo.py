"""Spatial queries (G1-G9, J3, J7, J8, A31) on polygon layers derived from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.geo import contiguity as C
from ..operators.geo.dissolve import dissolve
from ..operators.geo.overlay import allocate_population, overlay
from ..operators.geo.project import sql_to_state_plane, to_lon_lat, to_state_plane
from ..operators.geo.rings import bbox, grid_cells, multi_area, n_vertices, polygon_area
from ..session import pinned
from ..sources.geo_fixtures import TRACTS_SQL, section_layer, sections_sql, tract_layer
from ..sources.tables import table
from .base import CLEAN_CTE, SCUBE_ONLY, section_cube, sql
from .registry import query

SQ = """sq AS (SELECT Section_Code, population, idx, CAST((idx % 10) * 10 AS DOUBLE) AS x0, CAST(floor(idx / 10) * 10 AS DOUBLE) AS y0,
  CAST((idx % 10) * 10 + 10 AS DOUBLE) AS x1, CAST(floor(idx / 10) * 10 + 10 AS DOUBLE) AS y1 FROM sections)"""
OV = "greatest(0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) * greatest(0, least(s.y1, t.y1) - greatest(s.y0, t.y0))"


def lshapes(spark, sf):
    """Non-convex L-shaped polygons, one per customer: a w x 1 foot plus a 1 x (h-1) leg."""
    c = table(spark, sf, "customer")
    j = F.col("c_custkey")
    x0, y0, w, h = (j % 20) * 5 + 1, F.floor(j / 20) * 5 + 2, j % 3 + 3, j % 4 + 3

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(pt(x0, y0), pt(x0 + w, y0), pt(x0 + w, y0 + 1), pt(x0 + 1, y0 + 1), pt(x0 + 1, y0 + h), pt(x0, y0 + h), pt(x0, y0))
    return c.select(F.concat(F.lit("L"), j.cast("string")).alias("GEOID"), (j + 100).cast("double").alias("population"),
                    F.array(F.when(j % 2 == 1, F.reverse(ring)).otherwise(ring)).alias("rings"))


LSHAPES_SQL = """lsh AS (SELECT 'L' || CAST(c_custkey AS VARCHAR) AS GEOID,
  CAST((c_custkey % 20) * 5 + 1 AS DOUBLE) AS x0, CAST(floor(c_custkey / 20) * 5 + 2 AS DOUBLE) AS y0,
  CAST(c_custkey % 3 + 3 AS DOUBLE) AS w, CAST(c_custkey % 4 + 3 AS DOUBLE) AS h FROM customer)"""


@query("g1_polygon_area", sql(TRACTS_SQL, LSHAPES_SQL, select=
    "SELECT GEOID, (x1 - x0) * (y1 - y0) AS area FROM tracts UNION ALL SELECT GEOID, w * 1 + 1 * (h - 1) AS area FROM lsh"))
def g1(spark, sf):
    t = tract_layer(spark, sf).unionByName(lshapes(spark, sf))
    return t.select("GEOID", polygon_area(F.col("rings")).alias("area"))


def _points(spark, sf):
    c = table(spark, sf, "customer")
    j = F.col("c_custkey")
    return c.select(j.alias("id"), (F.lit(-74.3) + (j % 20) * 0.03).alias("lon"),
                    (F.lit(40.5) + (F.floor(j / 20) % 20) * 0.02).alias("lat"))


_x, _y = sql_to_state_plane("lon", "lat")
PTS_SQL = "pts AS (SELECT c_custkey AS id, CAST(-74.3 AS DOUBLE) + (c_custkey % 20) * CAST(0.03 AS DOUBLE) AS lon, CAST(40.5 AS DOUBLE) + (floor(c_custkey / 20) % 20) * CAST(0.02 AS DOUBLE) AS lat FROM customer)"


@query("g2_project_state_plane", sql(PTS_SQL, select=f"SELECT id, round({_x}, 4) AS x_ft, round({_y}, 4) AS y_ft FROM pts"))
def g2(spark, sf):
    p = _points(spark, sf)
    x, y = to_state_plane(F.col("lon"), F.col("lat"))
    return p.select("id", F.round(x, 4).alias("x_ft"), F.round(y, 4).alias("y_ft"))


@query("g2_unproject_roundtrip", sql(PTS_SQL, select="SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM pts"))
def g2b(spark, sf):
    p = _points(spark, sf)
    x, y = to_state_plane(F.col("lon"), F.col("lat"))
    q = p.select("id", x.alias("x"), y.alias("y"))
    lon, lat = to_lon_lat(F.col("x"), F.col("y"))
    return q.select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("g3_bbox_grid_cells", sql(TRACTS_SQL, select=
    "SELECT GEOID, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax, "
    "CAST((floor(x1 / 10) - floor(x0 / 10) + 1) * (floor(y1 / 10) - floor(y0 / 10) + 1) AS INTEGER) AS n_cells FROM tracts"))
def g3(spark, sf):
    t = tract_layer(spark, sf).select("GEOID", bbox(F.col("rings")).alias("b"))
    return t.select("GEOID", "b.xmin", "b.ymin", "b.xmax", "b.ymax", F.size(grid_cells(F.col("b"), 10.0)).alias("n_cells"))


@query("j7_overlay_intersection", sql(sections_sql(), SQ, TRACTS_SQL, select=
    f"SELECT s.Section_Code, t.GEOID, round({OV}, 6) AS overlap_area FROM sq s JOIN tracts t ON {OV} > 1e-12"))
def j7(spark, sf):
    o = overlay(section_layer(spark, sf), tract_layer(spark, sf), "Section_Code", "GEOID")
    return o.select("Section_Code", "GEOID", F.round("overlap_area", 6).alias("overlap_area"))


OVL = ("(greatest(0, least(s.x1, t.x0 + t.w) - greatest(s.x0, t.x0)) * greatest(0, least(s.y1, t.y0 + 1) - greatest(s.y0, t.y0)) + "
       "greatest(0, least(s.x1, t.x0 + 1) - greatest(s.x0, t.x0)) * greatest(0, least(s.y1, t.y0 + t.h) - greatest(s.y0, t.y0 + 1)))")


@query("g4_overlap_area_nonconvex", sql(sections_sql(), SQ, LSHAPES_SQL, select=
    f"SELECT s.Section_Code, t.GEOID, round({OVL}, 6) AS overlap_area FROM sq s JOIN lsh t ON {OVL} > 1e-12"))
def g4(spark, sf):
    o = overlay(section_layer(spark, sf), lshapes(spark, sf), "Section_Code", "GEOID")
    return o.select("Section_Code", "GEOID", F.round("overlap_area", 6).alias("overlap_area"))


@query("g5_overlap_fraction", sql(sections_sql(), SQ, TRACTS_SQL, select=
    f"SELECT s.Section_Code, t.GEOID, round({OV} / ((t.x1 - t.x0) * (t.y1 - t.y0)), 6) AS area_fraction, "
    f"round(t.population * {OV} / ((t.x1 - t.x0) * (t.y1 - t.y0)), 6) AS pop_allocated FROM sq s JOIN tracts t ON {OV} > 1e-12"))
def g5(spark, sf):
    tr = tract_layer(spark, sf)
    o = overlay(section_layer(spark, sf), tr, "Section_Code", "GEOID")
    t = tr.select("GEOID", "population", polygon_area(F.col("rings")).alias("tract_area"))
    j = o.join(t, "GEOID")
    frac = F.col("overlap_area") / F.col("tract_area")
    return j.select("Section_Code", "GEOID", F.round(frac, 6).alias("area_fraction"),
                    F.round(F.col("population") * frac, 6).alias("pop_allocated"))


ALLOC_SQL = (f"alloc AS (SELECT s.Section_Code, CAST(round_even(sum(t.population * {OV} / ((t.x1 - t.x0) * (t.y1 - t.y0))), 0) AS BIGINT) AS population "
             f"FROM sq s JOIN tracts t ON {OV} > 1e-12 GROUP BY 1)")


@query("a31_population_allocation", sql(sections_sql(), SQ, TRACTS_SQL, ALLOC_SQL, select=
    "SELECT s.Section_Code, coalesce(a.population, 0) AS population FROM sections s LEFT JOIN alloc a USING (Section_Code)"))
def a31(spark, sf):
    return allocate_population(section_layer(spark, sf), tract_layer(spark, sf))


@query("j3_left_join_fill", sql(sections_sql(), SQ, TRACTS_SQL, ALLOC_SQL, select=
    "SELECT s.Section_Code, coalesce(a.population, 0) AS population FROM sections s LEFT JOIN alloc a USING (Section_Code)"))
def j3(spark, sf):
    return allocate_population(section_layer(spark, sf), tract_layer(spark, sf))


ADJ_SQL = """adj AS (SELECT a.Section_Code AS i, b.Section_Code AS j FROM sections a JOIN sections b
  ON a.Section_Code <> b.Section_Code AND abs(a.idx % 10 - b.idx % 10) <= 1 AND abs(floor(a.idx / 10) - floor(b.idx / 10)) <= 1),
wts AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM adj)"""


@query("j8_queen_adjacency", sql(sections_sql(), ADJ_SQL, select="SELECT i, j FROM adj"))
def j8(spark, sf):
    return C.queen_edges(section_layer(spark, sf), "Section_Code")


@query("g7_row_standardised_weights", sql(sections_sql(), ADJ_SQL, select="SELECT i, j, round(w, 9) AS w FROM wts"))
def g7(spark, sf):
    w = C.row_standardise(C.queen_edges(section_layer(spark, sf), "Section_Code"))
    return w.select("i", "j", F.round("w", 9).alias("w"))


def _section_values(spark, sf):
    sec = section_layer(spark, sf).select("Section_Code")
    avg = section_cube(spark, sf).groupBy("Section_Code").agg(F.avg("tons_refuse").alias("avg_refuse"))
    return sec.join(avg, "Section_Code").dropna(subset=["avg_refuse"])


VAL_SQL = ("vals AS (SELECT s.Section_Code AS u, m.v - avg(m.v) OVER () AS z FROM sections s "
           "JOIN (SELECT Section_Code, avg(tons_refuse) AS v FROM scube GROUP BY 1) m USING (Section_Code))")


@query("g8_morans_i", sql(CLEAN_CTE, SCUBE_ONLY, sections_sql(), VAL_SQL,
    ADJ_SQL.replace("FROM sections a JOIN sections b", "FROM sections a JOIN sections b").replace(
        "adj AS (SELECT", "adj AS (SELECT").replace("ON a.Section_Code <> b.Section_Code",
        "ON a.Section_Code IN (SELECT u FROM vals) AND b.Section_Code IN (SELECT u FROM vals) AND a.Section_Code <> b.Section_Code"),
    select="""SELECT round((SELECT count(*) FROM vals) / (SELECT sum(w) FROM wts) * sum(w * vi.z * vj.z) / (SELECT sum(z * z) FROM vals), 9) AS I,
  (SELECT count(*) FROM vals) AS n, round((SELECT sum(w) FROM wts), 9) AS s0
FROM wts JOIN vals vi ON vi.u = wts.i JOIN vals vj ON vj.u = wts.j"""))
def g8(spark, sf):
    v = _section_values(spark, sf)
    w = C.row_standardise(C.queen_edges(section_layer(spark, sf).join(v.select("Section_Code"), "Section_Code", "left_semi"), "Section_Code"))
    m = C.morans_i(v, w, "Section_Code", "avg_refuse")
    return m.select(F.round("I", 9).alias("I"), "n", F.round("s0", 9).alias("s0"))


@query("g9_moran_permutation_test")
def g9(spark, sf):
    v = pinned(_section_values(spark, sf), "moran-values")         # the loads are read once, the values are used three times
    w = C.row_standardise(C.queen_edges(section_layer(spark, sf).join(v.select("Section_Code"), "Section_Code", "left_semi"), "Section_Code"))
    return C.moran_permutation_test(v, w, "Section_Code", "avg_refuse", 999)


EDGES_SQL = """edges AS (
  SELECT left(Section_Code, 4) AS district, x0 AS ax, y0 AS ay, x1 AS ex, y0 AS ey FROM sq UNION ALL
  SELECT left(Section_Code, 4), x1, y0, x1, y1 FROM sq UNION ALL
  SELECT left(Section_Code, 4), x0, y1, x1, y1 FROM sq UNION ALL
  SELECT left(Section_Code, 4), x0, y0, x0, y1 FROM sq),
bnd AS (SELECT district, sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))) AS boundary_length FROM
  (SELECT district, ax, ay, ex, ey, count(*) AS c FROM edges GROUP BY ALL) WHERE c % 2 = 1 GROUP BY 1)"""


@query("g6_dissolve", sql(sections_sql(), SQ, EDGES_SQL, select="""SELECT b.district AS District_Code, f.population, f.n_members,
  round(b.boundary_length, 6) AS boundary_length, f.area FROM bnd b JOIN (SELECT left(Section_Code, 4) AS district,
  arg_min(population, Section_Code) AS population, count(*) AS n_members, sum((x1 - x0) * (y1 - y0)) AS area FROM sq GROUP BY 1) f
  ON f.district = b.district"""))
def g6(spark, sf):
    sec = section_layer(spark, sf).withColumn("District_Code", F.left(F.col("Section_Code"), F.lit(4)))
    d = dissolve(sec, "District_Code", attrs=["population"], order="Section_Code")
    stats = sec.groupBy("District_Code").agg(F.count(F.lit(1)).alias("n_members"))
    seg = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0),
                                lambda a, i: a + F.sqrt((r[i + 1]["x"] - r[i]["x"]) ** 2 + (r[i + 1]["y"] - r[i]["y"]) ** 2))
    length = F.aggregate(F.flatten("parts"), F.lit(0.0), lambda a, r: a + seg(r))
    return d.join(stats, "District_Code").select("District_Code", "population", "n_members",
                                                 F.round(length, 6).alias("boundary_length"), multi_area(F.col("parts")).alias("area"))

"""Exact polygon areas / overlaps and the projection round trip."""
import math

from pyspark.sql import functions as F

from haulcube.operators.geo.dissolve import dissolve
from haulcube.operators.geo.overlay import candidate_pairs, measured_cell, overlap_area_py, quadtree_rows
from haulcube.operators.geo.project import to_lon_lat, to_state_plane
from haulcube.operators.geo.rings import bbox, multi_area, polygon_area


def rect(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return [[{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}, {"x": x0, "y": y0}]]


def lshape(x0, y0, w, h):
    pts = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + 1), (x0 + 1, y0 + 1), (x0 + 1, y0 + h), (x0, y0 + h), (x0, y0)]
    return [[{"x": float(a), "y": float(b)} for a, b in pts]]


def test_rectangle_overlap_closed_form():
    for (a, b, want) in [((0, 0, 10, 10), (5, 5, 15, 15), 25.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),
                         ((0, 0, 10, 10), (2, 3, 4, 9), 12.0)]:
        assert math.isclose(overlap_area_py(rect(*a), rect(*b)), want, abs_tol=1e-9)


def test_lshape_overlap_is_sum_of_parts():
    L = lshape(1, 2, 4, 5)
    sq = rect(0, 0, 3, 4)
    # foot [1,5]x[2,3] and leg [1,2]x[3,7] intersected with [0,3]x[0,4]
    want = (3 - 1) * (3 - 2) + (2 - 1) * (4 - 3)
    assert math.isclose(overlap_area_py(L, sq), want, abs_tol=1e-9)
    assert math.isclose(overlap_area_py(sq, L), want, abs_tol=1e-9)


def test_overlap_ignores_winding():
    flip = lambda rings: [r[::-1] for r in rings]
    a, b = rect(0, 0, 10, 10), rect(5, 5, 15, 15)
    holed = [rect(0, 0, 10, 10)[0], rect(2, 2, 4, 4)[0]]
    for x in (a, flip(a)):
        for y in (b, flip(b)):
            assert math.isclose(overlap_area_py(x, y), 25.0, abs_tol=1e-9)
        for h in (holed, [holed[0], holed[1][::-1]], flip(holed)):
            assert math.isclose(overlap_area_py(x, h), 96.0, abs_tol=1e-9) and math.isclose(overlap_area_py(h, x), 96.0, abs_tol=1e-9)
    assert math.isclose(overlap_area_py(flip(lshape(1, 2, 4, 5)), rect(0, 0, 3, 4)), 3.0, abs_tol=1e-9)


def boxes_df(spark, boxes, name):
    return spark.createDataFrame([(i, rect(*b)) for i, b in boxes], f"{name} string, rings array<array<struct<x:double,y:double>>>")


def test_crowded_cells_are_split(spark):
    import random
    rnd = random.Random(5)

    def box(x, y, size):
        w, h = rnd.uniform(0.1, 1) * size, rnd.uniform(0.1, 1) * size
        return x, y, x + w, y + h
    layer = {}
    for side in "lr":
        crowd = [box(rnd.uniform(-1, 1), rnd.uniform(-1, 1), 0.02) for _ in range(300)]     # a third in a corner of one cell
        rest = [box(rnd.uniform(-500, 500), rnd.uniform(-500, 500), 10) for _ in range(596)]
        layer[side] = [(f"{side}{i}", b) for i, b in enumerate(crowd + rest + [(-400, -400, 400, 400)] + [(7, 7, 9, 9)] * 3)]
    left, right = boxes_df(spark, layer["l"], "a"), boxes_df(spark, layer["r"], "b")
    want = sorted((i, j) for i, p in layer["l"] for j, q in layer["r"] if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    for cell, limit in ((None, 1e6), (64.0, 200)):
        assert sorted(map(tuple, candidate_pairs(left, right, "a", "b", cell, limit).collect())) == want
    both = [df.select(F.lit(s).alias("side"), F.struct(F.col(c).alias("l"), F.col(c).alias("r")).alias("id"), bbox(F.col("rings")).alias("box"))
            for df, c, s in ((left, "a", "l"), (right, "b", "r"))]
    boxes = both[0].unionByName(both[1])
    n = quadtree_rows(boxes, measured_cell(boxes), 200).groupBy("lvl", "cx", "cy").agg(
        (F.sum(F.expr("int(side = 'l')")) * F.sum(F.expr("int(side = 'r')"))).alias("pairs"), F.max("a").alias("a"), F.max("b").alias("b"))
    n = n.select((F.col("pairs") / (F.col("a") * F.col("b"))).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert n[0] <= 200 and n[0] <= 0.05 * n[1]


def test_equal_boxes_are_salted(spark):
    same = [(f"s{i}", (0, 0, 5, 5)) for i in range(60)]
    rows = quadtree_rows(boxes_df(spark, same, "a").select(F.expr("if(int(substr(a, 2)) % 2 = 0, 'l', 'r')").alias("side"), F.col("a").alias("id"),
                                                           bbox(F.col("rings")).alias("box")), 16.0, 100)
    assert {(r.a, r.b) for r in rows.collect()} == {(3, 3)} and rows.count() == 60
    left, right = boxes_df(spark, same, "a"), boxes_df(spark, same, "b")
    assert candidate_pairs(left, right, "a", "b", cell_pairs=100).distinct().count() == 3600
    assert candidate_pairs(left, right, "a", "b", cell_pairs=100).count() == 3600
    assert candidate_pairs(left.limit(0), right, "a", "b").count() == 0


def test_dissolve_multi_part_and_holes(spark):
    flip = lambda rings: [r[::-1] for r in rings]
    ring = [rect(x, y, x + 1, y + 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]  # a square with a hole
    corner = [rect(0, 0, 1, 1), flip(rect(1, 1, 2, 2)), rect(5, 5, 6, 6)]  # two touching parts and one apart
    rows = [("ring", str(i), flip(p) if i % 2 else p) for i, p in enumerate(ring)] + [("corner", str(i), p) for i, p in enumerate(corner)]
    df = spark.createDataFrame(rows, "k string, m string, rings array<array<struct<x:double,y:double>>>")
    got = {r.k: r for r in dissolve(df, "k").select("*", multi_area(F.col("parts")).alias("area")).collect()}
    assert got["ring"].area == 8 and [len(p) for p in got["ring"].parts] == [2]
    assert got["corner"].area == 3 and [len(p) for p in got["corner"].parts] == [1, 1, 1]


def test_area_with_hole(spark):
    ring = rect(0, 0, 10, 10)[0]
    hole = rect(2, 2, 4, 4)[0][::-1]
    df = spark.createDataFrame([([ring, hole],)], "rings array<array<struct<x:double,y:double>>>")
    assert math.isclose(df.select(polygon_area(F.col("rings"))).first()[0], 96.0)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-74.0, 40.7), (-73.8, 40.9), (-74.2, 40.5)], "lon double, lat double")
    x, y = to_state_plane(F.col("lon"), F.col("lat"))
    p = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lo, la = to_lon_lat(F.col("x"), F.col("y"))
    for r in p.select("lon", "lat", lo.alias("lo"), la.alias("la")).collect():
        assert abs(r["lo"] - r["lon"]) < 1e-9 and abs(r["la"] - r["lat"]) < 1e-9
    # the projection origin meridian maps to the false easting (300000 m in feet)
    r = p.filter(F.col("lon") == -74.0).first()
    assert math.isclose(r["x"], 300000 * 3937 / 1200, rel_tol=1e-12)

"""Ring-array geometry as Column expressions.

A polygon is ARRAY<ARRAY<STRUCT<x,y>>>: the outer ring first, then holes, each
ring closed (first vertex repeated last).  Everything here is a higher-order
Column expression, so it runs inside whole-stage codegen with no Python.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_signed_area(r: Column) -> Column:
    """Shoelace: positive for counter-clockwise rings."""
    idx = F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)))
    term = lambda acc, i: acc + (r[i]["x"] * r[i + 1]["y"] - r[i + 1]["x"] * r[i]["y"])
    return F.when(F.size(r) >= 4, F.aggregate(idx, F.lit(0.0), term) / 2).otherwise(F.lit(0.0))


def polygon_area(rings: Column) -> Column:
    """G1: |outer| - sum |holes| (independent of ring orientation)."""
    outer = F.abs(ring_signed_area(rings[0]))
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda a, r: a + F.abs(ring_signed_area(r)))
    return outer - holes


def multi_area(parts: Column) -> Column:
    """Area of a multi-part polygon: ARRAY of disjoint ring-array polygons."""
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a + polygon_area(p))


def n_vertices(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda a, r: a + F.size(r))


def bbox(rings: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of the outer ring."""
    xs = F.transform(rings[0], lambda p: p["x"])
    ys = F.transform(rings[0], lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def grid_cells(box: Column, cell: float) -> Column:
    """ARRAY<STRUCT<cx, cy>> of the grid cells a bounding box touches."""
    cx0, cx1 = F.floor(box["xmin"] / cell), F.floor(box["xmax"] / cell)
    cy0, cy1 = F.floor(box["ymin"] / cell), F.floor(box["ymax"] / cell)
    return F.flatten(F.transform(F.sequence(cx0, cx1), lambda cx: F.transform(
        F.sequence(cy0, cy1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

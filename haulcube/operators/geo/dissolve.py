"""Dissolve polygons by a key (union of members, attributes of the first member).

Member rings are wound so that the interior lies on the left (outer rings counter-clockwise, holes
clockwise) and exploded into directed edges.  An edge that two members of a group use in opposite
directions is interior and cancels, the rest is the boundary.  Only the boundary edges of one group are
chained into rings (Arrow-batched, one group per call, bounded by that group's boundary); the rings are
nested into a multi-part polygon: ARRAY of parts, each an outer ring followed by its holes.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rings import ring_signed_area

PARTS_SCHEMA = "array<array<array<struct<x:double,y:double>>>>"


def boundary_edges(polys: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2): directed boundary edges with the interior on their left."""
    r = polys.select(key, F.posexplode("rings").alias("_k", "_r"))
    sa = ring_signed_area(F.col("_r"))
    r = r.select(key, F.when(((F.col("_k") == 0) & (sa < 0)) | ((F.col("_k") > 0) & (sa > 0)), F.reverse("_r")).otherwise(F.col("_r")).alias("ring"))
    n = F.greatest(F.size("ring") - 1, F.lit(0))
    e = r.select(key, F.explode(F.arrays_zip(F.slice("ring", 1, n).alias("a"), F.slice("ring", 2, n).alias("b"))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    forward = (a["x"] < b["x"]) | ((a["x"] == b["x"]) & (a["y"] <= b["y"]))
    lo, hi = F.when(forward, a).otherwise(b), F.when(forward, b).otherwise(a)
    e = e.select(key, lo["x"].alias("x1"), lo["y"].alias("y1"), hi["x"].alias("x2"), hi["y"].alias("y2"),
                 F.when(forward, F.lit(1)).otherwise(F.lit(-1)).alias("_d"))
    net = e.groupBy(key, "x1", "y1", "x2", "y2").agg(F.sum("_d").alias("_d")).where("_d <> 0")
    along = F.col("_d") > 0
    return net.select(key, *[F.when(along, F.col(p)).otherwise(F.col(q)).alias(p)
                             for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def _loops(edges):
    """Closed rings of directed edges; at a shared corner the leftmost turn keeps touching parts apart."""
    out: dict = {}
    for x1, y1, x2, y2 in edges:
        out.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, cur = [start], out[start].pop()
            while cur != start and out.get(cur):
                px, py = ring[-1]
                ring.append(cur)
                back = math.atan2(py - cur[1], px - cur[0])
                # clockwise angle from the edge back to the next edge: the least is the leftmost turn
                nxt = min(out[cur], key=lambda p: (back - math.atan2(p[1] - cur[1], p[0] - cur[0])) % (2 * math.pi) or 2 * math.pi)
                out[cur].remove(nxt)
                cur = nxt
            ring.append(start)
            rings.append(ring)
    return rings


def _signed(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _holds(ring, x, y) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def nest(rings):
    """Outer rings (counter-clockwise) with their holes: the smallest outer ring around a hole owns it."""
    parts = [[r] for r in sorted((r for r in rings if _signed(r) > 0), key=_signed)]
    for hole in (r for r in rings if _signed(r) < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        owner = next((p for p in parts if _holds(p[0], x, y)), parts[-1] if parts else None)
        if owner is not None:
            owner.append(hole)
    return parts


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    key = pdf.columns[0]
    parts = nest(_loops(pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)))
    return pd.DataFrame({key: [pdf[key].iloc[0]], "parts": [[[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts]]})


def dissolve(polys: DataFrame, key: str, attrs=(), order: str | None = None, mode: str = "first") -> DataFrame:
    """Union of member polygons per key; attributes from the first member by `order` (or summed)."""
    edges = boundary_edges(polys, key)
    shapes = edges.groupBy(key).applyInPandas(_chain, f"{key} string, parts {PARTS_SCHEMA}")
    if not attrs:
        return shapes
    order = order or key
    if mode == "sum":
        a = polys.groupBy(key).agg(*[F.sum(c).alias(c) for c in attrs])
    else:
        a = polys.groupBy(key).agg(*[F.min_by(c, F.col(order)).alias(c) for c in attrs])
    return shapes.join(a, key)

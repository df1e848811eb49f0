"""Polygon overlay.

Candidate pairs come from an equi-join on the leaves of a quadtree over the bounding
boxes (a spatial hash join: each polygon is replicated only into the leaves its box
touches; crowded cells are split by measured counts), filtered by the exact box predicate.  The
exact overlap area of each surviving pair is computed in an Arrow-batched
pandas UDF: each ring is fanned into signed triangles and the area is the
signed sum of convex triangle-triangle clips, exact for non-convex polygons
and holes; the outer ring counts positive and holes negative, whatever their winding.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ...session import pinned
from .rings import bbox, grid_cells, polygon_area


def _cross(u, v):
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def _fan(rings):
    """(signs, counter-clockwise triangles) of a polygon: outer ring positive, holes negative, whatever their winding."""
    signs, tris = [np.empty(0)], [np.empty((0, 3, 2))]
    for k, ring in enumerate(rings):
        pts = np.array([[p["x"], p["y"]] for p in ring], dtype=float)
        if len(pts) > 1 and np.allclose(pts[0], pts[-1]):
            pts = pts[:-1]
        if len(pts) < 3:
            continue
        tri = np.stack([np.broadcast_to(pts[0], (len(pts) - 2, 2)), pts[1:-1], pts[2:]], axis=1)
        a = _cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
        tri = np.where((a < 0)[:, None, None], tri[:, ::-1], tri)
        s = np.sign(a) * np.sign(a.sum()) * (1.0 if k == 0 else -1.0)
        signs.append(s[a != 0])
        tris.append(tri[a != 0])
    return np.concatenate(signs), np.concatenate(tris)


def _clip_areas(subject, clip):
    """Areas of the intersections of triangle pairs (n, 3, 2), all half-planes clipped for the whole batch at once."""
    v, n = subject, np.full(len(subject), 3)
    for k in range(3):
        a, edge = clip[:, k, None], (clip[:, (k + 1) % 3] - clip[:, k])[:, None]
        at = np.arange(v.shape[1])
        valid = at < n[:, None]
        nxt = np.where(at + 1 < n[:, None], at + 1, 0)
        d = _cross(edge, v - a)
        dn, q = np.take_along_axis(d, nxt, 1), np.take_along_axis(v, nxt[..., None], 1)
        inside = (d >= 0) & valid
        crosses = ((d >= 0) != (dn >= 0)) & valid
        t = np.divide(d, d - dn, out=np.zeros_like(d), where=crosses)
        slots = np.stack([v, v + t[..., None] * (q - v)], axis=2).reshape(len(v), -1, 2)
        used = np.stack([inside, crosses], axis=2).reshape(len(v), -1)
        order = np.argsort(~used, axis=1, kind="stable")[:, :v.shape[1] + 1]  # a half-plane adds one corner at most
        v, n = np.take_along_axis(slots, order[..., None], 1), used.sum(axis=1)
    at = np.arange(v.shape[1])
    nxt = np.where(at + 1 < n[:, None], at + 1, 0)
    return 0.5 * np.where(at < n[:, None], _cross(v, np.take_along_axis(v, nxt[..., None], 1)), 0.0).sum(axis=1)


def _overlap_areas(left, right, limit: int = 100_000):
    """Overlap area per row of two lists of ring-array polygons."""
    out = np.zeros(len(left))
    held, n = [], 0

    def flush():
        row, sign, s, c = (np.concatenate(x) for x in zip(*held))
        np.add.at(out, row, sign * _clip_areas(s, c))
    for r, (a, b) in enumerate(zip(left, right)):
        (sa, ta), (sb, tb) = _fan(a), _fan(b)
        i, j = np.divmod(np.arange(len(sa) * len(sb)), max(len(sb), 1))
        for k in range(0, len(i), limit):
            x, y = i[k:k + limit], j[k:k + limit]
            held.append((np.full(len(x), r), sa[x] * sb[y], ta[x], tb[y]))
            n += len(x)
            if n >= limit:
                flush()
                held, n = [], 0
    if held:
        flush()
    return out


def overlap_area_py(rings_a, rings_b) -> float:
    return float(_overlap_areas([rings_a], [rings_b])[0])


@pandas_udf(DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact overlap area of two ring-array polygons; triangle pairs of many rows are clipped together."""
    return pd.Series(_overlap_areas(a, b), dtype="float64")


#: Box pairs of one cell above which it is split (or salted, where splitting doesn't part its boxes).
CELL_PAIRS = 1_000_000
MAX_DEPTH = 20
KEY = ["lvl", "cx", "cy"]


def measured_cell(boxes: DataFrame) -> float:
    """Size of a root cell: a power of two of at least twice the mean box extent and 1/64 of the greatest one."""
    b = F.col("box")
    extent = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    mean, most = boxes.agg(F.avg(extent), F.max(extent)).first()
    size = max(2 * (mean or 0.0), (most or 0.0) / 64)
    return 2.0 ** math.ceil(math.log2(size)) if size > 0 else 1.0


def _touched_children(cell: float):
    """For each of the four children of a row's cell: whether the row's box touches it."""
    half = F.lit(cell) / F.pow(F.lit(2.0), F.col("lvl") + 1)
    b = F.col("box")
    lo = [F.floor(b[c] / half) for c in ("xmin", "ymin")]
    hi = [F.floor(b[c] / half) for c in ("xmax", "ymax")]
    return [(dx, dy, (lo[0] <= 2 * F.col("cx") + dx) & (hi[0] >= 2 * F.col("cx") + dx) &
             (lo[1] <= 2 * F.col("cy") + dy) & (hi[1] >= 2 * F.col("cy") + dy)) for dx in (0, 1) for dy in (0, 1)]


def _counted(rows: DataFrame, cell: float) -> DataFrame:
    """Boxes of each side per cell, the pairs it holds and the pairs that its children would hold (one aggregate)."""
    n = {s: F.sum((F.col("side") == s).cast("long")) for s in "lr"}
    parts = [F.sum(((F.col("side") == s) & t).cast("long")).alias(f"{s}{i}")
             for i, (_, _, t) in enumerate(_touched_children(cell)) for s in "lr"]
    c = rows.groupBy(*KEY).agg(n["l"].alias("nl"), n["r"].alias("nr"), *parts)
    below = sum((F.col(f"l{i}").cast("double") * F.col(f"r{i}") for i in range(4)), F.lit(0.0))
    return c.select(*KEY, "nl", "nr", (F.col("nl").cast("double") * F.col("nr")).alias("pairs"), below.alias("below"))


def quadtree_rows(boxes: DataFrame, cell: float, cell_pairs: float = CELL_PAIRS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows (side, id, box) in the leaves of a quadtree that their boxes touch: + lvl, cx, cy, a, b.

    A cell with more than `cell_pairs` pairs of boxes is split while its children hold at most three quarters of
    them; a cell that splitting doesn't help (equal boxes) keeps a x b salted blocks, else a = b = 1.  Each
    round reads the rows of split cells only, and counts are aggregated before they are shuffled.
    """
    rows = boxes.select("*", F.explode(grid_cells(F.col("box"), cell)).alias("c")).select(
        "side", "id", "box", F.lit(0).alias("lvl"), F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))
    side = math.sqrt(cell_pairs)
    plain = [F.lit(1).cast("long").alias(x) for x in "ab"]
    done = []
    for depth in range(max_depth + 1):
        full = _counted(rows, cell).where(F.col("pairs") > cell_pairs)
        if not depth and full.isEmpty():                  # nothing crowded: no table is written
            done.append(rows.select("*", *plain))
            break
        splits = (F.col("below") <= 0.75 * F.col("pairs")) & F.lit(depth < max_depth)
        full = pinned(full.withColumn("split", splits).withColumn("a", F.ceil(F.col("nl") / side)).withColumn("b", F.ceil(F.col("nr") / side)),
                      "overlay-cells")
        n_full, n_split = full.agg(F.count(F.lit(1)), F.sum(F.col("split").cast("long"))).first()
        if not n_full:
            done.append(rows.select("*", *plain))
            break
        if depth == 0:
            rows = pinned(rows, "overlay-rows")
        marked = full.select(*KEY, "split", "a", "b")
        marked = F.broadcast(marked) if n_full <= 1_000_000 else marked
        joined = rows.join(marked, KEY, "left")
        keep = joined.where("split is null or not split")
        done.append(keep.select("side", "id", "box", *KEY, *[F.coalesce(F.col(x), F.lit(1)).cast("long").alias(x) for x in "ab"]))
        if not n_split:
            break
        children = F.filter(F.array(*[F.when(t, F.struct((F.col("lvl") + 1).alias("lvl"), (2 * F.col("cx") + dx).alias("cx"),
                                                         (2 * F.col("cy") + dy).alias("cy"))) for dx, dy, t in _touched_children(cell)]),
                            lambda c: c.isNotNull())
        rows = pinned(joined.where("split").select("side", "id", "box", F.explode(children).alias("c"))
                       .select("side", "id", "box", "c.*"), "overlay-rows")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def candidate_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, cell: float | None = None,
                    cell_pairs: float = CELL_PAIRS) -> DataFrame:
    """J7 step 1: bbox-intersecting pairs via an equi-join on the leaves of a measured quadtree.

    Ids are compared as they are; both sides' ids may be of different types.  `cell` is the size of the root
    cells (None: measured from the boxes).
    """
    def boxed(df, idc, side):
        return df.select(F.lit(side).alias("side"), F.struct(F.col(idc).alias("v")).alias("i"), bbox(F.col("rings")).alias("box"))
    kinds = {s: df.schema[c].dataType for s, df, c in (("l", left, lid), ("r", right, rid))}

    def both(df, idc, side):                       # one column for each side's id: the types may differ
        b = boxed(df, idc, side)
        ids = [(F.col("i.v") if s == side else F.lit(None).cast(kinds[s])).alias(s) for s in "lr"]
        return b.select("side", F.struct(*ids).alias("id"), "box").where("box.xmin is not null")
    boxes = both(left, lid, "l").unionByName(both(right, rid, "r"))
    cell = cell or measured_cell(boxes)
    rows = quadtree_rows(boxes, cell, cell_pairs)

    def keyed(side, own, other):
        mine = F.pmod(F.xxhash64(f"id.{side}"), F.col(own))
        return rows.where(F.col("side") == side).select(
            F.col(f"id.{side}").alias(f"{side}_id"), F.col("box").alias(f"{side}_box"), *KEY, mine.alias(f"s{own}"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"s{other}"))
    j = keyed("l", "a", "b").join(keyed("r", "b", "a"), [*KEY, "sa", "sb"])
    # reference-cell rule: report a pair only in the leaf holding the lower-left
    # corner of the two boxes' overlap, so no de-duplication shuffle is needed
    size = F.lit(cell) / F.pow(F.lit(2.0), F.col("lvl"))
    ref_x = F.floor(F.greatest(F.col("l_box.xmin"), F.col("r_box.xmin")) / size)
    ref_y = F.floor(F.greatest(F.col("l_box.ymin"), F.col("r_box.ymin")) / size)
    j = j.filter((F.col("cx") == ref_x) & (F.col("cy") == ref_y))
    hit = ((F.col("l_box.xmin") <= F.col("r_box.xmax")) & (F.col("r_box.xmin") <= F.col("l_box.xmax")) &
           (F.col("l_box.ymin") <= F.col("r_box.ymax")) & (F.col("r_box.ymin") <= F.col("l_box.ymax")))
    return j.filter(hit).select(F.col("l_id").alias(lid), F.col("r_id").alias(rid))


def overlay(left: DataFrame, right: DataFrame, lid: str, rid: str, cell: float | None = None) -> DataFrame:
    """(lid, rid, overlap_area) for pairs with a positive-area intersection."""
    pairs = candidate_pairs(left, right, lid, rid, cell)
    lg = left.select(F.col(lid), F.col("rings").alias("_la"))
    rg = right.select(F.col(rid), F.col("rings").alias("_ra"))
    j = pairs.join(lg, lid).join(rg, rid)
    out = j.select(lid, rid, overlap_area(F.col("_la"), F.col("_ra")).alias("overlap_area"))
    return out.filter(F.col("overlap_area") > 1e-12)


def allocate_population(sections: DataFrame, tracts: DataFrame, sid: str = "Section_Code",
                        tid: str = "GEOID", cell: float | None = None) -> DataFrame:
    """Area-weighted tract population per section, half-even rounded, 0 when none."""
    ov = overlay(sections, tracts, sid, tid, cell)
    t = tracts.select(tid, F.col("population").alias("_pop"), polygon_area(F.col("rings")).alias("tract_area"))
    alloc = ov.join(t, tid).select(sid, (F.col("_pop") * F.col("overlap_area") / F.col("tract_area")).alias("_p"))
    per = alloc.groupBy(sid).agg(F.bround(F.sum("_p"), 0).cast("long").alias("population"))
    return sections.select(sid).join(per, sid, "left").select(
        sid, F.coalesce(F.col("population"), F.lit(0).cast("long")).alias("population"))

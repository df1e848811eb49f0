"""Connected components by hooking and pointer jumping.

Every round each root hooks to the least root next to it, the trees are flattened by pointer jumping (the depth halves
with every jump) and the edges are drawn between the roots that are left.  A component's roots at least halve in a
round, so the rounds are logarithmic in its size, however long its paths are.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned


def flatten(parents: DataFrame) -> DataFrame:
    """(node, parent) of trees whose roots are their own parents -> (node, parent) with the root as parent."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = pinned(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "tree-jump")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").limit(1).count() == 0:
            return parents


def components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, component: its least node) for `nodes` (node) and undirected `edges` (i, j); and the number of rounds."""
    roots = pinned(nodes.select("node").distinct().select("node", F.col("node").alias("parent")), "components")
    links = edges.where("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    links, rounds = pinned(links, "component-links"), 0
    while links.limit(1).count():
        rounds += 1
        both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j")))
        hooks = both.groupBy(F.col("i").alias("node")).agg(F.min("j").alias("least")).select("node", F.least("node", "least").alias("parent"))
        tops = flatten(pinned(hooks, "component-hooks"))
        # nodes point to roots of the last round, which now point to their own roots
        moved = tops.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        roots = pinned(roots.join(moved, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "components")
        a, b = tops.select(F.col("node").alias("i"), F.col("parent").alias("a")), tops.select(F.col("node").alias("j"), F.col("parent").alias("b"))
        left = links.join(a, "i").join(b, "j").where("a != b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
        links = pinned(left, "component-links")
    return roots.select("node", F.col("parent").alias("component")), rounds

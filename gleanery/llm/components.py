"""Connected components over an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node reachable.

    Every node hooks to the smallest node within two steps, chains are halved until they
    are flat, and the edges between what has joined are contracted; that
    repeats until no edge is left. Each pass halves the nodes at least. Groups
    are reduced before the shuffle, so a node with very many edges costs one
    row for each task. No edges give no rows; loops and repeated edges add
    nothing but their nodes.
    """
    left = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # the smallest within two steps, so that a star is done in one pass wherever its smallest node is
        hooked = both.join(nearest.select(F.col("u").alias("v"), "m"), "v").groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "m")).alias("root"))
        hooked = flattened(staged(hooked, "hooked"))
        if roots is None:
            roots = hooked
        else:
            then = hooked.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            roots = staged(roots.join(then, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots")
        of = lambda x: hooked.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))  # noqa: E731, B023
        joined = left.join(of("u"), "u").join(of("v"), "v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
        left = staged(joined.filter("u <> v").distinct(), "edges")
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def flattened(parents: DataFrame) -> DataFrame:
    """Points every node of (node, root) at the end of its chain."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = staged(parents.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), "hooked")
        parents = jumped.select("node", "root")
        if jumped.filter("_moved").isEmpty():
            return parents

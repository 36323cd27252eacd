"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v of any ordered type.  Returns node, root: root is the smallest node of the
    component.  Nodes without an edge to another node are not listed; null ends are ignored.

    Each round every node points to its smallest neighbour (itself included), the pointers are
    followed to their ends by doubling, and the edges are drawn between the ends.  A round at
    least halves the nodes that still have edges, so there are at most log2(n) rounds.  A node
    with very many edges only adds to a partial minimum; every table is written, none collected.
    """
    left = written(_clean(edges), "edges")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        point = written(point, "hook")
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jump = written(point.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jump")
            moved = not jump.filter("moved").isEmpty()
            point = jump.select("node", "root")
            if not moved:
                break
        if found is None:
            found = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = found.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            found = written(found, "labels")
        end = point.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        left = left.join(end, "u").select("ru", "v").join(end.select(F.col("u").alias("v"), F.col("ru").alias("rv")), "v")
        left = written(_clean(left.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "edges")
    if found is None:
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return found


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("ok")).filter("ok").select("u", "v").distinct()

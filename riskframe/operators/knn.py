"""Exact k-nearest neighbours inside one table (used by SMOTE, M3).

Same plan as the nearest-station join, in feature space: rows are put in
square cells over two chosen coordinates; each row compares itself only with
the rows of the 3x3 block around its cell (an equi-join on the cell id).
The Euclidean distance over *all* features is at least the distance over the
two grid coordinates, so a row's k-th best distance is final once it is below
the distance from the row to the block's border.  Rows not yet certified (or
with fewer than k candidates) retry with cells ``growth`` times larger; the
last level's block covers every row, so the result is exact.  Ties are
broken by the neighbour key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knn_self(df: DataFrame, key: str, features: Sequence[str], k: int, grid: Sequence[str] | None = None,
             cell: float | None = None, growth: int = 4, materialize: bool = True) -> DataFrame:
    """Rows (key, nn_rank 1..k, nn_key, nn_dist) for every row of ``df``.

    ``cell`` (the first level's cell side) defaults to a size that puts
    about 4k rows in an occupied cell if the rows were spread evenly over
    their bounding box, so the first level's work grows linearly with the
    row count."""
    from ..sources.files import materialize as write_table

    feats = list(features)
    grid = list(grid or feats[:2])
    pts = df.select(F.col(key).alias("_id"), *[F.col(c).cast("double").alias(c) for c in feats]).where(
        " AND ".join(f"`{c}` IS NOT NULL" for c in feats))
    lo = pts.agg(*[F.min(c).alias(c) for c in grid], *[F.max(c).alias(f"_max_{c}") for c in grid],
                 F.count(F.lit(1)).alias("_n")).first()
    span = max([lo[f"_max_{c}"] - lo[c] for c in grid] + [0.0])
    if cell is None:
        per_axis = max(1.0, (lo["_n"] / (4.0 * max(k, 1))) ** (1.0 / len(grid)))
        cell = span / per_axis if span > 0 else 1.0
    sizes = [cell]
    while sizes[-1] <= span:
        sizes.append(sizes[-1] * growth)

    pending = pts.select("_id")
    resolved: list[DataFrame] = []
    offs = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for level, g in enumerate(sizes):
        last = level == len(sizes) - 1
        cells = pts.select(F.col("_id").alias("_nid"), *[F.col(c).alias(f"_n_{c}") for c in feats],
                           *[F.floor(F.col(c) / g).alias(f"_c{j}") for j, c in enumerate(grid)])
        probe = pending.join(pts, "_id").withColumns(
            {f"_p{j}": F.floor(F.col(c) / g) for j, c in enumerate(grid)})
        for j in range(len(grid)):
            probe = probe.withColumn(f"_o{j}", F.explode(offs)).withColumn(f"_c{j}", F.col(f"_p{j}") + F.col(f"_o{j}"))
        pairs = probe.join(cells, [f"_c{j}" for j in range(len(grid))]).where(F.col("_nid") != F.col("_id"))
        dist = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_n_{c}"), 2) for c in feats), F.lit(0.0)))
        # distance from the row to the border of its 3x3 block, over the grid coordinates
        border = F.least(*[F.least(F.col(c) - (F.col(f"_p{j}") - 1) * g, (F.col(f"_p{j}") + 2) * g - F.col(c))
                           for j, c in enumerate(grid)])
        pairs = pairs.select("_id", "_nid", dist.alias("_d"), border.alias("_b"))
        w = Window.partitionBy("_id").orderBy("_d", "_nid")
        top = (pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
               .withColumn("_kth", F.max("_d").over(Window.partitionBy("_id")))
               .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy("_id"))))
        if materialize:
            top = write_table(top, f"knn-level{level}")
        if last:
            resolved.append(top)
            break
        ok = (F.col("_cnt") >= k) & (F.col("_kth") < F.col("_b") * F.lit(1 - 1e-9))
        resolved.append(top.where(ok))
        pending = pending.join(top.where(ok).select("_id").distinct(), "_id", "left_anti")
        if materialize:
            pending = write_table(pending, f"knn-pending{level}")
            if pending.isEmpty():
                break

    out = resolved[0]
    for r in resolved[1:]:
        out = out.unionByName(r)
    return out.select(F.col("_id").alias(key), F.col("_r").cast("long").alias("nn_rank"),
                      F.col("_nid").alias("nn_key"), F.col("_d").alias("nn_dist"))

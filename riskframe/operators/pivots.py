"""Exact k-nearest neighbours in many dimensions by pivot partitions (M3).

Rows with one feature vector are one point; of each only its k + 1 smallest
keys can be anybody's neighbours, so a crowd of equal rows is no work.

1. **Partition.**  The points of a cell choose ``fanout`` pivots among
   themselves (by hash) and each goes to its nearest pivot, over all features.
   Cells of more than ``crowd`` points are split again with pivots of their
   own, so density decides how deep the tree gets.  A cell keeps its pivot, its
   radius around it and the extent of each feature.
2. **First bound.**  Each point ranks the points of its own leaf; its
   (k + 1)-th best distance bounds the rest of the search.
3. **Search.**  From the root, a point goes down only into cells that can hold
   something as near: by the triangle inequality nothing in a cell is nearer
   than the distance to the pivot less the radius, nor than the cell's extent.
   Every step is an equi-join on the cell; pairs beyond the bound are dropped
   before anything is sorted.

Nothing is collected but one count a level.  Ties are broken by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-9  # relative rounding allowance of the bounds
PAIRS_A_TASK = 4_000_000


def _distance(left: Sequence[str], right: Sequence[str]) -> Column:
    return F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(left, right)), F.lit(0.0)))


def _names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _points(rows: DataFrame, xs: list[str], most: int) -> DataFrame:
    """One row per feature vector: pid (its smallest key), the features, its ``most`` smallest keys."""
    w = Window.partitionBy(*xs).orderBy("key")
    first = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)  # limited before the shuffle
    return first.groupBy(*xs).agg(F.min("key").alias("pid"), F.sort_array(F.collect_list("key")).alias("keys"))


def pivot_tree(points: DataFrame, d: int, crowd: int, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves of the points (pid, features, keys, leaf) and the cells of each level.

    A cell: parent, cell, leaf (true if it isn't split), pivot q*, radius, feature extents l*, h*.
    Points are distinct, so a split cell has two children at least and the splitting ends.
    """
    from ..sources.files import materialize

    xs, qs = _names("x", d), _names("q", d)
    inner = materialize(points.withColumn("cell", F.lit("")), "pivot-points")
    leaves: DataFrame | None = None
    levels: list[DataFrame] = []
    size = inner.count()
    sizes = inner.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    if size <= crowd:
        return inner.withColumnRenamed("cell", "leaf"), []
    while True:
        level = len(levels)
        # about four times the pivots that are wanted, a bounded number a cell; the first ones by hash
        draw = F.pmod(F.xxhash64(F.lit(level), "pid"), F.lit(1 << 30))
        drawn = inner.join(sizes, "cell").where(draw * F.col("n") < F.lit(float(4 * fanout) * (1 << 30)))
        ranked = drawn.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy(draw, "pid"))).where(F.col("i") <= fanout)
        pivots = ranked.groupBy("cell").agg(F.collect_list(F.struct("i", *[F.col(x).alias(q) for x, q in zip(xs, qs)])).alias("pivots"))  # fanout at most
        to = F.transform("pivots", lambda p: F.struct(F.sqrt(sum(((F.col(x) - p[q]) * (F.col(x) - p[q]) for x, q in zip(xs, qs)), F.lit(0.0))).alias("dist"), p["i"].alias("i"), *[p[q].alias(q) for q in qs]))
        went = inner.join(pivots, "cell").withColumn("near", F.array_min(to))
        went = materialize(went.select("pid", *xs, "keys", F.col("cell").alias("parent"), F.concat_ws(".", "cell", F.col("near.i").cast("string")).alias("cell"),
                                       F.col("near.dist").alias("dist"), *[F.col(f"near.{q}").alias(q) for q in qs]), "pivot-level")
        cells = went.groupBy("parent", "cell", *qs).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"),
                                                        *[F.min(x).alias(f"l{i}") for i, x in enumerate(xs)], *[F.max(x).alias(f"h{i}") for i, x in enumerate(xs)])
        cells = materialize(cells.withColumn("leaf", F.col("n") <= crowd), "pivot-cells")
        levels.append(cells)
        went = went.select("pid", *xs, "keys", "cell").join(cells.select("cell", "leaf", "n"), "cell")
        done = went.where("leaf").select("pid", *xs, "keys", F.col("cell").alias("leaf"))
        leaves = done if leaves is None else leaves.unionByName(done)
        sizes = cells.where("not leaf").select("cell", "n")
        if sizes.isEmpty():
            return leaves, levels
        inner = went.where("not leaf").drop("leaf", "n")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best (dist, key) of each point, as an array in order."""
    w = Window.partitionBy("pid").orderBy("dist", "key")
    top = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("dist", "key"))).alias("best"))


def search_plan(leaves: DataFrame, levels: list[DataFrame], bounds: DataFrame, d: int) -> DataFrame:
    """(pid, features, tau, leaf, own) of the leaves, own ones left out, that a point has to look into."""
    from ..sources.files import materialize

    xs, ls, hs, qs = (_names(c, d) for c in "xlhq")
    front = leaves.select("pid", *xs, F.col("leaf").alias("own")).join(bounds, "pid").withColumn("at", F.lit(""))
    hits: DataFrame | None = None
    for cells in levels:
        step = front.join(cells.drop("n").withColumnRenamed("parent", "at"), "at")
        gap = [F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0.0)) for x, lo, hi in zip(xs, ls, hs)]
        extent = F.sqrt(sum((g * g for g in gap), F.lit(0.0)))
        reach = F.col("tau") * (1 + SLACK) + SLACK * F.col("radius")
        step = step.where((extent <= reach) & (_distance(xs, qs) - F.col("radius") <= reach)).select("pid", *xs, "tau", "own", "cell", "leaf")
        step = materialize(step, "pivot-search")
        found = step.where(F.col("leaf") & (F.col("cell") != F.col("own"))).select("pid", *xs, "tau", F.col("cell").alias("leaf"))
        hits = found if hits is None else hits.unionByName(found)
        front = step.where(~F.col("leaf")).select("pid", *xs, "own", "tau", F.col("cell").alias("at"))
    return hits


def knn_pivots(df: DataFrame, key: str, features: Sequence[str], k: int, crowd: int = 160, fanout: int = 16) -> DataFrame:
    """Rows (key, nn_rank 1..k, nn_key, nn_dist): the k nearest other rows of every row by the
    Euclidean distance over all ``features``, ties by key.  Rows with a null feature take no part;
    where fewer than k other rows exist, these are returned; repeated keys are an error of the caller."""
    return knn_with_work(df, key, features, k, crowd, fanout)[0]


def knn_with_work(df: DataFrame, key: str, features: Sequence[str], k: int, crowd: int = 160, fanout: int = 16) -> tuple[DataFrame, DataFrame]:
    """:func:`knn_pivots` and a one-row frame with n (points) and pairs (distances taken between points)."""
    from ..sources.files import materialize

    d = len(features)
    xs = _names("x", d)
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)]).dropna()
    leaves, levels = pivot_tree(_points(rows, xs, k + 1), d, max(crowd, 2), max(fanout, 2))
    leaves = materialize(leaves, "pivot-leaves")
    others = leaves.select("leaf", "keys", *[F.col(x).alias(f"o{i}") for i, x in enumerate(xs)])
    dist = _distance(xs, _names("o", d)).alias("dist")

    home = leaves.select("pid", *xs, "leaf").join(others, "leaf").select("pid", dist, F.explode("keys").alias("key"))
    best = materialize(_ranked(home, k + 1), "pivot-home")
    bounds = best.select("pid", F.when(F.size("best") > k, F.element_at("best", -1)["dist"]).otherwise(F.lit(float("inf"))).alias("tau"))
    work = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    pairs = work.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("pairs"))
    if levels:
        hits = search_plan(leaves, levels, bounds, d)
        # a pair costs next to nothing to send and much to take: the work, not the bytes, is dealt out
        more = hits.join(work, "leaf").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("more"))
        tasks = 1 + more.first()["more"] // PAIRS_A_TASK
        away = hits.repartition(tasks, "leaf").join(others, "leaf").select("pid", "tau", dist, "keys").where(F.col("dist") <= F.col("tau")).select("pid", "dist", F.explode("keys").alias("key"))
        again = best.select("pid", F.explode("best").alias("b")).select("pid", "b.dist", "b.key").unionByName(away)
        best = _ranked(again, k + 1)
        pairs = pairs.crossJoin(more).select("n", (F.col("pairs") + F.col("more")).alias("pairs"))  # one row by one row
    named = rows.join(leaves.select("pid", *xs), xs).select("key", "pid").join(best, "pid")
    ranks = named.select("key", F.posexplode(F.slice(F.filter("best", lambda b: b["key"] != F.col("key")), 1, k)).alias("r", "b"))
    out = ranks.select(F.col("key").alias(key), (F.col("r") + 1).cast("long").alias("nn_rank"), F.col("b.key").alias("nn_key"), F.col("b.dist").alias("nn_dist"))
    return out, pairs

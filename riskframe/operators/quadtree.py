"""Nearest station through a quadtree that is as deep as the stations are dense.

Stations lie in cells of halved latitudes and longitudes, two halvings a
level.  A cell of more than ``crowd`` stations is split, one of fewer is a
leaf, so 90 % of all stations in one spot make a deeper tree and not a fuller
cell.  A cell keeps the extent of its own stations as points of the unit
sphere, and one of them.

All points go down the tree together.  Of the cells that a point stands before,
the nearest of the kept stations bounds what is worth a look; cells whose
extent is farther off are left behind.  A straight line is shorter than the
arc, so extents need no care at the poles or at the 180th meridian.  At the
leaves the great-circle distance decides, ties by the station key: exact.

Each level is one equi-join on the cell and one grouped minimum; no pair of a
point and a station is made before the leaves.  A small table of points makes
many rows on the way down, so the points are dealt into parts of a fixed size
first: the rows of one task follow from that size, not from the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

HALVINGS = 30  # of the finest cells: some centimetres
STEP = 2  # halvings a level
SLACK = 1e-9  # of the unit sphere's radius: 6 mm, far above the rounding of coordinates
PART_ROWS = 4096  # points, or stations, of one task
SENT_CELLS = 200_000  # cells, of some 100 bytes, that are broadcast at most
_XYZ = ("x", "y", "z")


def _on_sphere(lat: str, lon: str) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}


def _fine_cell(lat: str, lon: str) -> dict[str, Column]:
    """Row and column of the finest cells; longitudes beyond 180 degrees are turned back."""
    side = 1 << HALVINGS
    turned = F.pmod(F.col(lon) + 180.0, F.lit(360.0))
    return {"iy": F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.col(lat) + 90.0) / 180.0 * side))).cast("long"),
            "ix": F.least(F.lit(side - 1), F.floor(turned / 360.0 * side)).cast("long")}


def _cell(level: Column | int) -> Column:
    """The cell's number within its level."""
    drop = F.lit(HALVINGS) - F.lit(STEP) * level if isinstance(level, Column) else F.lit(HALVINGS - STEP * level)
    shift = lambda c: F.call_function("shiftright", F.col(c), drop.cast("int"))
    return shift("iy") * F.lit(1 << HALVINGS) + shift("ix")


def _parts(df: DataFrame, rows: int) -> int:
    """How many parts of about ``rows`` rows ``df`` makes; partitions of a given number are not coalesced."""
    return max(1, -(-df.count() // rows))


def station_tree(stations: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """stations: key, lat, lon, more columns.  Returns the stations with (level, cell) of their leaf,
    and the cells: level, cell, up (the cell's parent), leaf, extent l*, h*, a station x, y, z.

    Of stations at the same coordinates the one with the smallest key is kept: no other is ever
    nearest.  What is left can be told apart, so the splitting ends, or at the finest cells."""
    from ..sources.files import materialize

    rest = [c for c in stations.columns if c not in ("lat", "lon")]
    spots = stations.groupBy("lat", "lon").agg(F.min(F.struct("key", *[c for c in rest if c != "key"])).alias("s"))
    spots = spots.select("lat", "lon", "s.*").withColumns(_fine_cell("lat", "lon") | _on_sphere("lat", "lon"))
    spots = materialize(spots, "spots")
    levels = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS // STEP))).alias("level")
    every = spots.repartition(_parts(spots, PART_ROWS), "iy", "ix").select("*", levels).withColumn("cell", _cell(F.col("level")))
    up = F.when(F.col("level") > 0, _cell(F.col("level") - 1)).otherwise(F.lit(-1).cast("long"))
    sizes = every.withColumn("up", up).groupBy("level", "cell", "up").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"l{c}") for c in _XYZ], *[F.max(c).alias(f"h{c}") for c in _XYZ], F.min(F.struct("key", *_XYZ)).alias("one"))
    sizes = materialize(sizes, "quad-sizes")
    full = sizes.where(F.col("n") > crowd).select((F.col("level") + 1).alias("level"), F.col("cell").alias("up"))
    leaf = (F.col("n") <= crowd) | (F.col("level") == HALVINGS // STEP)
    cells = sizes.where("level = 0").unionByName(sizes.join(full, ["level", "up"], "left_semi").select(sizes.columns))
    cells = materialize(cells.withColumn("leaf", leaf).select("level", "cell", "up", "leaf", "n", *[f"l{c}" for c in _XYZ], *[f"h{c}" for c in _XYZ], *[F.col(f"one.{c}").alias(f"o{c}") for c in _XYZ]), "quad-cells")
    placed = every.join(cells.where("leaf").select("level", "cell"), ["level", "cell"]).select("level", "cell", "lat", "lon", *rest)
    return placed, cells


def leaves_in_reach(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points: pid, lat, lon.  (pid, lat, lon, level, cell) of the leaves that can hold a point's nearest station."""
    from ..sources.files import materialize

    top, n_cells = cells.agg(F.max("level").alias("m"), F.count(F.lit(1)).alias("n")).first()
    parts = _parts(points, PART_ROWS)
    keep = ["pid", "lat", "lon", *_XYZ]
    kept = ["level", "cell", *[f"l{c}" for c in _XYZ], *[f"h{c}" for c in _XYZ], *[f"o{c}" for c in _XYZ]]
    front = points.repartition(parts, "pid").withColumns(_on_sphere("lat", "lon") | {"level": F.lit(-1), "cell": F.lit(-1).cast("long")})
    for level in range(0, -1 if top is None else top + 1):
        # a leaf follows itself: it stays in the race, for its distance bounds the others
        inner = cells.where(F.col("level") == level).select(F.lit(level - 1).alias("of"), F.col("up").alias("under"), *kept)
        ends = cells.where((F.col("level") < level) & F.col("leaf")).select(F.col("level").alias("of"), F.col("cell").alias("under"), *kept)
        below = inner.unionByName(ends) if level else inner
        few = n_cells <= SENT_CELLS  # so that the points stay in their parts
        step = front.select(*keep, F.col("level").alias("of"), F.col("cell").alias("under")).join(F.broadcast(below) if few else below, ["of", "under"])
        step = (step if few else step.repartition(parts, "pid")).select(*keep, *kept)
        gap = [F.greatest(F.col(f"l{c}") - F.col(c), F.col(c) - F.col(f"h{c}"), F.lit(0.0)) for c in _XYZ]
        away = [F.col(c) - F.col(f"o{c}") for c in _XYZ]
        step = step.select(*keep, "level", "cell", F.sqrt(sum((g * g for g in gap), F.lit(0.0))).alias("near"), F.sqrt(sum((a * a for a in away), F.lit(0.0))).alias("sure"))
        reach = F.min("sure").over(Window.partitionBy("pid"))
        front = step.withColumn("reach", reach).where(F.col("near") <= F.col("reach") + SLACK).select(*keep, "level", "cell")
        if level and level % 4 == 0 and level < top:  # so that the plan stays short in a deep tree
            front = materialize(front, "quad-front").repartition(parts, "pid")
    return front.select("pid", "lat", "lon", "level", "cell") if top is not None else points.select("pid", "lat", "lon", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell")).limit(0)


def nearest_by_tree(points: DataFrame, stations: DataFrame, crowd: int = 16) -> DataFrame:
    """points: pid, lat, lon; stations: key, lat, lon, more columns; no nulls among the coordinates.
    (pid, best): the struct of dist in metres, key and the station's other columns."""
    placed, cells = station_tree(stations, crowd)
    rest = [c for c in stations.columns if c not in ("key", "lat", "lon")]
    there = F.struct(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "key", *rest)
    leaves = placed.groupBy("level", "cell").agg(F.collect_list(there).alias("there"))
    pairs = leaves_in_reach(points, cells).join(leaves, ["level", "cell"])
    # a leaf's stations are told apart within the row, so that one row a leaf is grouped and not one a station
    best = F.array_min(F.transform("there", lambda s: F.struct(
        haversine_m("lat", "lon", s["s_lat"], s["s_lon"]).alias("dist"), s["key"].alias("key"), *[s[c].alias(c) for c in rest])))
    return pairs.select("pid", best.alias("best")).groupBy("pid").agg(F.min("best").alias("best"))

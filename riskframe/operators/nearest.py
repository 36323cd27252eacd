"""Nearest-station join without a cross join.

The stations' density decides the cells: :mod:`quadtree` is the way that is
taken by default.  Where ``cell_deg`` is given, for stations that are spread
evenly, a lat/lon grid prunes the pairing, and the answer is exact too:

1. level 0 puts stations in square cells sized from the stations; every
   point looks only at the 3x3 block of cells around its own cell (an
   equi-join on the cell id, so it shuffles or broadcasts like any join);
2. the best candidate is certified when its distance is strictly below a
   lower bound of the distance from the point to anything *outside* the
   block (latitude gap, and longitude gap shrunk by the largest |latitude|
   the block can hold);
3. uncertified points (no candidate, or a candidate that might be beaten
   from outside) move to the next level, whose cells are ``growth`` times
   larger; at the last level a block spans the whole globe, so it always
   certifies.

Longitudes are taken in [-180, 180].  At every level the stations near the
180th meridian are present a second time on its other side (longitude +-360),
so a block that reaches over the meridian holds them as well.

Work per point is the number of stations in its block; the residue that
reaches the coarse levels is only the points far from every station.
Ties are broken by the station key (smallest wins), as a total order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m


def _materialize(df: DataFrame, name: str) -> DataFrame:
    from ..sources.files import materialize
    return materialize(df, name)


def _levels(cell_deg: float, growth: int) -> list[float]:
    sizes = [cell_deg]
    while sizes[-1] < 180.0:
        sizes.append(sizes[-1] * growth)
    return sizes


def _outside_lower_bound(lat: Column, lon: Column, cy: Column, cx: Column, g: float) -> Column:
    """Lower bound (metres) of the distance from (lat, lon) to any point
    outside the 3x3 block of cells of size ``g`` centred on (cy, cx)."""
    lat_lo, lat_hi = (cy - 1) * g, (cy + 2) * g
    lon_lo, lon_hi = (cx - 1) * g, (cx + 2) * g
    dlat = F.least(lat - lat_lo, lat_hi - lat)
    lb_lat = F.radians(dlat) * F.lit(EARTH_RADIUS_M)
    dlon = F.least(lon - lon_lo, lon_hi - lon)
    phi_max = F.least(F.lit(90.0), F.greatest(F.abs(lat_lo), F.abs(lat_hi), F.abs(lat)))
    lb_lon = F.lit(2 * EARTH_RADIUS_M) * F.asin(
        F.cos(F.radians(phi_max)) * F.sin(F.radians(F.least(dlon, F.lit(180.0))) / 2))
    return F.least(lb_lat, lb_lon)


def cell_size(stations: DataFrame, lat: str, lon: str) -> float:
    """First cell size: about two evenly spread stations in a cell, 20 in a block.  At least
    0.001 degrees (stations at one spot), at most 90 (one station, or none)."""
    r = stations.agg(F.count(F.lit(1)).alias("n"), (F.max(lat) - F.min(lat)).alias("dy"), (F.max(lon) - F.min(lon)).alias("dx")).first()
    if r["n"] < 2:
        return 90.0
    return min(90.0, max(0.001, 1.5 * math.sqrt(max(r["dy"], 0.001) * max(r["dx"], 0.001) / r["n"])))


def nearest_station(points: DataFrame, stations: DataFrame, *,
                    point_key: str, station_key: str,
                    point_lat: str = "latitud", point_lon: str = "longitud",
                    station_lat: str = "latitud", station_lon: str = "longitud",
                    station_cols: list[str] | None = None,
                    cell_deg: float | None = None, growth: int = 4,
                    station_key_as: str | None = None,
                    distance_col: str = "distancia_m", materialize: bool = False) -> DataFrame:
    """One row per point: the point's columns, the nearest station's key
    (renamed ``station_key_as`` if given), ``station_cols`` and the haversine
    distance in metres.

    Points and stations with a null coordinate take no part in the pairing;
    such points are returned with null station columns.

    By default the stations' quadtree is searched; its cells are written while the
    plan is made.  With ``cell_deg`` a grid with cells of that size in degrees
    (:func:`cell_size` has one that follows from the stations' number and extent).

    ``materialize=True`` writes the pairing (of the grid, each level's) as a table in the
    shared checkpoint folder (``spark.checkpoint.dir``), so that it isn't planned again by
    every later use; the grid then stops as soon as no point is pending.
    """
    station_cols = station_cols or []
    st = stations.select(
        F.col(station_key).alias("_s_key"),
        F.col(station_lat).cast("double").alias("_s_lat"),
        F.col(station_lon).cast("double").alias("_s_lon"),
        *[F.col(c).alias(f"_s_{c}") for c in station_cols],
    ).where(F.col("_s_lat").isNotNull() & F.col("_s_lon").isNotNull())

    pending = points.select(
        F.col(point_key).alias("_p_key"),
        F.col(point_lat).cast("double").alias("_p_lat"),
        F.col(point_lon).cast("double").alias("_p_lon"),
    ).where(F.col("_p_lat").isNotNull() & F.col("_p_lon").isNotNull())

    if cell_deg is None:
        from .quadtree import nearest_by_tree
        found = nearest_by_tree(pending.toDF("pid", "lat", "lon"), st.withColumnsRenamed({"_s_key": "key", "_s_lat": "lat", "_s_lon": "lon"}))
        found = found.select(F.col("pid").alias(point_key), F.col("best.key").alias(station_key_as or station_key),
                             *[F.col(f"best._s_{c}").alias(c) for c in station_cols], F.col("best.dist").alias(distance_col))
        return points.join(_materialize(found, "nearest") if materialize else found, point_key, "left")

    sizes = _levels(cell_deg, growth)
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    candidate = F.struct(F.col("_d"), F.col("_s_key"), *[F.col(f"_s_{c}") for c in station_cols])
    resolved: list[DataFrame] = []
    for level, g in enumerate(sizes):
        last = level == len(sizes) - 1
        # a block reaches at most 2 g over the meridian
        turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("_s_lon") <= 2 * g - 180.0, F.lit(360.0)),
                                        F.when(F.col("_s_lon") >= 180.0 - 2 * g, F.lit(-360.0))))
        cells = (st.withColumn("_turn", F.explode(turns))
                 .withColumns({"_cy": F.floor(F.col("_s_lat") / g),
                               "_cx": F.floor((F.col("_s_lon") + F.col("_turn")) / g)})
                 .drop("_turn"))
        probe = (pending
                 .withColumns({"_pcy": F.floor(F.col("_p_lat") / g),
                               "_pcx": F.floor(F.col("_p_lon") / g)})
                 .withColumn("_dy", F.explode(offsets))
                 .withColumn("_dx", F.explode(offsets))
                 .withColumns({"_cy": F.col("_pcy") + F.col("_dy"),
                               "_cx": F.col("_pcx") + F.col("_dx")}))
        pairs = probe.join(cells, ["_cy", "_cx"], "left").withColumn(
            "_d", haversine_m("_p_lat", "_p_lon", "_s_lat", "_s_lon"))
        best = pairs.groupBy("_p_key", "_p_lat", "_p_lon", "_pcy", "_pcx").agg(
            F.min(F.when(F.col("_s_key").isNotNull(), candidate)).alias("_best"))
        if materialize:
            best = _materialize(best, f"nearest-level{level}")
        if last:
            resolved.append(best.select("_p_key", "_best"))
            break
        bound = _outside_lower_bound(F.col("_p_lat"), F.col("_p_lon"), F.col("_pcy"), F.col("_pcx"), g)
        best = best.withColumn(
            "_ok", F.coalesce(F.col("_best._d") < bound * F.lit(1 - 1e-9), F.lit(False)))
        resolved.append(best.where("_ok").select("_p_key", "_best"))
        pending = best.where(~F.col("_ok")).select("_p_key", "_p_lat", "_p_lon")
        if materialize and pending.isEmpty():
            break

    found = resolved[0]
    for r in resolved[1:]:
        found = found.unionByName(r)
    found = found.select(
        F.col("_p_key").alias(point_key),
        F.col("_best._s_key").alias(station_key_as or station_key),
        *[F.col(f"_best._s_{c}").alias(c) for c in station_cols],
        F.col("_best._d").alias(distance_col),
    )
    return points.join(found, point_key, "left")


def pair_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """The size of the cross product, without building it.

    Both sides are first reduced to one-row counts, so the product below is a
    1 x 1 join.
    """
    return left.agg(F.count(F.lit(1)).alias("n_left")).crossJoin(
        right.agg(F.count(F.lit(1)).alias("n_right"))).select(
        (F.col("n_left") * F.col("n_right")).alias("n_pairs"), "n_left", "n_right")

"""Composite jobs E1–E8: the daily risk table, built as one lazy plan each.

Each job takes DataFrames (landed or prepared tables with the documented
columns) and returns a DataFrame; writing is the caller's choice.  The
``*_from_fixtures`` helpers wire the jobs to the fixture views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..functions.text import (add_calendar, first_available, impute_mean, replace_placeholder, round_half_up,
                              to_number)
from ..operators import aggregate as agg
from ..operators import relational as rel
from ..operators import series
from ..operators.nearest import nearest_station

CLIMATE_SCHEMA = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("indicativo", T.LongType()),
    T.StructField("prec", T.DoubleType()),
    T.StructField("racha", T.DoubleType()),
    T.StructField("velmedia", T.DoubleType()),
    T.StructField("tmed", T.DoubleType()),
])


# ---------------------------------------------------------------- E1 climate fact

def climate_pivot(readings: DataFrame, variables: DataFrame) -> DataFrame:
    """Readings ⋈ variable catalog -> one row per (fecha, station) with the
    named variables (explicit pivot values) and the coalesced wind speed."""
    names = [n for _, n in fx.VARIABLE_CATALOG]
    named = readings.join(F.broadcast(variables), readings["variable"] == variables["codi_variable"])
    wide = agg.pivot_sum(named, ["fecha", "indicativo"], "nom_variable", names, "valor")
    return wide.withColumn("velmedia", first_available("velmedia_10m", "velmedia_2m", "velmedia_6m"))


def job_climate(readings: DataFrame, variables: DataFrame, daily_second: DataFrame,
                stations: DataFrame) -> DataFrame:
    """Two climate sources aligned to one schema, tagged, with the
    station name attached."""
    first = climate_pivot(readings, variables)
    both = rel.union_sources({"meteocat": first, "aemet": daily_second}, CLIMATE_SCHEMA)
    return both.join(stations.select("indicativo", "nombre"), "indicativo", "left")


# ---------------------------------------------------------------- E2 mobility

def zone_dimension(municipalities: DataFrame) -> DataFrame:
    """One row per mobility zone: its municipality count and representative
    (smallest) municipality code."""
    return municipalities.groupBy(F.col("zona").alias("destino")).agg(
        F.count(F.lit(1)).alias("n_municipios"),
        F.min("codigo_municipio").alias("cod_municipio"))


def job_mobility(trips: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Trips summed per (day, destination zone) *before* any join, then
    the zone's attributes; ``year``/``month`` for partitioned storage."""
    per_zone = series.group_totals(trips, ["fecha", "destino"], ["viajes", "viajes_km"])
    out = per_zone.join(zone_dimension(municipalities), "destino", "inner")
    return out.withColumns({"year": F.year("fecha").cast("int"), "month": F.month("fecha").cast("int")})


# ---------------------------------------------------------------- E3 terrain + risk

def job_terrain_risk(altitude: DataFrame, slope: DataFrame, risk: DataFrame) -> DataFrame:
    """Altitude (all-text landed) + slope by comarca (left) + risk by
    normalised municipality code (inner), one row per municipality."""
    alt = rel.bulk_rename(altitude, {"Codigo": "cod_municipio", "Municipio": "municipio",
                                     "Comarca": "comarca", "Altitud": "altitud_txt"})
    alt = alt.withColumn("altitud", F.col("altitud_txt").try_cast("int")).drop("altitud_txt")
    sl = slope.select("comarca", to_number("porcentaje_pendiente_total").alias("porcentaje_pendiente_total"))
    terrain = alt.join(sl, "comarca", "left")
    rk = risk.select(F.col("MUNICIPI").alias("_code"), F.col("ALT_RISC").alias("alto_riesgo"),
                     F.col("PERILL").alias("peligro"), F.col("VULNER").alias("vulner"))
    out = rel.join_normalized(terrain, rk, "cod_municipio", "_code").drop("_code")
    return out.select("cod_municipio", "municipio", F.col("comarca").cast("int").alias("comarca"),
                      "altitud", "porcentaje_pendiente_total", "alto_riesgo", "peligro", "vulner").distinct()


# ---------------------------------------------------------------- E4 bridge

def apply_overrides(points: DataFrame, overrides: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keyed manual corrections: ``coalesce(override, value)``."""
    o = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    j = points.join(o, key, "left")
    return j.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c in cols}).drop(
        *[f"_o_{c}" for c in cols])


def station_overrides(municipalities: DataFrame) -> DataFrame:
    """Fixture override table: every 50th municipality has corrected
    coordinates (derived from the data, so it grows with it)."""
    return municipalities.where(F.col("cod_num") % 50 == 7).select(
        "codigo_municipio", (F.col("latitud") + 0.05).alias("latitud"), (F.col("longitud") - 0.05).alias("longitud"))


def job_station_bridge(municipalities: DataFrame, stations: DataFrame,
                       overrides: DataFrame | None = None, cell_deg: float | None = None,
                       materialize: bool = True) -> DataFrame:
    """Every municipality's nearest station (exact, grid-pruned).

    The bridge is a small dimension (one row per municipality) used by three
    later joins, so by default it is materialised level by level (see
    ``nearest_station``) rather than re-planned inside each consumer."""
    pts = municipalities.select("codigo_municipio", "municipio", "latitud", "longitud")
    if overrides is not None:
        pts = apply_overrides(pts, overrides, "codigo_municipio", ["latitud", "longitud"])
    st = stations.select("indicativo", F.col("nombre").alias("nombre_estacion"), "latitud", "longitud")
    b = nearest_station(pts, st, point_key="codigo_municipio", station_key="indicativo",
                        station_cols=["nombre_estacion"], cell_deg=cell_deg, materialize=materialize)
    return b.select("codigo_municipio", "municipio", "indicativo", "nombre_estacion",
                    round_half_up("distancia_m", 3).alias("distancia_m"))


# ---------------------------------------------------------------- E5 occurrence

def incidents_per_station_day(incidents: DataFrame, bridge: DataFrame) -> DataFrame:
    """Q4: incidents mapped to their municipality's station and aggregated to
    one row per (station, day) before the join to the climate table."""
    j = incidents.join(bridge.select(F.col("codigo_municipio").alias("codi_municipi"), "indicativo"),
                       "codi_municipi")
    return j.groupBy("indicativo", "fecha").agg(
        F.count(F.lit(1)).alias("n_incendios"),
        F.sum("haforestal").alias("haforestal"),
        F.max("haforestal").alias("ha_max"))


def job_occurrence(weather: DataFrame, incidents: DataFrame, bridge: DataFrame) -> DataFrame:
    """E5: every station-day of the climate table with its incident counts
    and the 0/1 ``ocurrencia`` label (right join on two keys)."""
    inc = incidents_per_station_day(incidents, bridge)
    j = inc.join(weather, ["indicativo", "fecha"], "right")
    j = j.withColumn("n_incendios", F.coalesce("n_incendios", F.lit(0)).cast("long"))
    return rel.occurrence_label(j, "ha_max").drop("ha_max")


# ---------------------------------------------------------------- E6/E7 features

def served_terrain(bridge: DataFrame, terrain: DataFrame) -> DataFrame:
    """The municipalities that each station serves with their terrain and risk.  Joined before the
    fan-out, so that no municipality-day row is shuffled to meet its terrain."""
    t = terrain.select(F.col("cod_municipio").alias("codigo_municipio"), "municipio", "altitud",
                       "porcentaje_pendiente_total", "alto_riesgo", "peligro", "vulner")
    return bridge.select("codigo_municipio", "indicativo").join(t, "codigo_municipio", "left")


def job_features(occurrence: DataFrame, bridge: DataFrame, terrain: DataFrame) -> DataFrame:
    """Station-day facts fanned out to the municipalities each station
    serves, with the municipality's terrain and risk."""
    out = rel.fan_out(occurrence, served_terrain(bridge, terrain), "indicativo")
    return out.select("fecha", "indicativo", "municipio", F.col("codigo_municipio").alias("cod_municipio"),
                      *fx.WEATHER_COLUMNS, "altitud", "porcentaje_pendiente_total", "alto_riesgo",
                      "peligro", "vulner", "ocurrencia")


def zone_stations(municipalities: DataFrame, bridge: DataFrame) -> DataFrame:
    """The stations of a zone: those that serve any of its municipalities, each once."""
    return (municipalities.select("codigo_municipio", F.col("zona").alias("destino"))
            .join(bridge.select("codigo_municipio", "indicativo"), "codigo_municipio")
            .select("destino", "indicativo").distinct())


def mobility_per_station_day(mobility: DataFrame, stations_of_zone: DataFrame) -> DataFrame:
    """Mobility of the zones a station serves, summed per day (Q5: a zone total
    reaches every station of the zone, and each of them once)."""
    return mobility.join(stations_of_zone, "destino").groupBy("fecha", "indicativo").agg(
        round_half_up(F.sum("total_viajes"), 4).alias("total_viajes_estacion"),
        round_half_up(F.sum("total_viajes_km"), 4).alias("total_viajes_km_estacion"))


def job_features_mobility(features: DataFrame, mobility: DataFrame, stations_of_zone: DataFrame) -> DataFrame:
    """E7 (flagship): the feature table with mobility per station-day (left)."""
    mob = mobility_per_station_day(mobility, stations_of_zone)
    return features.join(mob, ["fecha", "indicativo"], "left")


def job_features_mobility_from_parts(occurrence: DataFrame, bridge: DataFrame, terrain: DataFrame,
                                     mobility: DataFrame, stations_of_zone: DataFrame) -> DataFrame:
    """E7 with the mobility join moved below the fan-out.

    Mobility is keyed by (day, station), which the fan-out preserves, so
    joining it to the station-days first shuffles one row per station-day
    instead of one per municipality-day; the fan-out then meets the
    municipalities with their terrain already joined, and its rows are never shuffled.  Same rows as
    ``job_features_mobility(job_features(...), ...)``.
    """
    mob = mobility_per_station_day(mobility, stations_of_zone)
    occ = occurrence.join(mob, ["fecha", "indicativo"], "left")
    out = rel.fan_out(occ, served_terrain(bridge, terrain), "indicativo")
    return out.select("fecha", "indicativo", "municipio", F.col("codigo_municipio").alias("cod_municipio"),
                      *fx.WEATHER_COLUMNS, "altitud", "porcentaje_pendiente_total", "alto_riesgo",
                      "peligro", "vulner", "ocurrencia", "total_viajes_estacion", "total_viajes_km_estacion")


# ---------------------------------------------------------------- E8 cleaning

def job_clean(features: DataFrame) -> DataFrame:
    """Calendar, placeholder category, fills per station, collapse to one
    row per (day, station) by column max, mean imputation, zero-fill of
    mobility, rounding."""
    df = add_calendar(features, "fecha")
    df = df.withColumn("vulner", replace_placeholder("vulner", "-", "Moderada"))
    df = agg.group_max_all(df.drop("municipio", "cod_municipio"), ["fecha", "indicativo"])
    return _clean_tail(df)


def _clean_tail(df: DataFrame) -> DataFrame:
    df = series.forward_fill(df, "indicativo", "fecha", fx.WEATHER_COLUMNS)
    df = series.backward_fill(df, "indicativo", "fecha", ["presmax", "presmin"])
    df = impute_mean(df, ["porcentaje_pendiente_total"])
    df = df.na.fill(0, subset=["total_viajes_estacion", "total_viajes_km_estacion"])
    return df.withColumns({c: round_half_up(c, 2) for c in fx.WEATHER_COLUMNS + [
        "porcentaje_pendiente_total", "total_viajes_estacion", "total_viajes_km_estacion"]})


TERRAIN_COLS = ["altitud", "porcentaje_pendiente_total", "alto_riesgo", "peligro", "vulner"]


def job_clean_from_parts(occurrence: DataFrame, bridge: DataFrame, terrain: DataFrame,
                         mobility: DataFrame, stations_of_zone: DataFrame) -> DataFrame:
    """E8 without building the feature table first.

    ``job_clean(job_features_mobility(...))`` fans every station-day out to
    all municipalities of the station and then collapses it back with a
    column max.  Only the terrain columns differ between those copies, so the
    same result is a per-station max of the terrain columns (one row per
    station) joined to the station-days: no k-fold expansion, no shuffle of
    it.  The oracle checks this plan against the fan-out definition.
    """
    t = terrain.select(F.col("cod_municipio").alias("codigo_municipio"), *TERRAIN_COLS).withColumn(
        "vulner", replace_placeholder("vulner", "-", "Moderada"))
    # dealt out first: texts are grouped by sorting, and the municipalities may lie in one file
    per_station = (bridge.select("codigo_municipio", "indicativo").join(t, "codigo_municipio", "left").repartition("codigo_municipio")
                   .groupBy("indicativo").agg(*[F.max(c).alias(c) for c in TERRAIN_COLS]))
    days = occurrence.select("fecha", "indicativo", *fx.WEATHER_COLUMNS, "ocurrencia")
    df = days.join(per_station, "indicativo").join(
        mobility_per_station_day(mobility, stations_of_zone), ["fecha", "indicativo"], "left")
    return _clean_tail(add_calendar(df, "fecha"))


# ---------------------------------------------------------------- wiring to fixtures

def bridge_fx(spark: SparkSession, d: str) -> DataFrame:
    m = fx.fx_municipalities(spark, d)
    return job_station_bridge(m, fx.fx_stations(spark, d), station_overrides(m))


def climate_fx(spark: SparkSession, d: str) -> DataFrame:
    w = fx.fx_weather(spark, d).select("fecha", "indicativo", "prec", "racha", "velmedia", "tmed")
    return job_climate(fx.fx_readings(spark, d), fx.fx_variables(spark, d), w, fx.fx_stations(spark, d))


def mobility_fx(spark: SparkSession, d: str) -> DataFrame:
    return job_mobility(fx.fx_trips(spark, d), fx.fx_municipalities(spark, d))


def terrain_fx(spark: SparkSession, d: str, materialized: bool = False) -> DataFrame:
    t = job_terrain_risk(fx.fx_altitude(spark, d), fx.fx_slope(spark, d), fx.fx_risk(spark, d))
    if materialized:  # a dimension table, written once like the bridge
        from ..sources.files import materialize
        t = materialize(t, "terrain")
    return t


def occurrence_fx(spark: SparkSession, d: str, bridge: DataFrame | None = None) -> DataFrame:
    bridge = bridge if bridge is not None else bridge_fx(spark, d)
    return job_occurrence(fx.fx_weather(spark, d), fx.fx_incidents(spark, d), bridge)


def features_fx(spark: SparkSession, d: str, bridge: DataFrame | None = None) -> DataFrame:
    bridge = bridge if bridge is not None else bridge_fx(spark, d)
    return job_features(occurrence_fx(spark, d, bridge), bridge, terrain_fx(spark, d))


def features_mobility_fx(spark: SparkSession, d: str) -> DataFrame:
    bridge = bridge_fx(spark, d)
    mob = mobility_fx(spark, d).select("fecha", "destino", "total_viajes", "total_viajes_km")
    return job_features_mobility_from_parts(occurrence_fx(spark, d, bridge), bridge,
                                            terrain_fx(spark, d, materialized=True), mob,
                                            zone_stations(fx.fx_municipalities(spark, d), bridge))


def clean_fx(spark: SparkSession, d: str) -> DataFrame:
    bridge = bridge_fx(spark, d)
    mob = mobility_fx(spark, d).select("fecha", "destino", "total_viajes", "total_viajes_km")
    return job_clean_from_parts(occurrence_fx(spark, d, bridge), bridge, terrain_fx(spark, d, materialized=True),
                                mob, zone_stations(fx.fx_municipalities(spark, d), bridge))


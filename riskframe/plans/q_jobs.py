"""Registered composite jobs E1–E8 and the operators checked through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.text import round_half_up
from . import jobs
from . import sql_jobs as sj
from .catalog import register

_PIV = ", ".join(f"sum(valor) FILTER (WHERE nom_variable = '{n}') AS {n}" for n in fx.VARIABLE_NAMES)


@register("job_climate", fx.sql_with("fx_readings", "fx_variables", "fx_weather", "fx_stations", extra={
    "rv": "SELECT r.fecha, r.indicativo, v.nom_variable, r.valor FROM fx_readings r "
          "JOIN fx_variables v ON r.variable = v.codi_variable",
    "piv": f"SELECT fecha, indicativo, {_PIV} FROM rv GROUP BY fecha, indicativo",
    "src": "SELECT fecha, indicativo, prec, racha, coalesce(velmedia_10m, velmedia_2m, velmedia_6m) AS velmedia, "
           "CAST(NULL AS DOUBLE) AS tmed, 'meteocat' AS fuente FROM piv UNION ALL "
           "SELECT fecha, indicativo, prec, racha, velmedia, tmed, 'aemet' AS fuente FROM fx_weather",
}) + "SELECT s.*, st.nombre FROM src s LEFT JOIN fx_stations st ON s.indicativo = st.indicativo")
def q_job_climate(spark, d):
    return jobs.climate_fx(spark, d)


@register("job_mobility", sj.with_jobs("mobility") + "SELECT * FROM mobility")
def q_job_mobility(spark, d):
    return jobs.mobility_fx(spark, d)


@register("job_terrain_risk", sj.with_jobs("terrain") + "SELECT * FROM terrain")
def q_job_terrain_risk(spark, d):
    return jobs.terrain_fx(spark, d)


@register("job_station_bridge", sj.with_jobs("bridge") + "SELECT * FROM bridge")
def q_job_station_bridge(spark, d):
    return jobs.bridge_fx(spark, d)


@register("nearest_station", sj.with_jobs("bridge") +
          "SELECT codigo_municipio, indicativo, distancia_m FROM bridge")
def q_nearest_station(spark, d):
    """J7 alone (distance in mm precision, so the two engines' last-bit
    trigonometry agrees)."""
    b = jobs.bridge_fx(spark, d)
    return b.select("codigo_municipio", "indicativo", "distancia_m")


@register("job_occurrence", sj.with_jobs("occurrence") + "SELECT * FROM occurrence")
def q_job_occurrence(spark, d):
    return jobs.occurrence_fx(spark, d)


@register("job_features", sj.with_jobs("features") + "SELECT * FROM features")
def q_job_features(spark, d):
    return jobs.features_fx(spark, d)


@register("job_features_mobility", sj.with_jobs("features_mobility") + "SELECT * FROM features_mobility")
def q_job_features_mobility(spark, d):
    return jobs.features_mobility_fx(spark, d)


@register("job_clean", sj.with_jobs("clean") + "SELECT * FROM clean")
def q_job_clean(spark, d):
    return jobs.clean_fx(spark, d)


@register("station_to_municipalities", sj.with_jobs("occurrence") + f"""
    SELECT b.codigo_municipio, count(*) AS n_dias, {sj.rnd('sum(o.tmed)', 6)} AS sum_tmed
    FROM occurrence o JOIN bridge b ON o.indicativo = b.indicativo
    GROUP BY b.codigo_municipio""")
def q_station_to_municipalities(spark, d):
    """Fan-out of station-days to municipalities, summarised per municipality."""
    bridge = jobs.bridge_fx(spark, d)
    fan = jobs.rel.fan_out(jobs.occurrence_fx(spark, d, bridge), bridge.select("codigo_municipio", "indicativo"))
    return fan.groupBy("codigo_municipio").agg(F.count(F.lit(1)).alias("n_dias"),
                                               round_half_up(F.sum("tmed"), 6).alias("sum_tmed"))


@register("join_anti", sj.with_jobs("bridge", "fx_incidents") + """
    SELECT count(*) AS n_sin_incendio FROM bridge b
    WHERE NOT EXISTS (SELECT 1 FROM fx_incidents i WHERE i.codi_municipi = b.codigo_municipio)""")
def q_join_anti(spark, d):
    """Municipalities of the bridge without any incident (anti-join count)."""
    b = jobs.bridge_fx(spark, d)
    inc = fx.fx_incidents(spark, d).select(F.col("codi_municipi").alias("codigo_municipio"))
    return jobs.rel.count_unmatched(b, inc, ["codigo_municipio"]).agg(
        F.count(F.lit(1)).alias("n_sin_incendio"))


@register("join_right_two_key", sj.with_jobs("occurrence") + """
    SELECT count(*) AS n_rows, sum(CASE WHEN inc.indicativo IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_matched,
           sum(coalesce(inc.n_incendios, 0))::BIGINT AS n_incendios
    FROM inc RIGHT JOIN fx_weather w ON inc.indicativo = w.indicativo AND inc.fecha = w.fecha""")
def q_join_right_two_key(spark, d):
    """Incidents pre-aggregated per (station, day), right-joined on both keys."""
    inc = jobs.incidents_per_station_day(fx.fx_incidents(spark, d), jobs.bridge_fx(spark, d))
    inc = inc.withColumn("_m", F.lit(1))
    j = inc.join(fx.fx_weather(spark, d), ["indicativo", "fecha"], "right")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.coalesce("_m", F.lit(0))).cast("long").alias("n_matched"),
                 F.sum(F.coalesce("n_incendios", F.lit(0))).cast("long").alias("n_incendios"))


@register("class_balance", sj.with_jobs("occurrence") + """
    SELECT indicativo, ocurrencia, count(*) AS n,
           count(*) / sum(count(*)) OVER (PARTITION BY indicativo) AS share
    FROM occurrence GROUP BY indicativo, ocurrencia""")
def q_class_balance(spark, d):
    from ..operators.aggregate import class_balance
    return class_balance(jobs.occurrence_fx(spark, d), "ocurrencia", ["indicativo"])


@register("class_balance_global", sj.with_jobs("occurrence") + """
    SELECT ocurrencia, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
    FROM occurrence GROUP BY ocurrencia""")
def q_class_balance_global(spark, d):
    from ..operators.aggregate import class_balance
    return class_balance(jobs.occurrence_fx(spark, d), "ocurrencia")


_DIMS = ["weekend", "dayofyear", "mes", "laborable", "vulner", "peligro", "alto_riesgo"]


@register("incident_histograms", sj.with_jobs("clean") + " UNION ALL ".join(
    f"SELECT '{dm}' AS dim, CAST({dm} AS VARCHAR) AS value, count(*) AS n FROM clean "
    f"WHERE ocurrencia = 1 GROUP BY {dm}" for dm in _DIMS))
def q_incident_histograms(spark, d):
    from ..operators.aggregate import incident_histograms
    return incident_histograms(jobs.clean_fx(spark, d), _DIMS)


@register("feature_subset", sj.with_jobs("clean") + "SELECT fecha, indicativo, " +
          ", ".join(["prec", "tmax", "tmed", "tmin", "velmedia", "racha", "sol", "presmax", "presmin", "rhum",
                     "altitud", "porcentaje_pendiente_total", "total_viajes_estacion", "ocurrencia"]) +
          " FROM clean")
def q_feature_subset(spark, d):
    from ..operators.relational import feature_subset
    return feature_subset(jobs.clean_fx(spark, d), ["numeric_mobility"], ["fecha", "indicativo"], "ocurrencia")


@register("group_max_all", fx.sql_with("fx_readings") + """
    SELECT fecha, indicativo, max(lectura_id) AS lectura_id, max(variable) AS variable, max(ts) AS ts,
           max(valor) AS valor
    FROM fx_readings GROUP BY fecha, indicativo""")
def q_group_max_all(spark, d):
    from ..operators.aggregate import group_max_all
    return group_max_all(fx.fx_readings(spark, d), ["fecha", "indicativo"])


@register("group_max_row", fx.sql_with("fx_readings") + """
    SELECT fecha, indicativo, lectura_id, variable, ts, valor FROM (
      SELECT *, row_number() OVER (PARTITION BY fecha, indicativo ORDER BY valor DESC, lectura_id DESC) AS rn
      FROM fx_readings) WHERE rn = 1""")
def q_group_max_row(spark, d):
    """A5 whole-row variant (Q26): the reading with the largest value per key
    (ties: the larger reading id, as the struct comparison continues)."""
    from ..operators.aggregate import group_max_row
    r = fx.fx_readings(spark, d).select("fecha", "indicativo", "valor", "lectura_id", "variable", "ts")
    return group_max_row(r, ["fecha", "indicativo"], "valor")

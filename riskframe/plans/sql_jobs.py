"""SQL text of the composite jobs (E1–E8), for the DuckDB oracle.

Written independently of the Spark plans: brute force where the Spark plan
prunes (the nearest station is a full ranking of all pairs here).
"""

from __future__ import annotations

from .. import fixtures as fx
from ..functions.geo import haversine_sql

W = fx.WEATHER_COLUMNS


def rnd(expr: str, d: int = 2) -> str:
    """SQL twin of ``round_half_up``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def num(expr: str) -> str:
    """SQL twin of ``to_number``."""
    return (f"CASE WHEN lower(trim({expr})) IN (':', 'nan', '-', '') THEN NULL "
            f"ELSE TRY_CAST(replace(trim({expr}), ',', '.') AS DOUBLE) END")


BRIDGE = {
    "bridge_pts": """
        SELECT m.codigo_municipio, m.municipio,
               coalesce(o.latitud, m.latitud) AS latitud, coalesce(o.longitud, m.longitud) AS longitud
        FROM fx_municipalities m
        LEFT JOIN (SELECT codigo_municipio, latitud + 0.05 AS latitud, longitud - 0.05 AS longitud
                   FROM fx_municipalities WHERE cod_num % 50 = 7) o
          ON m.codigo_municipio = o.codigo_municipio""",
    "bridge": f"""
        SELECT codigo_municipio, municipio, indicativo, nombre_estacion,
               CAST(round(CAST(distancia_m AS DECIMAL(38,10)), 3) AS DOUBLE) AS distancia_m FROM (
          SELECT p.codigo_municipio, p.municipio, s.indicativo, s.nombre AS nombre_estacion,
                 {haversine_sql('p.latitud', 'p.longitud', 's.latitud', 's.longitud')} AS distancia_m,
                 row_number() OVER (PARTITION BY p.codigo_municipio
                   ORDER BY {haversine_sql('p.latitud', 'p.longitud', 's.latitud', 's.longitud')}, s.indicativo) AS rn
          FROM bridge_pts p CROSS JOIN fx_stations s) WHERE rn = 1""",
}
BRIDGE_DEPS = ("fx_municipalities", "fx_stations")

OCCURRENCE = {
    "inc": """
        SELECT b.indicativo, i.fecha, count(*) AS n_incendios, sum(i.haforestal) AS haforestal,
               max(i.haforestal) AS ha_max
        FROM fx_incidents i JOIN bridge b ON i.codi_municipi = b.codigo_municipio
        GROUP BY b.indicativo, i.fecha""",
    "occurrence": """
        SELECT w.*, CAST(coalesce(inc.n_incendios, 0) AS BIGINT) AS n_incendios, inc.haforestal,
               CAST(CASE WHEN inc.ha_max > 0 THEN 1 ELSE 0 END AS BIGINT) AS ocurrencia
        FROM inc RIGHT JOIN fx_weather w ON inc.indicativo = w.indicativo AND inc.fecha = w.fecha""",
}
OCCURRENCE_DEPS = BRIDGE_DEPS + ("fx_incidents", "fx_weather")

TERRAIN = {
    "terrain": f"""
        SELECT DISTINCT a.Codigo AS cod_municipio, a.Municipio AS municipio,
               CAST(a.Comarca AS INTEGER) AS comarca, TRY_CAST(a.Altitud AS INTEGER) AS altitud,
               sl.pct AS porcentaje_pendiente_total, r.ALT_RISC AS alto_riesgo, r.PERILL AS peligro,
               r.VULNER AS vulner
        FROM fx_altitude a
        LEFT JOIN (SELECT comarca, {num('porcentaje_pendiente_total')} AS pct FROM fx_slope) sl
          ON a.Comarca = sl.comarca
        JOIN fx_risk r ON lpad(trim(a.Codigo), 6, '0') = lpad(trim(CAST(r.MUNICIPI AS VARCHAR)), 6, '0')""",
}
TERRAIN_DEPS = ("fx_altitude", "fx_slope", "fx_risk")

_wcols = ", ".join(f"o.{c}" for c in W)
FEATURES = {
    "features": f"""
        SELECT o.fecha, o.indicativo, t.municipio, b.codigo_municipio AS cod_municipio, {_wcols},
               t.altitud, t.porcentaje_pendiente_total, t.alto_riesgo, t.peligro, t.vulner, o.ocurrencia
        FROM occurrence o JOIN bridge b ON o.indicativo = b.indicativo
        LEFT JOIN terrain t ON b.codigo_municipio = t.cod_municipio""",
}

MOBILITY = {
    "per_zone": """
        SELECT fecha, destino, sum(viajes) AS total_viajes, sum(viajes_km) AS total_viajes_km
        FROM fx_trips GROUP BY fecha, destino""",
    "zones": """
        SELECT zona AS destino, count(*) AS n_municipios, min(codigo_municipio) AS cod_municipio
        FROM fx_municipalities GROUP BY zona""",
    "mobility": """
        SELECT p.destino, p.fecha, p.total_viajes, p.total_viajes_km, z.n_municipios, z.cod_municipio,
               CAST(year(p.fecha) AS INTEGER) AS year, CAST(month(p.fecha) AS INTEGER) AS month
        FROM per_zone p JOIN zones z ON p.destino = z.destino""",
}
MOBILITY_DEPS = ("fx_trips", "fx_municipalities")

FEATURES_MOBILITY = {
    "mob_st": """
        SELECT m.fecha, z.indicativo,
               CAST(round(CAST(sum(m.total_viajes) AS DECIMAL(38,10)), 4) AS DOUBLE) AS total_viajes_estacion,
               CAST(round(CAST(sum(m.total_viajes_km) AS DECIMAL(38,10)), 4) AS DOUBLE) AS total_viajes_km_estacion
        FROM mobility m
        JOIN (SELECT DISTINCT f.zona, b.indicativo
              FROM fx_municipalities f JOIN bridge b ON f.codigo_municipio = b.codigo_municipio) z
          ON m.destino = z.zona
        GROUP BY m.fecha, z.indicativo""",
    "features_mobility": """
        SELECT f.*, ms.total_viajes_estacion, ms.total_viajes_km_estacion
        FROM features f LEFT JOIN mob_st ms ON f.fecha = ms.fecha AND f.indicativo = ms.indicativo""",
}

_MAX_COLS = (W + ["altitud", "porcentaje_pendiente_total", "alto_riesgo", "peligro", "vulner", "ocurrencia",
                  "total_viajes_estacion", "total_viajes_km_estacion", "laborable", "dayofyear", "weekend", "mes"])
_ff = ",\n".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY indicativo ORDER BY fecha "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in W)
_keep = [c for c in _MAX_COLS if c not in W]
CLEAN = {
    "cal": """
        SELECT * REPLACE (CASE WHEN vulner = '-' THEN 'Moderada' ELSE vulner END AS vulner),
               CAST(isodow(fecha) - 1 AS BIGINT) AS laborable, CAST(dayofyear(fecha) AS BIGINT) AS dayofyear,
               CAST(CASE WHEN isodow(fecha) - 1 > 4 THEN 1 ELSE 0 END AS BIGINT) AS weekend,
               CAST(month(fecha) AS BIGINT) AS mes
        FROM features_mobility""",
    "gm": "SELECT fecha, indicativo, " + ", ".join(f"max({c}) AS {c}" for c in _MAX_COLS)
          + " FROM cal GROUP BY fecha, indicativo",
    "ff": "SELECT fecha, indicativo, " + ", ".join(_keep) + ",\n" + _ff + " FROM gm",
    "bf": "SELECT * REPLACE (" + ", ".join(
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY indicativo ORDER BY fecha "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}" for c in ("presmax", "presmin")) + ") FROM ff",
    "clean": "SELECT * REPLACE (" + ", ".join(
        [f"{rnd(c)} AS {c}" for c in W]
        + [f"{rnd('coalesce(porcentaje_pendiente_total, (SELECT avg(porcentaje_pendiente_total) FROM bf))')}"
           " AS porcentaje_pendiente_total",
           f"{rnd('coalesce(total_viajes_estacion, 0)')} AS total_viajes_estacion",
           f"{rnd('coalesce(total_viajes_km_estacion, 0)')} AS total_viajes_km_estacion"]) + ") FROM bf",
}


def chain(*parts: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for p in parts:
        out.update(p)
    return out


def with_jobs(upto: str, *extra_fx: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause with fixtures and job CTEs up to ``upto``."""
    plans = {
        "bridge": (BRIDGE_DEPS, chain(BRIDGE)),
        "occurrence": (OCCURRENCE_DEPS, chain(BRIDGE, OCCURRENCE)),
        "terrain": (TERRAIN_DEPS, chain(TERRAIN)),
        "mobility": (MOBILITY_DEPS, chain(MOBILITY)),
        "features": (OCCURRENCE_DEPS + TERRAIN_DEPS, chain(BRIDGE, OCCURRENCE, TERRAIN, FEATURES)),
        "features_mobility": (OCCURRENCE_DEPS + TERRAIN_DEPS + MOBILITY_DEPS,
                              chain(BRIDGE, OCCURRENCE, TERRAIN, FEATURES, MOBILITY, FEATURES_MOBILITY)),
        "clean": (OCCURRENCE_DEPS + TERRAIN_DEPS + MOBILITY_DEPS,
                  chain(BRIDGE, OCCURRENCE, TERRAIN, FEATURES, MOBILITY, FEATURES_MOBILITY, CLEAN)),
    }
    deps, ctes = plans[upto]
    ctes = dict(ctes)
    ctes.update(extra or {})
    return fx.sql_with(*deps, *extra_fx, extra=ctes)

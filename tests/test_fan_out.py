"""The fan-out to municipalities is the last join of the feature tables: its rows are not shuffled."""

import datetime as dt

from riskframe import fixtures as fx
from riskframe.plans import jobs


def parts(spark):
    day = dt.date(2020, 1, 1)
    weather = ", ".join(f"{c} double" for c in fx.WEATHER_COLUMNS)
    occ = spark.createDataFrame([(day, 1, *[1.0] * 10, 0), (day, 2, *[2.0] * 10, 1), (day, 3, *[3.0] * 10, 1)], f"fecha date, indicativo long, {weather}, ocurrencia long")
    bridge = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("c", 2), ("d", None), (None, 2)], "codigo_municipio string, indicativo long")
    terrain = spark.createDataFrame([("a", "A", 5, 1.0, "SI", "P1", "V1"), ("a", "A2", 6, 1.0, "SI", "P1", "V1"), ("c", "C", 7, None, "NO", "P2", "-"), (None, "N", 1, 1.0, "NO", "P0", "V0")],
                                    "cod_municipio string, municipio string, altitud int, porcentaje_pendiente_total double, alto_riesgo string, peligro string, vulner string")
    mobility = spark.createDataFrame([(day, 9, 4.0, 8.0)], "fecha date, destino long, total_viajes double, total_viajes_km double")
    zones = spark.createDataFrame([(9, 1)], "destino long, indicativo long")
    return occ, bridge, terrain, mobility, zones


def last_join(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return next(line for line in plan.splitlines() if "SortMergeJoin" in line)


def test_fan_out_is_the_last_join_and_keeps_every_row(spark):
    occ, bridge, terrain, mobility, zones = parts(spark)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        features, with_mobility = jobs.job_features(occ, bridge, terrain), jobs.job_features_mobility_from_parts(occ, bridge, terrain, mobility, zones)
        for df in (features, with_mobility):
            assert "indicativo" in last_join(df) and "codigo_municipio" not in last_join(df)
        got = sorted(((r.indicativo, r.cod_municipio, r.municipio, r.vulner) for r in features.collect()), key=str)
        assert got == sorted([(1, "a", "A", "V1"), (1, "a", "A2", "V1"), (1, "b", None, None), (2, "c", "C", "-"), (2, "c", "C", "-"), (2, None, None, None)], key=str)
        assert {(r.indicativo, r.total_viajes_estacion) for r in with_mobility.collect()} == {(1, 4.0), (2, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)

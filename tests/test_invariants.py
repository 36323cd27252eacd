"""Invariants of the jobs, on the sf0.001 fixtures."""

from pyspark.sql import functions as F

from riskframe import fixtures as fx
from riskframe.plans import jobs

SF = "/root/testdata/sf0.001"


def _dupes(df, keys):
    return df.groupBy(*keys).count().where("count > 1").count()


def test_bridge_covers_every_municipality_once(spark):
    b = jobs.bridge_fx(spark, SF)
    assert b.count() == fx.fx_municipalities(spark, SF).count()
    assert _dupes(b, ["codigo_municipio"]) == 0 and b.where(F.col("indicativo").isNull()).count() == 0


def test_right_join_to_unique_key_keeps_row_count(spark):
    occ = jobs.occurrence_fx(spark, SF)
    assert occ.count() == fx.fx_weather(spark, SF).count()
    assert _dupes(occ, ["fecha", "indicativo"]) == 0


def test_group_outputs_unique_on_their_keys(spark):
    assert _dupes(jobs.mobility_fx(spark, SF), ["fecha", "destino"]) == 0
    feats = jobs.features_mobility_fx(spark, SF)
    assert _dupes(feats, ["fecha", "cod_municipio"]) == 0
    clean = jobs.clean_fx(spark, SF)
    assert _dupes(clean, ["fecha", "indicativo"]) == 0


def test_fan_out_equals_municipalities_per_station(spark):
    b = jobs.bridge_fx(spark, SF)
    per_station = {r.indicativo: r["count"] for r in b.groupBy("indicativo").count().collect()}
    feats = jobs.features_mobility_fx(spark, SF)
    sizes = feats.groupBy("fecha", "indicativo").count().collect()
    assert all(r["count"] == per_station[r.indicativo] for r in sizes)


def test_no_nulls_after_imputation(spark):
    clean = jobs.clean_fx(spark, SF)
    for c in ["porcentaje_pendiente_total", "total_viajes_estacion", "total_viajes_km_estacion"] + fx.WEATHER_COLUMNS:
        assert clean.where(F.col(c).isNull()).count() == 0, c

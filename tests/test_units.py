"""Hand-made small cases for the operators' edges (FIXTURES.md §4)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import geo
from riskframe.functions import text as tx
from riskframe.operators import aggregate as agg
from riskframe.operators import evaluate as ev
from riskframe.operators import relational as rel
from riskframe.operators import sampling as smp
from riskframe.operators import series, stats
from riskframe.operators.nearest import nearest_station


def _hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    dphi, dl = p2 - p1, math.radians(b[1] - a[1])
    h = math.sin(dphi / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_matches_brute_force_on_scattered_points(spark):
    rnd = random.Random(7)
    stations = [(i, rnd.uniform(40, 43), rnd.uniform(0, 3.5)) for i in range(40)]
    stations += [(100, 10.0, -170.0), (101, -60.0, 179.9)]  # far away, across the antimeridian
    points = [(f"p{i}", rnd.uniform(38, 45), rnd.uniform(-2, 5)) for i in range(300)]
    points += [("far", -61.0, -179.9), ("pole", 89.0, 10.0)]
    sdf = spark.createDataFrame(stations, "indicativo long, latitud double, longitud double")
    pdf = spark.createDataFrame(points, "codigo string, latitud double, longitud double")
    got = {r.codigo: (r.indicativo, r.distancia_m) for r in
           nearest_station(pdf, sdf, point_key="codigo", station_key="indicativo", cell_deg=0.25).collect()}
    for code, lat, lon in points:
        best = min(stations, key=lambda s: (_hav((lat, lon), (s[1], s[2])), s[0]))
        assert got[code][0] == best[0], code
        assert abs(got[code][1] - _hav((lat, lon), (best[1], best[2]))) < 1e-3


def test_nearest_tie_breaks_by_station_key(spark):
    sdf = spark.createDataFrame([(2, 41.0, 1.1), (1, 41.0, 0.9)], "indicativo long, latitud double, longitud double")
    pdf = spark.createDataFrame([("m", 41.0, 1.0)], "codigo string, latitud double, longitud double")
    r = nearest_station(pdf, sdf, point_key="codigo", station_key="indicativo", materialize=True).first()
    assert r.indicativo == 1


def test_dms_to_decimal(spark):
    df = spark.createDataFrame([("413515N",), ("020412E",), ("020412W",), ("bad",)], "c string")
    got = [r.v for r in df.select(geo.dms_to_decimal("c").alias("v")).collect()]
    assert abs(got[0] - (41 + 35 / 60 + 15 / 3600)) < 1e-12
    assert abs(got[1] - (2 + 4 / 60 + 12 / 3600)) < 1e-12
    assert abs(got[2] + (2 + 4 / 60 + 12 / 3600)) < 1e-12
    assert got[3] is None


def test_to_number_placeholders(spark):
    df = spark.createDataFrame([("1,5",), (":",), ("-",), ("nan",), ("",), (None,), ("2.25",)], "c string")
    assert [r.v for r in df.select(tx.to_number("c").alias("v")).collect()] == [1.5, None, None, None, None, None, 2.25]


def test_first_available_and_strict(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, None), (1.2, 3.4, None), (None, None, 6.0)],
                               "a double, b double, c double")
    rows = df.select(tx.first_available("a", "b", "c").alias("v"),
                     tx.first_available("a", "b", "c", strict=True).alias("s")).collect()
    assert [r.v for r in rows] == [1.0, None, 1.2, 6.0]
    assert [r.s for r in rows] == [1.0, None, None, 6.0]


def test_round_half_up_on_decimal_text(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (-2.675,)], "x double")
    assert [r.v for r in df.select(tx.round_half_up("x", 2).alias("v")).collect()] == [2.68, 1.01, -2.68]


def test_fills_stay_inside_each_station(spark):
    rows = [("A", 1, None), ("B", 1, 10.0), ("A", 2, 1.0), ("B", 2, None), ("A", 3, None), ("B", 3, None)]
    df = spark.createDataFrame(rows, "st string, t int, x double")
    ff = {(r.st, r.t): r.x for r in series.forward_fill(df, "st", "t", ["x"]).collect()}
    assert ff == {("A", 1): None, ("A", 2): 1.0, ("A", 3): 1.0, ("B", 1): 10.0, ("B", 2): 10.0, ("B", 3): 10.0}
    bf = {(r.st, r.t): r.x for r in series.backward_fill(df, "st", "t", ["x"]).collect()}
    assert bf[("A", 1)] == 1.0 and bf[("B", 2)] is None


def test_iqr_fences_example(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "st string, i int, x double")
    f = agg.iqr_fences(df, ["st"], ["x"]).first()
    assert (f.q1, f.q3, f.lower, f.upper) == (2.0, 4.0, -1.0, 7.0)
    out = agg.iqr_outliers(df, ["st"], ["i"], ["x"]).collect()
    assert [r.valor for r in out] == [100.0]


def test_dedup_by_key_keeps_first_in_order(spark):
    df = spark.createDataFrame([("m", "d", 5.0, 3), ("m", "d", 7.0, 2), ("m", "d", 7.0, 1), ("n", "d", 0.0, 4)],
                               "m string, d string, ha double, id int")
    got = {r.m: r.id for r in rel.dedup_by_key(df, ["m", "d"], [-F.col("ha"), F.col("id")]).collect()}
    assert got == {"m": 1, "n": 4}


def test_first_n_exact_through_histogram_path(spark):
    df = spark.range(0, 5000).withColumn("g", F.lit(1))
    key = smp.hash_key(["id"], 9)
    got = smp.first_n(df, 1234, key, buckets=16)
    expect = [r.id for r in df.withColumn("h", key).orderBy("h").limit(1234).collect()]
    assert sorted(r.id for r in got.collect()) == sorted(expect)


def test_levene_and_acf_match_numpy(spark):
    rnd = np.random.default_rng(3)
    a, b = rnd.normal(0, 1, 50), rnd.normal(0, 3, 40)
    rows = [(0, float(x)) for x in a] + [(1, float(x)) for x in b]
    df = spark.createDataFrame(rows, "g int, x double")
    w = stats.levene_w(df, "g", ["x"]).first().w
    za, zb = np.abs(a - a.mean()), np.abs(b - b.mean())
    z = np.concatenate([za, zb])
    n, k = len(z), 2
    num = len(za) * (za.mean() - z.mean()) ** 2 + len(zb) * (zb.mean() - z.mean()) ** 2
    den = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    assert abs(w - (n - k) / (k - 1) * num / den) < 1e-9

    x = rnd.normal(0, 1, 60)
    sdf = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "st string, t int, x double")
    got = {r.lag: r.acf for r in stats.acf(sdf, "st", "t", ["x"], 5).collect()}
    xc = x - x.mean()
    for kk in range(1, 6):
        assert abs(got[kk] - (xc[:-kk] * xc[kk:]).sum() / (xc * xc).sum()) < 1e-9


def plain_pacf(r):
    """Partial autocorrelations by solving each order's Yule-Walker equations."""
    full = np.concatenate([[1.0], r])
    return [np.linalg.solve(full[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], full[1: k + 1])[-1] for k in range(1, len(r) + 1)]


def test_pacf_of_ar1_acf(spark):
    x = np.random.default_rng(3).normal(size=200).cumsum()
    x -= x.mean()
    series = {"ar1": [0.5 ** k for k in range(1, 6)], "walk": [float(x[:-k] @ x[k:] / (x @ x)) for k in range(1, 31)], "one": [0.25], "all": [1.0, 1.0, 1.0]}
    rows = [(key, "v", lag, r) for key, values in series.items() for lag, r in enumerate(values, 1)]
    got = {}
    for r in stats.pacf(spark.createDataFrame(rows, "st string, variable string, lag long, acf double"), "st").collect():
        got.setdefault(r.st, {})[r.lag] = r.pacf
    got = {key: np.array([v[k] for k in sorted(v)]) for key, v in got.items()}
    assert abs(got["ar1"][0] - 0.5) < 1e-12 and np.all(np.abs(got["ar1"][1:]) < 1e-12)
    assert np.allclose(got["walk"], plain_pacf(series["walk"])) and list(got["one"]) == [0.25]
    assert got["all"][0] == 1.0 and np.all(np.isnan(got["all"][1:]))


def test_classification_report_never_predicted_class(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0), (0, 0)], "label long, pred long")
    rep = {r.clase: r for r in ev.classification_report(df, "label", "pred").collect()}
    assert rep[1].precision == 0.0 and rep[1].recall == 0.0 and rep[1].support == 2
    assert rep[0].precision == 0.5 and rep[0].recall == 1.0


def test_downsample_keeps_all_positives(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(13)], "k long, y long")
    out = smp.downsample(df, "y", 4, ["k"], 1).collect()
    assert sum(r.y for r in out) == 3 and len(out) == 7


def test_knn_self_matches_brute_force(spark):
    from riskframe.operators.knn import knn_self
    rnd = np.random.default_rng(11)
    x = np.vstack([rnd.normal(0, 1, (120, 4)), rnd.normal(6, 0.2, (5, 4))])  # a far, tight cluster too
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {}
    for r in knn_self(df, "id", ["a", "b", "c", "d"], 3, cell=0.3).collect():
        got.setdefault(r.id, {})[r.nn_rank] = r.nn_key
    for i in range(len(x)):
        dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((dist[j], j) for j in range(len(x)) if j != i)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in order], i


def test_smote_reaches_parity(spark):
    rows = [(f"r{i}", 1 if i < 6 else 0, float(i % 5), float((i * 7) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, y long, a double, b double")
    syn = smp.smote(df, "y", "k", ["a", "b"], k=3, seed=5)
    assert syn.count() == 34 - 6
    assert set(r.y for r in syn.collect()) == {1}


def test_exact_quantiles_with_infinite_and_huge_values(spark):
    from riskframe.operators.quantiles import exact_quantiles
    inf = float("inf")
    x = [-inf, -inf, -1.5e308, *map(float, range(50)), 1.5e308, inf]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", inf)], "g string, v double")
    ps = [0.0, 10 / 54, 0.5, 53 / 54, 1.0]
    got = exact_quantiles(df, "g", "v", ps, buckets=4, exact_limit=3)
    assert [got[("a", p)] for p in ps] == [-inf, 7.0, 24.0 , 1.5e308, inf] and got[("b", 0.5)] == inf


def test_first_cell_follows_the_stations(spark):
    from riskframe.operators.nearest import cell_size
    at = lambda rows: cell_size(spark.createDataFrame(rows, "y double, x double"), "y", "x")
    grid = lambda n: [(10.0 * i / n, 10.0 * j / n) for i in range(n) for j in range(n)]
    assert at(grid(20)) == pytest.approx(at(grid(10)) / 2, rel=0.1)
    assert at([(1.0, 1.0)]) == 90.0 and at([(1.0, 1.0)] * 5) >= 0.001


def test_exact_quantiles_distributed_match_numpy(spark):
    from riskframe.operators.quantiles import exact_quantiles
    rnd = np.random.default_rng(5)
    a = np.round(rnd.normal(10, 3, 3000), 1)  # many ties
    b = rnd.exponential(2.0, 2501)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "g", "v", ps, buckets=8, exact_limit=40)
    for g, arr in (("a", a), ("b", b), ("c", np.array([7.0]))):
        for p in ps:
            assert abs(got[(g, p)] - np.percentile(arr, p * 100)) < 1e-9, (g, p)


def test_pivot_two_stations_missing_cell(spark):
    rows = [("s1", "t1", "a", 1.0), ("s1", "t1", "b", 2.0), ("s1", "t2", "a", 3.0), ("s1", "t2", "b", 4.0),
            ("s1", "t1", "c", 5.0), ("s2", "t1", "a", 6.0), ("s2", "t1", "a", 1.5)]
    df = spark.createDataFrame(rows, "st string, ts string, var string, v double")
    got = {(r.st, r.ts): (r.a, r.b, r.c) for r in agg.pivot_sum(df, ["st", "ts"], "var", ["a", "b", "c"], "v").collect()}
    assert got == {("s1", "t1"): (1.0, 2.0, 5.0), ("s1", "t2"): (3.0, 4.0, None), ("s2", "t1"): (7.5, None, None)}


def test_join_normalized_codes(spark):
    left = spark.createDataFrame([("080018", "Abrera"), ("08001", "short")], "code string, name string")
    right = spark.createDataFrame([(800183, "with check digit")], "ine long, info string")
    out = rel.join_normalized(left, right, "code", "ine", right_drop_check_digit=True).collect()
    assert [(r.name, r.info) for r in out] == [("Abrera", "with check digit")]
    short = spark.createDataFrame([(8001,)], "ine long")
    out2 = rel.join_normalized(left, short, "code", "ine").collect()
    assert [r.name for r in out2] == ["short"]


def test_zone_totals_before_join_and_station_fan_out(spark):
    from riskframe.plans import jobs
    trips = spark.createDataFrame([("d1", 7, 10.0, 1.0), ("d1", 7, 5.0, 2.0)],
                                  "fecha string, destino long, viajes double, viajes_km double")
    munis = spark.createDataFrame([("000001", 7), ("000002", 7)], "codigo_municipio string, zona long")
    mob = jobs.job_mobility(trips.withColumn("fecha", F.to_date("fecha", "'d'd")), munis).collect()
    assert len(mob) == 1 and mob[0].total_viajes == 15.0 and mob[0].n_municipios == 2  # Q5: summed once per zone
    facts = spark.createDataFrame([(1, "d1", 3.0)], "indicativo long, fecha string, tmed double")
    bridge = spark.createDataFrame([("m1", 1), ("m2", 1), ("m3", 2)], "codigo_municipio string, indicativo long")
    assert sorted(r.codigo_municipio for r in rel.fan_out(facts, bridge).collect()) == ["m1", "m2"]  # J9


def test_dedup_keeps_equal_readings_on_different_days(spark):
    df = spark.createDataFrame([("s", "2020-01-01", 5.0), ("s", "2020-01-02", 5.0), ("s", "2020-01-02", 5.0)],
                               "st string, fecha string, v double")
    out = rel.dedup_by_key(df, ["st", "fecha", "v"], [F.col("fecha")]).collect()
    assert len(out) == 2  # Q12: the date is part of the key


def test_class_weights_ten_negatives_three_positives(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(13)], "k long, y long")
    w = {r.y: r.weight for r in smp.class_weights(df, "y").collect()}
    assert abs(w[1] - 13 / (2 * 3)) < 1e-12 and abs(w[0] - 13 / (2 * 10)) < 1e-12
    parity = smp.undersample_parity(df, "y", ["k"], 1).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in parity} == {0: 3, 1: 3}


def test_f_survival_known_values():
    assert abs(stats.f_survival(4.9646, 1, 10) - 0.05) < 1e-4          # 95th percentile of F(1, 10)
    for x in (0.3, 1.0, 2.5, 7.0):                                        # closed form for d1 = 2
        assert abs(stats.f_survival(x, 2, 20) - (1 + 2 * x / 20) ** (-10)) < 1e-12
    assert stats.f_survival(0.0, 3, 7) == 1.0


def test_levene_test_has_p_value(spark):
    rows = [(0, float(x)) for x in range(20)] + [(1, float(3 * x)) for x in range(20)]
    r = stats.levene_test(spark.createDataFrame(rows, "g int, x double"), "g", ["x"]).first()
    assert 0.0 <= r.p_value <= 1.0 and r.df1 == 1 and r.df2 == 38


def test_noon_snapshot_picks_the_noon_reading(spark):
    rows = [(1, "s", "t", "2020-01-01 11:30:00", 1.0), (2, "s", "t", "2020-01-01 12:00:00", 2.0),
            (3, "s", "t", "2020-01-01 12:30:00", 3.0), (4, "s", "t", "2020-01-02 11:45:00", 4.0),
            (5, "s", "t", "2020-01-02 12:15:00", 5.0)]
    df = spark.createDataFrame(rows, "id long, st string, var string, ts string, v double").withColumn(
        "ts", F.to_timestamp("ts"))
    got = {r.v for r in rel.noon_snapshot(df, ["st", "var"], "ts", tie_col="id").collect()}
    assert got == {2.0, 4.0}  # exact noon; on a tie the earlier reading


def test_splits_are_exact_and_ordered(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k")
    r = {row.split: row["count"] for row in smp.split_random(df, ["k"], 0.8, 7).groupBy("split").count().collect()}
    assert r == {"train": 81, "test": 20}
    o = smp.split_ordered(df, F.col("k"), 0.8)
    assert sorted(x.k for x in o.where("split = 'train'").collect()) == list(range(81))


def test_long_codes_stay_distinct(spark):
    from riskframe.functions.text import normalize_code
    df = spark.createDataFrame([("100000",), ("1000001",), ("10000012",), (" 42",), (None,)], "c string")
    assert [r[0] for r in df.select(normalize_code("c")).collect()] == ["100000", "1000001", "10000012", "000042", None]


def test_nan_area_is_no_fire(spark):
    from riskframe.operators.relational import occurrence_label
    df = spark.createDataFrame([("nan",), ("0",), ("1.5",), (None,), ("x",)], "haforestal string")
    assert [r.ocurrencia for r in occurrence_label(df).collect()] == [0, 0, 1, 0, 0]
    num = spark.createDataFrame([(float("nan"),), (2.0,)], "haforestal double")
    assert [r.ocurrencia for r in occurrence_label(num).collect()] == [0, 1]


def test_splits_keep_every_row_once_on_ties_nulls_and_negative_keys(spark):
    def sizes(df):
        got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
        return got.get("train", 0), got.get("test", 0)
    tied = spark.createDataFrame([(1, i % 5) for i in range(10)], "k long, v long")  # one key, five rows twice
    assert sizes(smp.split_random(tied, ["k"], 0.5, 7)) == (5, 5)
    assert sizes(smp.split_ordered(tied, F.col("k"), 0.7)) == (7, 3)
    out = smp.split_ordered(tied, F.col("k"), 0.3)
    assert sorted(r.v for r in out.collect()) == sorted(r.v for r in tied.collect())
    copies = spark.createDataFrame([(1,)] * 10, "k long")
    assert sizes(smp.split_ordered(copies, F.col("k"), 0.3)) == (3, 7)
    nulls = spark.createDataFrame([(i if i else None,) for i in range(10)], "k long")
    assert sizes(smp.split_random(nulls, ["k"], 0.8, 7)) == (8, 2)
    old = smp.split_ordered(spark.range(-10, 0).toDF("k"), F.col("k"), 0.8)
    assert sorted(r.k for r in old.where("split = 'train'").collect()) == list(range(-10, -2))
    with pytest.raises(ValueError):
        smp.split_ordered(nulls, F.col("k"), 0.8)
    assert sizes(smp.split_random(tied.limit(0), ["k"], 0.8, 7)) == (0, 0)


def test_nearest_station_across_the_180th_meridian(spark):
    pts = spark.createDataFrame([("p", 0.0, 179.9), ("q", 10.0, -179.99), ("r", 0.0, 0.1), ("s", 89.9, 5.0)],
                                "pid string, latitud double, longitud double")
    st = spark.createDataFrame([(1, 0.0, 179.65), (2, 0.0, -179.95), (3, 10.0, 179.8), (4, 89.95, -175.0)],
                               "sid long, latitud double, longitud double")
    got = {r.pid: r.sid for r in nearest_station(pts, st, point_key="pid", station_key="sid").collect()}
    assert got == {"p": 2, "q": 3, "r": 4, "s": 4}


def test_depth_beyond_the_limit_is_an_error():
    from riskframe.operators import models
    with pytest.raises(ValueError):
        models.decision_tree(max_depth=50)


def test_zone_total_reaches_every_station_of_the_zone_once(spark):
    from riskframe.plans import jobs
    munis = spark.createDataFrame([("a", 7), ("b", 7), ("c", 7)], "codigo_municipio string, zona long")
    bridge = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "codigo_municipio string, indicativo long")
    mob = spark.createDataFrame([("d", 7, 15.0, 3.0)], "fecha string, destino long, total_viajes double, total_viajes_km double")
    out = jobs.mobility_per_station_day(mob, jobs.zone_stations(munis, bridge)).collect()
    assert sorted((r.indicativo, r.total_viajes_estacion) for r in out) == [(1, 15.0), (2, 15.0)]

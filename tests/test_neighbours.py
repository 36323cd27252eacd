"""Neighbours by pivot partitions against every pair."""

from collections import defaultdict

import numpy as np

from riskframe.operators.pivots import knn_pivots, knn_with_work

NAMES = [f"f{j}" for j in range(10)]


def frame(spark, x, keys=None):
    rows = [(int(k), *(None if np.isnan(v) else float(v) for v in r)) for k, r in zip(range(len(x)) if keys is None else keys, x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in NAMES[: x.shape[1]]))


def ranks(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r.id].append((r.nn_rank, r.nn_key, round(r.nn_dist, 9)))
    return {i: [(key, dist) for _, key, dist in sorted(v)] for i, v in by.items()}


def every_pair(x, k, keys):
    out = {}
    for i, key in enumerate(keys):
        dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[key] = [(int(n), round(float(d), 9)) for d, n in sorted((dist[j], keys[j]) for j in range(len(x)) if j != i)][:k]
    return out


def clusters(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, 10)) * 3
    return centre[rng.integers(0, 25, n)] + rng.normal(size=(n, 10)) * 0.4


def test_neighbours_in_ten_dimensions_equal_every_pair(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 10)), clusters(150), np.repeat(rng.normal(size=(1, 10)), 60, axis=0), np.round(rng.normal(size=(80, 10)))])
    keys = [int(v) for v in rng.permutation(len(x))]
    for crowd, fanout in ((10, 3), (160, 16)):
        assert ranks(knn_pivots(frame(spark, x, keys), "id", NAMES, 5, crowd, fanout)) == every_pair(x, 5, keys)


def test_neighbours_of_odd_tables(spark):
    x = np.array([[1.0, 2.0], [1.0, 2.0], [4.0, 6.0], [np.nan, 1.0]])
    got = ranks(knn_pivots(frame(spark, x), "id", NAMES[:2], 5))
    assert got == {0: [(1, 0.0), (2, 5.0)], 1: [(0, 0.0), (2, 5.0)], 2: [(0, 5.0), (1, 5.0)]}
    assert knn_pivots(frame(spark, x[:0]), "id", NAMES[:2], 3).count() == 0
    assert knn_pivots(frame(spark, x[:1]), "id", NAMES[:2], 3).count() == 0
    same = ranks(knn_pivots(frame(spark, np.ones((400, 3))), "id", NAMES[:3], 2, 4, 2))
    assert same[0] == [(1, 0.0), (2, 0.0)] and same[399] == [(0, 0.0), (1, 0.0)] and len(same) == 400


def correlated(n):
    """Ten features that follow three causes, as weather does."""
    rng = np.random.default_rng(3)
    causes = rng.normal(size=(3, 10))
    return rng.normal(size=(n, 3)) @ causes + rng.normal(size=(n, 10)) * 0.05


def test_share_of_pairs_falls_with_the_rows(spark):
    share = []
    for n in (400, 3200):
        out, work = knn_with_work(frame(spark, correlated(n)), "id", NAMES, 5, 40, 8)
        w = work.first()
        assert w["n"] == n
        share.append(w["pairs"] / n / n)
    assert share[1] < 0.7 * share[0] and share[1] < 0.2


# --- nearest station ----------------------------------------------------------------------------

def spots(n, seed):
    """90 % of the stations in a spot of 0.01 degrees, the others all over the globe."""
    rng = np.random.default_rng(seed)
    crowd = int(0.9 * n)
    lat = np.concatenate([41.3 + rng.random(crowd) * 0.01, rng.uniform(-90, 90, n - crowd)])
    lon = np.concatenate([2.1 + rng.random(crowd) * 0.01, rng.uniform(-180, 180, n - crowd)])
    return lat, lon


def arc(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * np.arcsin(np.minimum(1, np.sqrt(h)))


def places(spark, lat, lon, name):
    return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(zip(lat, lon))], f"{name} long, lat double, lon double")


def test_quadtree_is_exact_and_bounded_on_a_crowded_spot(spark):
    from riskframe.operators.quadtree import leaves_in_reach, nearest_by_tree, station_tree
    rng = np.random.default_rng(4)
    a, b = spots(300, 5)
    c, d = rng.uniform(-90, 90, 100), rng.uniform(-180, 180, 100)
    plat, plon = np.concatenate([a[:200] + 1e-4, c, [90.0, -90.0, 0.0, 0.0]]), np.concatenate([b[:200] + 1e-4, d, [0.0, 7.0, 180.0, -180.0]])
    points = places(spark, plat, plon, "pid")
    work = []
    for n in (2000, 16000):
        lat, lon = spots(n, 6)
        lat[-1], lon[-1] = lat[0], lon[0]  # a second station at one place
        got = {r.pid: (r.best.key, r.best.dist) for r in nearest_by_tree(points, places(spark, lat, lon, "key")).collect()}
        assert len(got) == len(plat)
        for i, (y, x) in enumerate(zip(plat, plon)):
            dist = arc(y, x, lat, lon)
            assert got[i][1] <= dist.min() + 1e-6 and dist[got[i][0]] <= dist.min() + 1e-6 and got[i][0] != n - 1
        placed, cells = station_tree(places(spark, lat, lon, "key"), 16)
        leaves = cells.where("leaf")
        assert leaves.agg({"n": "max"}).first()[0] <= 16 and leaves.agg({"n": "sum"}).first()[0] == n - 1
        seen = leaves_in_reach(points, cells).join(leaves.select("level", "cell", "n"), ["level", "cell"])
        work.append(seen.agg({"n": "sum"}).first()[0] / len(plat))
    assert max(work) < 160 and work[1] < 2.5 * work[0]  # stations looked at by a point, of 2,000 and 16,000


def test_quadtree_of_odd_tables(spark):
    from riskframe.operators.nearest import nearest_station
    near = lambda p, s: {r.pid: r.sid for r in nearest_station(p, s, point_key="pid", station_key="sid", point_lat="lat", point_lon="lon", station_lat="lat", station_lon="lon").collect()}
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, None, 1.0), (3, 0.0, 181.0)], "pid long, lat double, lon double")
    none = spark.createDataFrame([], "sid long, lat double, lon double")
    assert near(pts, none) == {1: None, 2: None, 3: None} and near(pts.limit(0), none) == {}
    one = spark.createDataFrame([(7, 0.0, -179.0), (8, None, 2.0), (5, 0.0, -179.0)], "sid long, lat double, lon double")
    assert near(pts, one) == {1: 5, 2: None, 3: 5}
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(40)], "sid long, lat double, lon double")
    assert near(pts, same) == {1: 0, 2: None, 3: 0}


def test_quadtree_work_of_a_task_does_not_grow_with_the_points(spark, monkeypatch):
    from pyspark.sql import functions as F
    from riskframe.operators import quadtree
    monkeypatch.setattr(quadtree, "PART_ROWS", 50)
    rng = np.random.default_rng(8)
    _, cells = quadtree.station_tree(places(spark, rng.uniform(40, 43, 300), rng.uniform(0, 3, 300), "key"), 16)
    for n in (200, 1600):
        seen = quadtree.leaves_in_reach(places(spark, rng.uniform(40, 43, n), rng.uniform(0, 3, n), "pid"), cells)
        assert seen.select("pid").distinct().count() == n
        most = seen.groupBy(F.spark_partition_id()).agg(F.countDistinct("pid").alias("points")).agg({"points": "max"}).first()[0]
        assert most <= 150  # all points were in one task before

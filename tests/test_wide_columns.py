"""Wide correlations, columns to drop, the four subsets in one scan, class weights inside a grid."""

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from riskframe.operators import features, models, stats


def test_gram_correlation_equals_numpy_over_the_rows_that_have_both(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1.0, (400, 12))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, 400)
    x[:, 2] = 7.0
    gone = rng.random(x.shape) < 0.1
    names = [f"v.{i}" for i in range(12)]
    rows = [tuple(None if gone[r, c] else float(x[r, c]) for c in range(12)) for r in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(3)
    got = {(r.var_a, r.var_b): r["corr"] for r in stats.gram_correlation(df, names).collect()}
    assert len(got) == 144
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~gone[:, i] & ~gone[:, j]
            if 2 in (i, j):
                assert got[a, b] is None
            else:
                assert math.isclose(got[a, b], np.corrcoef(x[both, i], x[both, j])[0, 1], abs_tol=1e-9)
    empty = stats.gram_correlation(df.limit(0), names)
    assert {r["corr"] for r in empty.collect()} <= {None}


def test_drops_cover_all_strong_pairs(spark):
    pairs = [("a", "b"), ("b", "c"), ("b", "d"), ("e", "f"), ("c", "d")]
    rows = [(x, y, 0.9) for x, y in pairs] + [(y, x, 0.9) for x, y in pairs] + [("a", "f", 0.1), ("a", "a", 1.0)]
    corr = spark.createDataFrame(rows, "var_a string, var_b string, corr double")
    got = sorted(tuple(r) for r in stats.correlated_drops(corr, 0.8).collect())
    assert got == [(1, "b", 3), (2, "c", 1), (3, "e", 1)]
    assert stats.correlated_drops(corr, 0.95).count() == 0


def test_subset_rows(spark):
    rows = [("2020-01-01", 1, 5.0), ("2020-01-01", 1, 5.0), ("2020-02-01", 2, None), ("2021-01-01", None, 1.0), ("2021-01-01", 3, 2.0)]
    df = spark.createDataFrame(rows, "fecha string, v int, trips double").selectExpr("CAST(fecha AS DATE) AS fecha", "v", "trips")
    got = sorted((r.subset, r.v, r.trips) for r in features.subset_rows(df, "fecha", ("2020-01-01", "2020-12-31"), ["trips"]).collect())
    assert got == [("all", 1, 5.0), ("all", 3, 2.0), ("sin_movilidad", 1, None), ("sin_movilidad", 2, None), ("sin_movilidad", 3, None),
                   ("ventana", 1, 5.0), ("ventana_sin_movilidad", 1, None), ("ventana_sin_movilidad", 2, None)]


def test_class_weight_is_searched_with_the_depth(spark):
    # one value of x holds one positive in four: only a weight above 3 makes the tree call it positive
    rows = [(i, float(i % 2), 1.0 if i % 8 == 0 else 0.0) for i in range(160)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "id long, x double, ocurrencia double"))
    df = models.with_folds(df, ["id"], 2)
    stages = Pipeline(stages=[models.ClassWeighter(), models.decision_tree(weight="weight", min_leaf=1)])
    called = lambda w: stages.copy({stages.getStages()[0].positiveWeight: w}).fit(df).transform(df).where("prediction = 1").count()
    assert called(1.0) == 0 and called(10.0) == 80
    fit = models.grid_search(stages, {"positiveWeight": [1.0, 10.0], "maxDepth": [1]}, folds=2, fold_col="fold").fit(df)
    scores = {r.params["positiveWeight"]: r.metric for r in models.grid_scores(spark, fit).collect()}
    assert scores[1.0] > 0.8 > scores[10.0] > 0.5

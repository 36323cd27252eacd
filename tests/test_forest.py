"""Random forest (D2): the registered sizes, one tree against a plain search, the same trees however they are grown."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from riskframe.operators import forest as fo
from riskframe.operators import models as md
from riskframe.plans import q_learn as q


def _frame(spark, n=3000, seed=3, noise=0.2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n), rng.random(n) < 0.02, np.ones(n)])
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < noise)).astype(float)
    rows = [(i, str(i), Vectors.dense(v.tolist()), float(c), float(i % 3 + 1)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["indicativo", "fecha", "features", "ocurrencia", "w"])


def _depth(feature, child):
    depth = np.zeros(len(feature), int)
    for i in np.flatnonzero(feature != fo.LEAF):  # children follow their parents
        depth[[child[i], child[i] + 1]] = depth[i] + 1
    return depth.max()


def test_registered_forest_is_the_whole_one(spark, monkeypatch):
    df = _frame(spark, 400)
    asked, grown = [], []
    make, fit = md.random_forest, fo.RandomForest.fit
    monkeypatch.setattr(md, "random_forest", lambda **k: asked.append(k) or make(**k))
    monkeypatch.setattr(fo.RandomForest, "fit", lambda self, rows: grown.append(fit(self, rows)) or grown[-1])
    monkeypatch.setattr(q, "_prepared", lambda spark, d: (df.where("indicativo % 4 > 0"), df.where("indicativo % 4 = 0")))
    out = q.q_random_forest(spark, "").collect()
    assert asked == [{"n_trees": 1000, "max_depth": 30, "min_leaf": 10}]
    assert len(grown[0].trees()) == 1000
    assert len(out) == 100 and all(0 <= r.p1 <= 1 and r.prediction == (r.p1 > 0.5) for r in out if r.p1 != 0.5)


def test_trees_go_deeper_than_ten_levels_and_learn(spark):
    df = _frame(spark)
    train, test = df.where("indicativo % 4 > 0"), df.where("indicativo % 4 = 0")
    model = md.random_forest(n_trees=40, min_leaf=2).fit(train)
    assert 10 < max(_depth(f, ch) for f, _, ch, _ in model.trees()) <= 30
    model = md.random_forest(n_trees=40, max_depth=3, min_leaf=2).fit(train)
    assert max(_depth(f, ch) for f, _, ch, _ in model.trees()) == 3
    good = md.random_forest(n_trees=40).fit(train).transform(test).selectExpr("avg(cast(prediction = ocurrencia as double))").first()[0]
    assert good > 0.72  # 0.8 at best, 0.5 by chance


def test_trees_are_the_same_grown_whole_or_in_parts(spark):
    df = _frame(spark, 900)
    for weight, limits in ((None, {"node_bytes": 2000, "pass_bytes": 15_000, "hist_bytes": 20_000}), ("w", {"node_bytes": 6000, "pass_bytes": 200_000})):
        size = ("features", "ocurrencia", weight, 5, 12, 5, 7)
        whole, parts = fo.RandomForest(*size).fit(df), fo.RandomForest(*size, whole_bytes=0, **limits).fit(df)
        p = [{r.indicativo: r.p1 for r in md.positive_probability(out).select("indicativo", "p1").collect()}
             for out in (whole.transform(df), parts.transform(df), parts.transform(df, group_bytes=1))]
        assert len(p[0]) == 900 and p[1] == pytest.approx(p[0], abs=1e-9) and p[2] == pytest.approx(p[1], abs=1e-12)
        assert len(parts.spark.read.parquet(parts.path).where("node > 0").collect()) > 8  # trees were grown below upper nodes


def test_first_split_and_leaves_against_a_plain_search():
    rng = np.random.default_rng(5)
    n, width = 400, 6
    x, y = rng.integers(0, width, (n, 3)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8)
    many = fo.copies(np.arange(n, dtype=np.uint64), 1, 0)
    spec = fo.Spec(3, 2, width, 3, 30, 7, False, 1)
    tree = fo.grow(spec, x.ravel(), y, many, None, fo._root(1, 0), 0)
    gini = lambda m: 1 - sum((many[m & (y == c)].sum() / many[m].sum()) ** 2 for c in (0, 1))
    tried = {}
    for f in range(3):
        for cut in range(width - 1):
            left = x[:, f] <= cut
            a, b = int(many[left].sum()), int(many[~left].sum())
            if min(a, b) >= 7:
                tried[f, cut] = gini(many > 0) - (a * gini(left) + b * gini(~left)) / (a + b)
    tree.flat()
    feature, cut, child, sums = tree.feature[0], tree.cut[0], tree.child[0], tree.sums[0]
    assert tried[feature[0], cut[0]] == pytest.approx(max(tried.values()))
    assert sums[feature == fo.LEAF].sum() == many.sum() and sums[feature == fo.LEAF].sum(axis=1).min() >= 7
    rows, ends = fo._fall(x.ravel(), 3, np.arange(n), feature, cut, child)
    got = np.zeros_like(sums)
    np.add.at(got, (ends, y[rows]), many[rows])
    assert (got[feature == fo.LEAF] == sums[feature == fo.LEAF]).all()


def test_copies_of_a_row_are_poisson_and_differ_by_tree():
    ids = np.arange(200_000, dtype=np.uint64)
    a, b = fo.copies(ids, 123, 0).astype(float), fo.copies(ids, 123, 1).astype(float)
    assert a.mean() == pytest.approx(1, abs=0.02) and a.var() == pytest.approx(1, abs=0.03) and abs(np.corrcoef(a, b)[0, 1]) < 0.01


def test_values_that_are_no_numbers_and_wrong_classes(spark):
    rows = [(i, Vectors.dense([float("nan") if i % 2 else 1.0, float(i % 5)]), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "features", "ocurrencia"])
    out = md.random_forest(n_trees=20).fit(df).transform(df)
    assert out.where("prediction = ocurrencia").count() == 200  # NaN is a value of its own, above all
    for bad in (-1.0, 0.5, float("nan")):
        with pytest.raises(ValueError):
            md.random_forest(n_trees=1).fit(df.selectExpr("features", f"double('{bad}') as ocurrencia"))
    with pytest.raises(ValueError):
        md.random_forest(n_trees=1).fit(df.where("id < 0"))

"""Boosting on binned features against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import histtrees as ht


def table(spark, x, y):
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = [(*(None if np.isnan(v) else float(v) for v in r), None if t is None else int(t)) for r, t in zip(x, y)]
    return names, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y int")


def bins_plainly(x, cuts):
    return np.array([[0 if np.isnan(v) else sum(c < v for c in at) for v, at in zip(r, cuts)] for r in x])


def tree_plainly(b, g, h, rows, depth, node=1):
    """{node: (feature, bin) or leaf weight}."""
    total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-12, None)
    for f in range(b.shape[1]):
        for cut in sorted(set(b[rows, f]))[:-1]:
            left = rows[b[rows, f] <= cut]
            lg, lh = g[left].sum(), h[left].sum()
            if lh < 1 or total_h - lh < 1:
                continue
            gain = 0.5 * (lg ** 2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g ** 2 / (total_h + 1))
            if gain > best[0] * (1 + 1e-12) + 1e-12:
                best = (gain, (f, cut))
    if not depth or best[1] is None:
        return {node: -total_g / (total_h + 1)}
    f, cut = best[1]
    low = b[rows, f] <= cut
    return {node: best[1]} | tree_plainly(b, g, h, rows[low], depth - 1, 2 * node) | tree_plainly(b, g, h, rows[~low], depth - 1, 2 * node + 1)


def leaf_of(tree, row):
    i = 1
    while isinstance(tree[i], tuple):
        f, cut = tree[i]
        i = 2 * i if row[f] <= cut else 2 * i + 1
    return tree[i]


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[::17, 2] = np.nan
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(int)  # neither of the two tells alone
    return x, y


def test_bins_count_the_cuts_below(spark):
    x, y = data()
    names, df = table(spark, x, y)
    for cuts in (ht.width_cuts(df, names, 8), ht.quantile_cuts(df, names, 8)):
        assert [len(c) <= 7 and c == sorted(c) for c in cuts] == [True] * 4
        got = [r.bins for r in ht.binned(df, names, cuts).collect()]
        assert np.array_equal(got, bins_plainly(x, cuts))
    assert ht.width_cuts(df.withColumn("f0", F.lit(1.0)).withColumn("f1", F.lit(None).cast("double")), names[:2]) == [[], []]


def test_boosted_trees_equal_a_plain_version_and_learn(spark):
    x, y = data()
    names, df = table(spark, np.concatenate([x, x[:3]]), [*y, None, None, None])
    cuts = ht.width_cuts(df, names, 8)
    rows = ht.binned(df, names, cuts)
    model = ht.boost_trees(rows, "y", rounds=8, depth=3, rate=0.3, write_every=3)
    b, m, losses = bins_plainly(x, cuts), np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    for tree in model.trees:
        p = 1 / (1 + np.exp(-m))
        losses.append(float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))))
        plain = tree_plainly(b, p - y, p * (1 - p), np.arange(len(y)), 3)
        assert {i: (n.feature, n.bin) if n.feature is not None else round(n.weight, 9) for i, n in tree.items()} == {i: v if isinstance(v, tuple) else round(float(v), 9) for i, v in plain.items()}
        m = m + 0.3 * np.array([leaf_of(plain, r) for r in b])
    assert np.allclose(losses, model.losses) and all(after < before for before, after in zip(losses, losses[1:]))
    got = [r.p1 for r in ht.boosted_probability(model, rows.where("y is not null")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-m))) and ((np.array(got) > 0.5) == y).mean() > 0.75
    assert ht.split_table(spark, model, names).count() == sum(map(len, model.trees))
    assert ht.boost_trees(rows.limit(0), "y", rounds=2).trees == []


def stumps_plainly(b, y, rounds, rate):
    w, out = np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        best = ((w[y == 0].sum() ** 2 + w[y == 1].sum() ** 2), None)
        for f in range(b.shape[1]):
            for cut in sorted(set(b[:, f]))[:-1]:
                low = b[:, f] <= cut
                (l0, l1), (r0, r1) = ((w[s & (y == 0)].sum(), w[s & (y == 1)].sum()) for s in (low, ~low))
                score = (l0 ** 2 + l1 ** 2) / (l0 + l1) + (r0 ** 2 + r1 ** 2) / (r0 + r1)
                if score > best[0] * (1 + 1e-12):
                    best = (score, (f, cut, int(l1 > l0), int(r1 > r0)))
        f, cut, left, right = best[1]
        miss = np.where(b[:, f] <= cut, left, right) != y
        error = w[miss].sum()
        out.append((f, cut, left, right, round(float(error), 9)))
        w = w * np.exp(rate * math.log((1 - error) / error) * miss)
        w = w / w.sum()
    return out


def test_stumps_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 2)
    y = (x[:, 0] + 0.7 * x[:, 1] - 0.5 * x[:, 2] + rng.normal(size=300) * 0.4 > 0.3).astype(int)
    names, df = table(spark, x, y)
    cuts = ht.quantile_cuts(df, names, 10)
    rows = ht.binned(df, names, cuts)
    found = ht.boost_stumps(rows, "y", rounds=25, rate=0.5, write_every=4)
    assert [(s.feature, s.bin, s.left, s.right, round(s.error, 9)) for s in found] == stumps_plainly(bins_plainly(x, cuts), y, 25, 0.5)
    scored = ht.stump_score(found, rows).collect()
    assert np.mean([r.prediction == r.y for r in scored]) > 0.85


def test_stumps_of_odd_tables(spark):
    names, df = table(spark, np.ones((6, 2)), [0, 1, 0, 1, 0, 1])
    rows = ht.binned(df, names, ht.width_cuts(df, names))
    with pytest.raises(ValueError):
        ht.boost_stumps(rows, "y", rounds=3)
    assert ht.boost_stumps(rows.limit(0), "y", rounds=3) == []
    names, df = table(spark, np.array([[1.0], [2.0], [3.0]]), [0, 0, 1])
    only = ht.boost_stumps(ht.binned(df, names, ht.width_cuts(df, names)), "y", rounds=9)
    assert len(only) == 1 and (only[0].left, only[0].right) == (0, 1)

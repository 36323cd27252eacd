"""Boosting on binned features: second-order trees (D5) and AdaBoost stumps.

Features are cut into bins once.  Whatever a split needs to know is then one
grouped aggregate over (node, feature, bin), combined before the shuffle: as
many rows as there are nodes, features and bins reach the driver, however many
rows are trained on.  Where a row stands in the trees so far is an expression
over its bins, so levels and rounds read the binned table again and write
nothing but, every few rounds, the margin; a lost executor costs a re-read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- bins

def width_cuts(df: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """Cuts at equal widths between each feature's extremes: the b-th is lo + (hi - lo) * b / bins."""
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(features)], *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(features)]).first()
    span = lambda i: (r[f"lo{i}"], r[f"hi{i}"])
    return [[] if lo is None or lo == hi else [lo + (hi - lo) * b / bins for b in range(1, bins)] for lo, hi in map(span, range(len(features)))]


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = 32, accuracy: int = 10_000) -> list[list[float]]:
    """Cuts at the approximate quantiles (rank error 1 / accuracy; a sketch of bounded size), each value once."""
    ps = [b / bins for b in range(1, bins)]
    r = df.agg(*[F.percentile_approx(F.col(c).cast("double"), ps, accuracy).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(r[f"q{i}"] or [])) for i in range(len(features))]


def binned(df: DataFrame, features: Sequence[str], cuts: list[list[float]], out: str = "bins") -> DataFrame:
    """Adds the bins: of each feature the number of cuts below its value; null, and NaN, is bin 0."""
    def place(c: str, at: list[float]) -> Column:
        v = F.col(c).cast("double")
        below = F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x < v)) if at else F.lit(0)
        return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(below).cast("int")
    return df.withColumn(out, F.array(*[place(c, at) for c, at in zip(features, cuts)]))


# ---------------------------------------------------------------- second-order trees

class Node(NamedTuple):
    """A split (rows of bin <= ``bin`` go left) or, where ``feature`` is None, a leaf with its weight."""
    feature: int | None
    bin: int
    weight: float
    gain: float


class Boosted(NamedTuple):
    base: float
    rate: float
    trees: list[dict[int, Node]]  # node 1 is the root, 2 i and 2 i + 1 are the children of i
    losses: list[float]  # mean log loss on the training rows before each round


def node_of(tree: dict[int, Node], bins: str = "bins") -> Column:
    """The node that a row stands in, in a tree that may still be growing."""
    def at(i: int) -> Column:
        n = tree.get(i)
        if n is None or n.feature is None:
            return F.lit(i)
        return F.when(F.col(bins)[n.feature] <= n.bin, at(2 * i)).otherwise(at(2 * i + 1))
    return at(1)


def tree_value(tree: dict[int, Node], bins: str = "bins") -> Column:
    """The weight of the leaf that a row ends in."""
    def at(i: int) -> Column:
        n = tree[i]
        return F.lit(n.weight) if n.feature is None else F.when(F.col(bins)[n.feature] <= n.bin, at(2 * i)).otherwise(at(2 * i + 1))
    return at(1)


def node_histograms(rows: DataFrame, node: Column, live: Sequence[int], bins: str = "bins") -> DataFrame:
    """node, feature, bin, n, g, h: rows, gradients and hessians of the live nodes, in one aggregate.
    rows: ``bins``, g, h."""
    seen = rows.withColumn("node", node).where(F.col("node").isin(list(live)))
    return seen.select("node", "g", "h", F.posexplode(bins).alias("feature", "bin")).groupBy("node", "feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_split(cells: list[tuple], l2: float, min_hessian: float) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, sum of g, sum of h) of one node; cells: (feature, bin, g, h).
    Of equal gains (to 12 digits) the smallest feature, then the smallest bin."""
    by: dict[int, list[tuple]] = {}
    for f, b, g, h in cells:
        by.setdefault(f, []).append((b, g, h))
    one = next(iter(by.values()))
    total_g, total_h = math.fsum(g for _, g, _ in one), math.fsum(h for _, _, h in one)
    best = (0.0, -1, -1)
    for f in sorted(by):
        left_g = left_h = 0.0
        for b, g, h in sorted(by[f])[:-1]:
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = total_g - left_g, total_h - left_h
            if left_h < min_hessian or right_h < min_hessian:
                continue
            gain = 0.5 * (left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2) - total_g ** 2 / (total_h + l2))
            if gain > best[0] * (1 + 1e-12) + 1e-12:
                best = (gain, f, b)
    return (*best, total_g, total_h)


def grow_tree(rows: DataFrame, depth: int, l2: float, min_gain: float, min_hessian: float) -> dict[int, Node]:
    """One tree, a level at a time: one aggregate a level, at most 2^level x features x bins numbers of it here."""
    tree: dict[int, Node] = {}
    live = [1]
    for level in range(depth + 1):
        cells: dict[int, list[tuple]] = {i: [] for i in live}
        for r in node_histograms(rows, node_of(tree), live).collect():
            cells[r["node"]].append((r["feature"], r["bin"], r["g"], r["h"]))
        nxt = []
        for i in live:
            if not cells[i]:
                tree[i] = Node(None, 0, 0.0, 0.0)
                continue
            gain, f, b, g, h = best_split(cells[i], l2, min_hessian)
            if level < depth and f >= 0 and gain > min_gain:
                tree[i] = Node(f, b, 0.0, gain)
                nxt += [2 * i, 2 * i + 1]
            else:
                tree[i] = Node(None, 0, -g / (h + l2) if h + l2 > 0 else 0.0, 0.0)
        live = nxt
        if not live:
            break
    return tree


def boost_trees(train: DataFrame, label: str, rounds: int = 100, depth: int = 6, rate: float = 0.3, l2: float = 1.0, min_gain: float = 0.0,
                min_hessian: float = 1.0, weight: str | None = None, write_every: int = 5) -> Boosted:
    """Trees on the first and second derivatives of the log loss, leaf weights -G / (H + l2).

    train: ``bins`` (:func:`binned`) and a 0/1 label; rows without a label take no part.  The
    margin is written every ``write_every`` rounds, between that it is an expression of the new trees."""
    from ..sources.files import materialize

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.where(F.col(label).isNotNull()).select("bins", F.col(label).cast("double").alias("y"), w.alias("w"))
    share = rows.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p")).first()["p"]
    if share is None:
        return Boosted(0.0, rate, [], [])
    share = min(max(share, 1e-6), 1 - 1e-6)
    out = Boosted(math.log(share / (1 - share)), rate, [], [])
    at = materialize(rows.withColumn("m", F.lit(out.base)), "boost-margin")
    new: list[dict[int, Node]] = []
    for r in range(rounds):
        m = F.col("m") + sum((F.lit(rate) * tree_value(t) for t in new), F.lit(0.0))
        p = F.lit(1.0) / (1 + F.exp(-F.col("m")))
        now = at.withColumn("m", m).withColumn("p", p)
        loss = -(F.col("y") * F.log(F.greatest("p", F.lit(1e-15))) + (1 - F.col("y")) * F.log(F.greatest(1 - F.col("p"), F.lit(1e-15))))
        out.losses.append(now.agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("l")).first()["l"])
        if len(new) >= write_every:
            at, new = materialize(now.select("bins", "y", "w", "m"), "boost-margin"), []
            now = at.withColumn("p", p)
        tree = grow_tree(now.select("bins", (F.col("w") * (F.col("p") - F.col("y"))).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h")), depth, l2, min_gain, min_hessian)
        out.trees.append(tree)
        new.append(tree)
    return out


def boosted_probability(model: Boosted, df: DataFrame, out: str = "p1") -> DataFrame:
    """Adds the probability of label 1 to rows with ``bins``."""
    m = F.lit(model.base) + sum((F.lit(model.rate) * tree_value(t) for t in model.trees), F.lit(0.0))
    return df.withColumn(out, F.lit(1.0) / (1 + F.exp(-m)))


def split_table(spark, model: Boosted, features: Sequence[str]) -> DataFrame:
    """round, node, feature (null for a leaf), bin, gain, weight of every node."""
    rows = [(r + 1, i, None if n.feature is None else features[n.feature], None if n.feature is None else n.bin, n.gain, n.weight) for r, t in enumerate(model.trees) for i, n in sorted(t.items())]
    return spark.createDataFrame(rows, "round int, node int, feature string, bin int, gain double, weight double")


# ---------------------------------------------------------------- AdaBoost stumps

class Stump(NamedTuple):
    """Rows of bin <= ``bin`` are given the label ``left``, the others ``right``."""
    feature: int
    bin: int
    left: int
    right: int
    error: float
    alpha: float


def stump_label(s: Stump, bins: str = "bins") -> Column:
    return F.when(F.col(bins)[s.feature] <= s.bin, F.lit(s.left)).otherwise(F.lit(s.right))


def best_stump(cells: list[tuple]) -> tuple[int, int, int, int, float]:
    """(feature, bin, left, right, error) of the split with the least Gini impurity; cells: (feature,
    bin, weight of label 0, of label 1), all weights together 1.  Of equal impurities (to 12 digits)
    the smallest feature, then the smallest bin.  Without a split: one side only."""
    by: dict[int, list[tuple]] = {}
    for f, b, w0, w1 in cells:
        by.setdefault(f, []).append((b, w0, w1))
    one = by[min(by)]
    all0, all1 = math.fsum(w for _, w, _ in one), math.fsum(w for _, _, w in one)
    top = 1 if all1 > all0 else 0
    best, found = (all0 ** 2 + all1 ** 2) / (all0 + all1), (0, max(b for b, _, _ in one), top, top, all0 if top else all1)
    for f in sorted(by):
        w0 = w1 = 0.0
        for b, x0, x1 in sorted(by[f])[:-1]:
            w0, w1 = w0 + x0, w1 + x1
            r0, r1 = all0 - w0, all1 - w1
            if w0 + w1 <= 0 or r0 + r1 <= 0:
                continue
            score = (w0 ** 2 + w1 ** 2) / (w0 + w1) + (r0 ** 2 + r1 ** 2) / (r0 + r1)
            if score > best * (1 + 1e-12):
                left, right = int(w1 > w0), int(r1 > r0)
                best, found = score, (f, b, left, right, (w0 if left else w1) + (r0 if right else r1))
    return found


def boost_stumps(train: DataFrame, label: str, rounds: int = 1000, rate: float = 0.1, weight: str | None = None, write_every: int = 20) -> list[Stump]:
    """SAMME over stumps; a round is one weighted aggregate over (feature, bin).

    train: ``bins`` and a 0/1 label.  Weights are exp(exponent): the exponent is written every
    ``write_every`` rounds, between that it is an expression of the new stumps.  It ends early when a
    stump is no better than chance, or is right everywhere; a first one at chance is an error."""
    from ..sources.files import materialize

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.where(F.col(label).isNotNull()).select("bins", F.col(label).cast("int").alias("y"), w.alias("w"), F.lit(0.0).alias("x"))
    at, new, out = materialize(rows, "stump-weights"), [], []
    for _ in range(rounds):
        x = F.col("x") + sum((F.lit(s.alpha) * (stump_label(s) != F.col("y")).cast("double") for s in new), F.lit(0.0))
        now = at.withColumn("x", x)
        if len(new) >= write_every:
            at, new = materialize(now, "stump-weights"), []
            now = at
        v = F.col("w") * F.exp("x")
        got = now.select("y", v.alias("v"), F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
            F.sum(F.when(F.col("y") == 0, F.col("v")).otherwise(0.0)).alias("w0"), F.sum(F.when(F.col("y") == 1, F.col("v")).otherwise(0.0)).alias("w1")).collect()
        if not got:
            return out
        first = min(r["feature"] for r in got)
        total = math.fsum(r["w0"] + r["w1"] for r in got if r["feature"] == first)
        f, b, left, right, error = best_stump([(r["feature"], r["bin"], r["w0"] / total, r["w1"] / total) for r in got])
        if error >= 0.5:
            if not out:
                raise ValueError(f"the first stump has a weighted error of {error:.3f}: nothing to boost")
            break
        error = max(error, 1e-12)
        s = Stump(f, b, left, right, error, rate * math.log((1 - error) / error))
        out.append(s)
        new.append(s)
        if error <= 1e-12:
            break
    return out


def stump_score(stumps: Sequence[Stump], df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the weighted vote sum(alpha * (+1 / -1)) and prediction, 1 where it is above 0."""
    vote = sum((F.lit(s.alpha) * (2 * stump_label(s) - 1).cast("double") for s in stumps), F.lit(0.0))
    return df.withColumn(out, vote).withColumn("prediction", (F.col(out) > 0).cast("double"))

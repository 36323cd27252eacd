"""Distributed classifiers (D1–D9) on MLlib.

Trees, boosted trees and the perceptron are MLlib estimators, the forest (D2)
is that of ``forest``; the balanced forest (D3) and AdaBoost (D4) are loops of
MLlib fits over hash-seeded samples / weight columns, with lineage cut by
``checkpoint()`` into the cluster's checkpoint folder.  MLlib grows trees to a
depth of 30 at most; a larger ``max_depth`` is an error (stated in the README).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .forest import RandomForest
from .sampling import first_n, hash_key

MAX_DEPTH = 30  # fixed value: MLlib's limit


def _depth(max_depth: int) -> int:
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth is {max_depth}; MLlib grows trees to a depth of {MAX_DEPTH} at most")
    return max_depth


def decision_tree(features: str = "features", label: str = "ocurrencia", weight: str | None = None,
                  max_depth: int = 10, min_leaf: int = 5, impurity: str = "entropy", seed: int = 123):
    """D1 (+D9 class weights through ``weight``)."""
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, impurity=impurity,
                                maxDepth=_depth(max_depth), minInstancesPerNode=min_leaf, seed=seed)
    return dt.setWeightCol(weight) if weight else dt


def random_forest(features: str = "features", label: str = "ocurrencia", weight: str | None = None,
                  n_trees: int = 1000, max_depth: int = 30, min_leaf: int = 10, seed: int = 123):
    """D2; the sizes are the reference's."""
    return RandomForest(features, label, weight, n_trees=n_trees, max_depth=_depth(max_depth), min_leaf=min_leaf, seed=seed)


def gbt(features: str = "features", label: str = "ocurrencia", max_iter: int = 50, max_depth: int = 5,
        step: float = 0.1, seed: int = 123):
    """Binary logistic-loss boosted trees."""
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter,
                         maxDepth=_depth(max_depth), stepSize=step, lossType="logistic", seed=seed)


def mlp(n_features: int, features: str = "features", label: str = "ocurrencia", hidden: int = 29,
        max_iter: int = 100, seed: int = 123):
    """Feed-forward binary classifier over the assembled features."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[n_features, hidden, 2],
                                          maxIter=max_iter, seed=seed)


class ClassWeighter(Transformer):
    """D9 as a stage of a Pipeline: writes each row's weight, ``positiveWeight`` where the label is 1 and
    1 elsewhere, so that a grid search can search the class weight with the tree's own parameters."""

    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of a row whose label is 1", TypeConverters.toFloat)

    def __init__(self, label: str = "ocurrencia", out: str = "weight", positive_weight: float = 1.0):
        super().__init__()
        self.label, self.out = label, out
        self._set(positiveWeight=positive_weight)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.out, F.when(F.col(self.label) == 1, F.lit(self.getOrDefault(self.positiveWeight))).otherwise(F.lit(1.0)))


def with_folds(df: DataFrame, keys: Sequence[str], folds: int = 3, seed: int = 123, out: str = "fold") -> DataFrame:
    """A fold number per row, from a hash of its keys: the same on each run, and in SQL."""
    return df.withColumn(out, F.pmod(hash_key(keys, seed), F.lit(folds)).cast("int"))


def grid_search(estimator, grid: dict, label: str = "ocurrencia", folds: int = 3, parallelism: int = 2,
                seed: int = 123, fold_col: str | None = None, metric: str = "accuracy") -> CrossValidator:
    """K-fold cross-validated grid search on ``metric``.  The grid's names are the estimator's
    parameters, or those of the stages of a Pipeline.  Folds are drawn, or read from ``fold_col``."""
    owners = estimator.getStages() if hasattr(estimator, "getStages") else [estimator]
    b = ParamGridBuilder()
    for param, values in grid.items():
        owner = next((o for o in owners if o.hasParam(param)), None)
        if owner is None:
            raise ValueError(f"no stage has a parameter {param}")
        b = b.addGrid(owner.getParam(param), list(values))
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=b.build(), evaluator=ev, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    return cv.setFoldCol(fold_col) if fold_col else cv


def grid_scores(spark: SparkSession, model) -> DataFrame:
    """A row per point of a fitted grid search: its parameters as a map, and the mean metric."""
    rows = [({p.name: float(v) for p, v in point.items()}, float(m)) for point, m in zip(model.getEstimatorParamMaps(), model.avgMetrics)]
    return spark.createDataFrame(rows, "params map<string,double>, metric double")


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "p1") -> DataFrame:
    return df.withColumn(out, vector_to_array(prob_col)[1])


def feature_importance(spark: SparkSession, model, scored: DataFrame, features: str = "features") -> DataFrame:
    """Importances named from the assembler's attribute metadata."""
    attrs = scored.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in attrs.values():
        for a in group:
            names[a["idx"]] = a["name"]
    imp = model.featureImportances.toArray()
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


def balanced_forest(train: DataFrame, keys: Sequence[str], features: str = "features", label: str = "ocurrencia",
                    n_trees: int = 10, max_depth: int = 10, min_leaf: int = 5, seed: int = 123) -> list:
    """D3: each tree on its own balanced sample (all minority rows + an equal
    hash-chosen slice of the majority, a different seed per tree) with a
    random feature subset at each split."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(counts, key=lambda k: (counts[k], k))
    models = []
    for i in range(n_trees):
        maj = train.where(F.col(label) != minority)
        part = first_n(maj, counts[minority], hash_key(keys, seed + i))
        sample = train.where(F.col(label) == minority).unionByName(part)
        rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=1, bootstrap=True,
                                    featureSubsetStrategy="sqrt", maxDepth=_depth(max_depth),
                                    minInstancesPerNode=min_leaf, seed=seed + i)
        models.append(rf.fit(sample))
    return models


def average_probability(models: list, df: DataFrame, out: str = "p1") -> DataFrame:
    """Vote of several models by averaging their positive-class probability."""
    cols = df.columns
    cur = df
    for i, m in enumerate(models):
        m = m.copy()
        m.setProbabilityCol(f"_prob{i}").setPredictionCol(f"_pred{i}").setRawPredictionCol(f"_raw{i}")
        cur = m.transform(cur).withColumn(f"_p{i}", vector_to_array(f"_prob{i}")[1]).drop(
            f"_prob{i}", f"_pred{i}", f"_raw{i}")
    avg = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / F.lit(float(len(models)))
    return cur.select(*cols, avg.alias(out))


def adaboost(train: DataFrame, features: str = "features", label: str = "ocurrencia", n_rounds: int = 10,
             rate: float = 0.1, checkpoint_every: int = 5, seed: int = 123) -> list[tuple[object, float]]:
    """SAMME boosting of depth-1 trees.  Weights live in a column; each
    round is one fit and one weighted-error aggregate; the weighted frame is
    checkpointed every few rounds to keep the lineage short."""
    ensure_checkpoint_dir(train.sparkSession)
    n = train.count()
    cur = train.withColumn("_w", F.lit(1.0 / max(n, 1)))
    rounds: list[tuple[object, float]] = []
    for r in range(n_rounds):
        stump = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=1, weightCol="_w", seed=seed)
        m = stump.fit(cur)
        pred = m.transform(cur).withColumn("_miss", (F.col("prediction") != F.col(label)).cast("double"))
        err = pred.agg((F.sum(F.col("_w") * F.col("_miss")) / F.sum("_w")).alias("e")).first()["e"]
        err = min(max(float(err), 1e-12), 1 - 1e-12)
        if err >= 0.5:
            if not rounds:
                raise ValueError(f"the first stump has a weighted error of {err:.3f}: nothing to boost")
            break
        alpha = rate * math.log((1 - err) / err)
        rounds.append((m, alpha))
        # weights sum to 1, so the new total is (1 - err) + err * e^alpha: no extra pass
        norm = (1 - err) + err * math.exp(alpha)
        nxt = pred.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(norm))
        nxt = nxt.select(*train.columns, "_w")
        cur = nxt.checkpoint() if (r + 1) % checkpoint_every == 0 else nxt
    return rounds


def adaboost_score(rounds: list[tuple[object, float]], df: DataFrame, out: str = "score") -> DataFrame:
    """Weighted vote of the stumps: sum alpha * (+1 / -1), and its sign."""
    cols = df.columns
    cur = df
    for i, (m, a) in enumerate(rounds):
        m = m.copy()
        m.setPredictionCol(f"_h{i}").setProbabilityCol(f"_hp{i}").setRawPredictionCol(f"_hr{i}")
        cur = m.transform(cur).withColumn(f"_v{i}", F.lit(a) * (2 * F.col(f"_h{i}") - 1)).drop(
            f"_h{i}", f"_hp{i}", f"_hr{i}")
    total = sum((F.col(f"_v{i}") for i in range(len(rounds))), F.lit(0.0))
    return cur.select(*cols, total.alias(out), (total > 0).cast("double").alias("prediction"))

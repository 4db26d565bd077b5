"""Scorers: a declared linear one as an expression, and MLlib models. Networks: ``operators.networks``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numeric import sigmoid, total


@dataclass(frozen=True)
class Linear:
    """Logistic scorer over a vector or over named columns."""

    name: str
    weights: list[float]
    bias: float
    threshold: float = 0.5

    def logit(self, x: Column | Sequence[Column]) -> Column:
        at = x if isinstance(x, (list, tuple)) else [x[i] for i in range(len(self.weights))]
        return total([c * w for c, w in zip(at, self.weights)]) + self.bias

    def prob(self, x: Column | Sequence[Column]) -> Column:
        return sigmoid(self.logit(x))

    def detects(self, x: Column | Sequence[Column]) -> Column:
        return self.prob(x) >= self.threshold

    def tau(self) -> float:
        """Logit of the threshold, clamped to [1e-12, 1 - 1e-12]."""
        t = min(max(self.threshold, 1e-12), 1 - 1e-12)
        return float(np.log(t / (1 - t)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.bias - self.tau()

    def slope(self, x: np.ndarray) -> np.ndarray:
        """Gradient of the margin by the inputs."""
        return np.tile(np.array(self.weights), (len(x), 1))


# -- MLlib ------------------------------------------------------------------------------------------------------


def fit_forest(train: DataFrame, columns: Sequence[str], y_col: str, trees: int = 200, depth: int = 12, seed: int = 42):
    """Random forest, gini, sqrt features, balanced by class weights; returns a PipelineModel adding ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    weighted = _balanced(train, y_col)
    forest = RandomForestClassifier(labelCol=y_col, featuresCol="_features", weightCol="_weight", numTrees=trees, maxDepth=depth, impurity="gini", featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_features"), forest]).fit(weighted)


def top_importances(model, columns: Sequence[str], k: int) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(columns, map(float, values)), key=lambda p: (-p[1], p[0]))[:k]


def fit_tree(train: DataFrame, columns: Sequence[str], y_col: str, depth: int = 3, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    tree = DecisionTreeClassifier(labelCol=y_col, featuresCol="_features", weightCol="_weight", maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_features"), tree]).fit(_balanced(train, y_col))


def _balanced(train: DataFrame, y_col: str) -> DataFrame:
    counts = {r[0]: r[1] for r in train.groupBy(y_col).count().collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    for y, c in counts.items():
        weight = F.when(F.col(y_col) == y, n / (len(counts) * c)).otherwise(weight)
    return train.withColumn("_weight", weight)



"""Scores for events: anything that gives a probability for each (ticker, t0) can take the model's place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (training rows, rows to score, feature names) to (ticker, t0, p).
ScoreProvider = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def _fitted(estimator, train: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    vector = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="skip")
    model = estimator.fit(vector.transform(train))
    return model.transform(vector.transform(rows)).select("ticker", "t0", vector_to_array("probability")[1].alias("p"))


def logistic(train: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """train: names, y, weight."""
    return _fitted(LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=0.01, standardization=True), train, rows, names)


def boosted(train: DataFrame, rows: DataFrame, names: list[str], trees: int = 20, depth: int = 3) -> DataFrame:
    return _fitted(GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, seed=42), train, rows, names)


def hessian_total(scores: DataFrame, weight: str = "weight") -> DataFrame:
    return scores.agg(F.sum(F.col(weight) * F.col("p") * (1 - F.col("p"))).alias("hessian"))


def class_balance(rows: DataFrame) -> DataFrame:
    """Weight of a positive row that balances the classes."""
    positive = F.sum(F.col("weight") * F.col("y"))
    return rows.agg(((F.sum("weight") - positive) / F.nullif(positive, F.lit(0.0))).alias("pos_weight"))

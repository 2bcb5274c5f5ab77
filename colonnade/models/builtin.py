"""Classifiers that map directly onto MLlib estimators, and the accuracy of a subset of features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.models.ensembles import fit_forest
from colonnade.models.frame import ClassFrame, ModelResult, Scorer, assembled, predicted, search
from colonnade.operators.evaluate import auc, binary_metrics
from colonnade.operators.sampling import SEED

# Default search grids.
LOGISTIC_GRID = {"c": [0.01, 0.1, 1.0, 10.0, 100.0, None], "max_iter": [500, 1000, 2000, 3000]}
NETWORK_GRID = {"hidden": [50, 100, 150], "max_iter": [100, 500]}


def padded(probability: str, k: int):
    """MLlib sizes the vector by the largest label seen; absent last classes get probability 0."""
    p = vector_to_array(F.col(probability))
    return F.slice(F.concat(p, F.array_repeat(F.lit(0.0), k)), 1, k)


def ml_scorer(model, columns: Sequence[str], k: int) -> Scorer:
    """Only ``probability`` is added; the working columns of the model are dropped."""

    def score(df: DataFrame) -> DataFrame:
        out = model.setFeaturesCol("_f").transform(assembled(df, columns, "_f"))
        return out.withColumn("_p", padded("probability", k)).select(*df.columns, F.col("_p").alias("probability"))

    return score


def _fit(estimator, train: DataFrame, frame: ClassFrame) -> Scorer:
    estimator = estimator.setFeaturesCol("_f").setLabelCol("y")
    model = estimator.fit(assembled(train, frame.columns, "_f"))
    score = ml_scorer(model, frame.columns, len(frame.classes))
    summary = model._java_obj.summary()
    score.ended = summary.totalIterations() < estimator.getMaxIter()
    return score


def ridge(c: float | None, n: int) -> float:
    """The penalty weight 1/(C n) of a mean loss that equals penalty C on a summed loss."""
    return 0.0 if c is None else 1.0 / (c * max(n, 1))


def fit_logistic(train, frame, c=1.0, max_iter=1000) -> Scorer:
    return _fit(LogisticRegression(
        family="multinomial", regParam=ridge(c, train.count()), maxIter=max_iter, standardization=False), train, frame)


def fit_network(train, frame, hidden=100, max_iter=100) -> Scorer:
    """One sigmoid hidden layer; other activations and optimisers do not exist in MLlib."""
    layers = [len(frame.columns), hidden, len(frame.classes)]
    return _fit(MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=SEED), train, frame)


def logistic(frame: ClassFrame, grid: Mapping = LOGISTIC_GRID, parallelism: int = 2) -> ModelResult:
    return search(frame.scaled(), "logistic regression", fit_logistic, grid, parallelism)


def neural_network(frame: ClassFrame, grid: Mapping = NETWORK_GRID, parallelism: int = 2) -> ModelResult:
    return search(frame.scaled(), "neural network", fit_network, grid, parallelism)


def binary_logistic(frame: ClassFrame, positive: str, max_iter: int = 100) -> DataFrame:
    """One row: train and test accuracy, test counts, recall, precision and AUC for two classes."""
    if len(frame.classes) != 2:
        raise ValueError("binary_logistic needs exactly two classes")
    model = LogisticRegression(family="binomial", labelCol="y", featuresCol="_f", maxIter=max_iter, regParam=0.0)
    fitted = model.fit(assembled(frame.train, frame.columns, "_f"))
    rows = predicted(ml_scorer(fitted, frame.columns, 2), frame.data, frame.classes)
    hit = (F.col("label") == F.col("prediction")).cast("double")
    shares = rows.agg(
        F.avg(F.when(F.col("split") == "train", hit)).alias("train_accuracy"),
        F.avg(F.when(F.col("split") == "test", hit)).alias("test_accuracy"),
    )
    test = rows.filter("split = 'test'")
    area = auc(test, F.get("probability", F.lit(frame.classes.index(positive))), F.col("label") == positive)
    one = F.lit(1)  # three one-row tables side by side
    return (
        shares.withColumn("_k", one)
        .join(binary_metrics(test, positive).drop("accuracy").withColumn("_k", one), "_k")
        .join(area.withColumn("_k", one), "_k").drop("_k")
    )


def subset_accuracy(frame: ClassFrame, columns: Sequence[str], kind: str = "forest", **params) -> float:
    """Test accuracy of a forest or a logistic model on a subset of the features."""
    part = ClassFrame(frame.data, frame.classes, list(columns), frame.folds)
    fit = {"forest": fit_forest, "logistic": fit_logistic}[kind]
    rows = predicted(fit(part.train, part, **params), part.test, part.classes)
    return rows.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] or 0.0

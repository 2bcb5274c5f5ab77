"""Classifiers composed from several fits: one-vs-rest SVM and stacking."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.models.builtin import ml_scorer, ridge
from colonnade.models.ensembles import fit_forest
from colonnade.models.frame import (
    ClassFrame, ModelResult, Scorer, assembled, cross_validate, cv_table, predicted, result, search, settings, together,
)
from colonnade.operators.sampling import SEED
from colonnade.session import cut_lineage

# Most steps of the linear machine, which ends by its tolerance well before.
SVM_STEPS = 1000
# Default search grids.
SVM_GRID = {"kernel": ["rbf", "linear", "poly"], "degree": [2], "tol": [1e-3, 1e-2]}
STACKING_GRID = {"c": [0.1, 1.0, 10.0]}
FOURIER_FEATURES = 128
CALIBRATION_FOLDS = 3


def _one_vs_rest(train: DataFrame, k: int, make: Callable) -> list:
    """One binary model per class on (y = class); ``train`` has the features in ``_f``."""
    rows = train.select("y", "_f").persist()
    try:
        return together(lambda i: make().fit(rows.withColumn("_b", (F.col("y") == i).cast("double"))), range(k))
    finally:
        rows.unpersist()


def _with_margins(df: DataFrame, models: Sequence) -> DataFrame:
    """Adds ``margin``: the raw score for 'is the class' of every binary model."""
    for i, m in enumerate(models):
        m = m.setRawPredictionCol(f"_r{i}").setPredictionCol("")
        if hasattr(m, "setProbabilityCol"):
            m = m.setProbabilityCol("")
        df = m.transform(df)
    return df.withColumn("margin", F.array(*[vector_to_array(f"_r{i}")[1] for i in range(len(models))]))


def _normalised(values: Column, k: int) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(values, lambda v: v / total)).otherwise(F.array_repeat(F.lit(1.0 / k), k))


def _fourier(p: int, n: int = FOURIER_FEATURES):
    """Random cosine features whose inner product approximates the Gaussian kernel with gamma = 1/p."""
    rng = np.random.default_rng(SEED)
    weights = rng.normal(scale=math.sqrt(2.0 / p), size=(p, n))
    shift = rng.uniform(0.0, 2.0 * math.pi, size=n)

    @F.pandas_udf("array<double>")
    def expand(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.cos(np.vstack(points.to_list()) @ weights + shift) * math.sqrt(2.0 / n)))

    return expand


def kernel_features(df: DataFrame, columns: Sequence[str], kernel: str, degree: int = 2) -> DataFrame:
    """Adds the vector ``_f`` for a linear, polynomial or Gaussian kernel."""
    if kernel == "rbf":
        raw = F.array(*[F.col(c).cast("double") for c in columns])
        return df.withColumn("_f", array_to_vector(_fourier(len(columns))(raw)))
    if kernel == "poly":
        return PolynomialExpansion(degree=degree, inputCol="_v", outputCol="_f").transform(assembled(df, columns, "_v")).drop("_v")
    return assembled(df, columns, "_f")


def _fit_margins(train, frame, kernel, degree, tol, c, max_iter) -> Callable[[DataFrame], DataFrame]:
    rows = kernel_features(train, frame.columns, kernel, degree)
    make = lambda: LinearSVC(
        labelCol="_b", featuresCol="_f", tol=tol, regParam=ridge(c, n), maxIter=max_iter, standardization=False)
    n = train.count()
    models = _one_vs_rest(rows, len(frame.classes), make)
    return lambda df: _with_margins(kernel_features(df, frame.columns, kernel, degree), models).select(*df.columns, "margin")


def fit_svm(train, frame, kernel="rbf", degree=2, tol=1e-3, c=1.0, max_iter=SVM_STEPS) -> Scorer:
    """Largest margin wins; enough for accuracy, no calibrated probabilities."""
    margins = _fit_margins(train, frame, kernel, degree, tol, c, max_iter)
    return lambda df: margins(df).select(*df.columns, F.col("margin").alias("score"), F.col("margin").alias("probability"))


def fit_svm_calibrated(train, frame, kernel="rbf", degree=2, tol=1e-3, c=1.0, max_iter=SVM_STEPS) -> Scorer:
    """Adds probabilities: a logistic curve per class, fitted on out-of-fold margins."""
    k = len(frame.classes)
    args = (frame, kernel, degree, tol, c, max_iter)
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(CALIBRATION_FOLDS))
    fits = together(
        lambda f: _fit_margins(train if f is None else train.filter(part != f), *args), [None, *range(CALIBRATION_FOLDS)])
    margins, inner = fits[0], fits[1:]
    held = inner[0](train.filter(part == 0))
    for f in range(1, CALIBRATION_FOLDS):
        held = held.unionByName(inner[f](train.filter(part == f)))
    held = held.persist()

    def curve(i: int) -> tuple[float, float]:
        rows = held.select((F.col("y") == i).cast("double").alias("_b"), array_to_vector(F.array(F.col("margin")[i])).alias("_f"))
        fitted = LogisticRegression(labelCol="_b", featuresCol="_f", family="binomial").fit(rows)
        return float(fitted.coefficients[0]), float(fitted.intercept)

    curves = together(curve, range(k))
    held.unpersist()

    def score(df: DataFrame) -> DataFrame:
        each = F.array(*[
            F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("margin")[i] + F.lit(b)))) for i, (a, b) in enumerate(curves)
        ])
        return margins(df).select(*df.columns, F.col("margin").alias("score"), _normalised(each, k).alias("probability"))

    return score


def svm(frame: ClassFrame, grid: Mapping = SVM_GRID, parallelism: int = 2) -> ModelResult:
    return search(frame.scaled(), "svm", fit_svm, grid, parallelism, final=fit_svm_calibrated)


def stacking(frame: ClassFrame, grid: Mapping = STACKING_GRID, forest: Mapping | None = None, machine: Mapping | None = None, parallelism: int = 2) -> ModelResult:
    """Forest and SVM probabilities, out of fold for training rows, feed a logistic model.

    The penalty of the logistic model is searched on those out-of-fold columns, so the base models are
    fitted once per fold and once on all training rows.
    """
    frame = frame.scaled()
    k = len(frame.classes)
    bases = [(fit_forest, dict(forest or {"trees": 50})), (fit_svm_calibrated, dict(machine or {}))]
    names = [f"s{b}_{i}" for b in range(len(bases)) for i in range(k)]

    def base_columns(train: DataFrame, df: DataFrame) -> DataFrame:
        out = df
        for b, (fit, params) in enumerate(bases):
            scored = fit(train, frame, **params)(out)
            out = scored.select(*out.columns, *[F.get("probability", F.lit(i)).alias(f"s{b}_{i}") for i in range(k)])
        return out

    pairs = [(frame.train.filter(F.col("fold") != f), frame.train.filter(F.col("fold") == f)) for f in range(frame.folds)]
    parts = together(lambda pair: base_columns(*pair), [*pairs, (frame.train, frame.test)], parallelism)
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    top = ClassFrame(cut_lineage(stacked), frame.classes, names, frame.folds)

    def fit_top(train, f, c=1.0) -> Scorer:
        model = LogisticRegression(family="multinomial", regParam=ridge(c, train.count()), standardization=False, labelCol="y", featuresCol="_f")
        return ml_scorer(model.fit(assembled(train, f.columns, "_f")), f.columns, k)

    table, best = cv_table(top, "stacking", cross_validate(top, fit_top, settings(grid), parallelism))
    scorer = fit_top(top.train, top, **best)
    return result(top, "stacking", predicted(scorer, top.data, top.classes), best, table)

"""Linear regression with inference. One pass gives the moments; every fit reuses them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.special import f_upper, t_quantile, t_two_sided
from colonnade.operators.aggregate import resample
from colonnade.operators.evaluate import regression_metrics
from colonnade.operators.moments import Moments, cross_moments
from colonnade.operators.ordering import ranked
from colonnade.operators.sampling import SEED, plain_split


@dataclass(frozen=True)
class LinearFit:
    target: str
    terms: list[str]  # 'const' first
    coef: np.ndarray
    se: np.ndarray
    n: int
    df_model: int
    ssr: float
    sst: float
    constant: list[str]  # features left out because they do not vary

    @property
    def df_resid(self) -> int:
        return self.n - self.df_model - 1

    @property
    def r2(self) -> float:
        return 1.0 - self.ssr / self.sst if self.sst > 0 else math.nan

    @property
    def adj_r2(self) -> float:
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid if self.df_resid > 0 else math.nan

    @property
    def mse(self) -> float:
        return self.ssr / self.n

    def _information(self, penalty: float) -> float:
        fit = self.n * (math.log(2.0 * math.pi * max(self.mse, 1e-300)) + 1.0)
        return fit + penalty * (self.df_model + 1)

    @property
    def aic(self) -> float:
        return self._information(2.0)

    @property
    def bic(self) -> float:
        return self._information(math.log(self.n))

    @property
    def t(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.coef / self.se

    @property
    def p(self) -> list[float]:
        return [t_two_sided(float(t), self.df_resid) if self.df_resid > 0 else math.nan for t in self.t]

    @property
    def f(self) -> float:
        if self.df_model == 0 or self.df_resid <= 0:
            return math.nan
        if self.ssr <= 0:
            return math.inf
        return ((self.sst - self.ssr) / self.df_model) / (self.ssr / self.df_resid)

    def predict(self) -> Column:
        total = F.lit(float(self.coef[0]))
        for name, c in zip(self.terms[1:], self.coef[1:]):
            total = total + F.lit(float(c)) * F.col(name).cast("double")
        return total


def fit_linear(m: Moments, target: str, features: Sequence[str]) -> LinearFit:
    """Least squares with an explicit intercept; constant features are set aside first."""
    flat = [c for c in m.pick(features).constant()] if features else []
    used = [c for c in features if c not in flat]
    t = m.names.index(target)
    at = [m.names.index(c) for c in used]
    sst, n = float(m.cross[t, t]), m.n
    if used:
        sxx, sxy = m.cross[np.ix_(at, at)], m.cross[at, t]
        size = np.sqrt(np.diag(sxx))
        corr = sxx / np.outer(size, size)
        inverse = np.linalg.pinv(corr, rcond=1e-12, hermitian=True) / np.outer(size, size)
        slope = inverse @ sxy
        rank = int(np.linalg.matrix_rank(corr, tol=1e-10, hermitian=True))
        ssr = max(sst - 2.0 * float(slope @ sxy) + float(slope @ sxx @ slope), 0.0)
        mean = m.mean[at]
        intercept = m.mean[t] - slope @ mean
        spread = np.concatenate([[1.0 / n + mean @ inverse @ mean], np.diag(inverse)])
        coef = np.concatenate([[intercept], slope])
    else:
        rank, ssr, coef, spread = 0, sst, np.array([m.mean[t]]), np.array([1.0 / n])
    left = n - rank - 1
    se = np.sqrt(np.maximum(spread, 0.0) * ssr / left) if left > 0 else np.full(len(coef), math.nan)
    return LinearFit(target, ["const", *used], coef, se, n, rank, ssr, sst, flat)


def backward(m: Moments, target: str, features: Sequence[str], p_remove: float = 0.1) -> tuple[LinearFit, list[tuple]]:
    """Drop the feature with the largest p-value while it exceeds the bound; no further scan needed."""
    left, steps = list(features), []
    while True:
        fit = fit_linear(m, target, left)
        left = fit.terms[1:]
        if not left:
            return fit, steps
        p = fit.p[1:]
        worst = int(np.nanargmax(p)) if not all(math.isnan(x) for x in p) else 0
        if not p[worst] > p_remove:
            return fit, steps
        steps.append((len(steps) + 1, left[worst], float(p[worst]), fit.r2, fit.adj_r2, fit.aic, fit.bic, fit.mse))
        left = [c for c in left if c != left[worst]]


def coefficient_table(spark: SparkSession, fit: LinearFit, bound: float = 0.05, level: float = 0.95) -> DataFrame:
    """t-test per term with its confidence interval."""
    q = t_quantile(0.5 + level / 2.0, fit.df_resid) if fit.df_resid > 0 else math.nan
    rows = [
        (c, float(b), float(s), float(t), float(p), bool(p < bound), float(b - q * s), float(b + q * s))
        for c, b, s, t, p in zip(fit.terms, fit.coef, fit.se, fit.t, fit.p)
    ]
    return spark.createDataFrame(
        rows, "term string, coef double, se double, t double, p double, significant boolean, low double, high double"
    )


def f_test_table(spark: SparkSession, fit: LinearFit, bound: float = 0.05) -> DataFrame:
    p = f_upper(fit.f, fit.df_model, fit.df_resid)
    return spark.createDataFrame(
        [(float(fit.f), fit.df_model, fit.df_resid, float(p), bool(p < bound))],
        "f double, df_model int, df_resid int, p double, significant boolean",
    )


def steps_table(spark: SparkSession, steps: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        steps,
        "step int, removed string, p double, r2 double, adj_r2 double, aic double, bic double, mse double",
    )


def fit_table(fit: LinearFit, rows: DataFrame, split: str = "split") -> DataFrame:
    """Train / test MSE and R^2 next to adjusted R^2, AIC and BIC of the fit."""
    scored = regression_metrics(rows.withColumn("_yhat", fit.predict()), fit.target, "_yhat", [split])
    pick = lambda part, m: F.max(F.when(F.col(split) == part, F.col(m)))
    return scored.agg(
        pick("train", "mse").alias("train_mse"), pick("test", "mse").alias("test_mse"),
        pick("train", "r2").alias("train_r2"), pick("test", "r2").alias("test_r2"),
    ).select(
        "*", F.lit(float(fit.adj_r2)).alias("adj_r2"), F.lit(float(fit.aic)).alias("aic"), F.lit(float(fit.bic)).alias("bic")
    )


def prediction_series(rows: DataFrame, predicted: Column, actual: str, order: str, split: str = "split") -> DataFrame:
    """(position, split, actual, predicted): train rows first, then test rows, each along ``order``."""
    out = rows.select(
        F.col(split), F.col(order), F.col(actual).cast("double").alias("actual"), predicted.alias("predicted"),
        F.when(F.col(split) == "train", 0).otherwise(1).alias("_part"),
    )
    return ranked(out, [("_part", True), (order, True)], "position").select("position", split, "actual", "predicted")


def stepwise_by_time(
    df: DataFrame, target: str, time_column: str, freq: str = "DAY", drop: Sequence[str] = ("delay_minutes",),
    share: float = 0.2, seed: int = SEED, columns: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Resample, split, fit all features, eliminate backwards and report; under 10 bins is an error."""
    spark = df.sparkSession
    bins = resample(df, time_column, target, freq, columns)
    if bins.limit(10).count() < 10:
        raise ValueError("not enough data after resampling")
    rows = plain_split(bins, time_column, share, seed)
    features = [c for c in bins.columns if c not in (time_column, target)]
    train = cross_moments(rows.filter("split = 'train'"), [*features, target])
    full = fit_linear(train, target, features)
    final, steps = backward(train, target, [c for c in features if c not in drop])
    return {
        "bins": rows,
        "full_fit": fit_table(full, rows),
        "steps": steps_table(spark, steps),
        "terms": coefficient_table(spark, final),
        "f_test": f_test_table(spark, final),
        "final_fit": fit_table(final, rows),
        "series": prediction_series(rows, final.predict(), target, time_column),
    }

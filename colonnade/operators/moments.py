"""One pass for counts, means and cross-products; selection and decomposition work on that p x p result."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators.rows import column_names

# Up to this many columns the cross-products are built-in aggregates; wider tables use one matrix
# product per Arrow batch.
SQL_WIDTH = 14


@dataclass(frozen=True)
class Moments:
    names: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray  # centred cross-products

    def pick(self, names: Sequence[str]) -> "Moments":
        at = [self.names.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cross), 0.0) / max(self.n, 1))

    def constant(self) -> list[str]:
        """Columns whose spread is nothing but rounding."""
        limit = 1e-12 * np.maximum(np.abs(self.mean), 1e-300)
        return [c for c, s, m in zip(self.names, self.std, limit) if s <= m]

    def scaled(self, ignore: Sequence[str] = ()) -> "Moments":
        """Moments of the z-scored columns; ignored columns stay as they are."""
        keep = np.array([c in ignore for c in self.names], dtype=bool)
        flat = np.array([c in self.constant() for c in self.names], dtype=bool)
        factor = np.where(keep, 1.0, np.where(flat, 0.0, 1.0 / np.where(flat | (self.std == 0), 1.0, self.std)))
        return Moments(self.names, self.n, np.where(keep, self.mean, 0.0), self.cross * np.outer(factor, factor))


def cross_moments(df: DataFrame, columns: Sequence[str] | None = None) -> Moments:
    """Moments of the rows that have no null in the columns."""
    names = list(columns or column_names(df))
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).na.drop("any")
    return _moments_sql(rows, names) if len(names) <= SQL_WIDTH else _moments_batches(rows, names)


def _moments_sql(rows: DataFrame, names: list[str]) -> Moments:
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n, cross = got["n"], np.zeros((p, p))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = (got[f"c{i}_{j}"] or 0.0) * n
    return Moments(names, n, np.array([got[f"m{i}"] or 0.0 for i in range(p)]), cross)


def _moments_batches(rows: DataFrame, names: list[str]) -> Moments:
    p = len(names)
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(p)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - mean
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(p), p), "j": np.tile(np.arange(p), p), "v": total.ravel()})

    cells = rows.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    cross = np.zeros((p, p))
    for r in cells.collect():  # p x p numbers
        cross[r["i"], r["j"]] = r["v"]
    return Moments(names, first["n"], mean, cross)


def unpack(df: DataFrame, column: str, width: int, prefix: str = "x") -> DataFrame:
    """Array column to ``width`` double columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.get(column, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)])


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each column: its largest entry in size is positive."""
    top = np.argmax(np.abs(vectors), axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _reach(cumulative: np.ndarray, bound: float = 0.95) -> int:
    hit = np.nonzero(cumulative >= bound)[0]
    return int(hit[0]) + 1 if len(hit) else 1


@dataclass(frozen=True)
class Decomposition:
    names: list[str]
    loadings: np.ndarray  # one column per component
    ratio: np.ndarray
    share: np.ndarray
    moments: Moments
    ignore: tuple[str, ...]

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.ratio)

    @property
    def n95(self) -> int:
        return _reach(self.cumulative)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, float(r), float(c), float(s), self.n95)
                for i, (r, c, s) in enumerate(zip(self.ratio, self.cumulative, self.share))]
        return spark.createDataFrame(rows, "component int, ratio double, cumulative double, share double, n95 int")

    def ranking(self, spark: SparkSession) -> DataFrame:
        weight = np.abs(self.loadings[:, 0])
        order = np.argsort(-weight, kind="stable")
        rows = [(self.names[i], float(weight[i]), r + 1) for r, i in enumerate(order)]
        return spark.createDataFrame(rows, "feature string, importance double, rank int")

    def top_features(self, n: int = 2) -> list[str]:
        order = np.argsort(-np.abs(self.loadings[:, 0]), kind="stable")
        return [self.names[i] for i in order[:n]]

    def project(self, df: DataFrame, n: int | None = None, prefix: str = "pc") -> DataFrame:
        """Add the first n component scores as columns, fitted moments applied as constants."""
        n = n or self.n95

        def part(i: int, weight: float) -> Column:
            x, name = F.col(self.names[i]).cast("double"), self.names[i]
            if name not in self.ignore:
                std = float(self.moments.std[i])
                x = (x - F.lit(float(self.moments.mean[i]))) / F.lit(std) if std > 0 else F.lit(0.0)
            return x * F.lit(weight)

        scores = {}
        for k in range(n):
            total = F.lit(0.0)
            for i in range(len(self.names)):
                total = total + part(i, float(self.loadings[i, k]))
            scores[f"{prefix}{k + 1}"] = total
        return df.withColumns(scores)


def pca(df: DataFrame, columns: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> Decomposition:
    """Principal components of the z-scored columns."""
    raw = cross_moments(df, columns)
    values, vectors = np.linalg.eigh(raw.scaled(ignore).cross)
    values, vectors = np.maximum(values[::-1], 0.0), _signed(vectors[:, ::-1])
    total = values.sum() or 1.0
    return Decomposition(raw.names, vectors, values / total, values / total, raw, tuple(ignore))


def svd(df: DataFrame, columns: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> Decomposition:
    """Truncated SVD (k = min(rows, columns) - 1) of the z-scored matrix.

    ``share`` is sigma^2 over the kept total; ``ratio`` the variance of a component over the total
    variance. The two differ when ignored columns keep a non-zero mean.
    """
    raw = cross_moments(df, columns)
    s = raw.scaled(ignore)
    second = s.cross + s.n * np.outer(s.mean, s.mean)
    k = max(min(s.n, len(s.names)) - 1, 1)
    values, vectors = np.linalg.eigh(second)
    values, vectors = np.maximum(values[::-1][:k], 0.0), _signed(vectors[:, ::-1])[:, :k]
    spread = np.einsum("ik,ij,jk->k", vectors, s.cross, vectors)
    return Decomposition(
        raw.names, vectors, spread / (np.trace(s.cross) or 1.0), values / (values.sum() or 1.0), raw, tuple(ignore)
    )


def vif_values(m: Moments) -> list[float]:
    s = m.scaled()
    corr = s.cross / max(s.n, 1)
    out = []
    for i in range(len(s.names)):
        if corr[i, i] == 0.0:
            out.append(math.nan)
            continue
        rest = [j for j in range(len(s.names)) if j != i]
        c = corr[rest, i]
        r2 = float(c @ np.linalg.pinv(corr[np.ix_(rest, rest)], rcond=1e-12, hermitian=True) @ c) / corr[i, i] if rest else 0.0
        out.append(math.inf if 1.0 - r2 <= 1e-13 else 1.0 / (1.0 - r2))
    return out


def vif(df: DataFrame, columns: Sequence[str] | None = None, bound: float = 10.0) -> DataFrame:
    """(feature, vif, decision): keep below the bound, remove above it, undecided at it or undefined."""
    m = cross_moments(df, columns)
    rows = [
        (c, float(v), "keep" if v < bound else "remove" if v > bound else "undecided")
        for c, v in zip(m.names, vif_values(m))
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, decision string")

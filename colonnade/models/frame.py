"""The shared input of all classifiers, cross-validated search and the result every model returns."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.operators.encode import moments, zscore
from colonnade.operators.sampling import SEED, balance, class_counts, split_and_folds
from colonnade.session import cut_lineage

# A fitted model: adds ``probability`` (one entry per class) and may add ``score`` (ranks the classes).
Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[..., Scorer]


@dataclass(frozen=True)
class ClassFrame:
    """Rows as (id, label, y, columns..., split, fold); test rows have fold -1."""

    data: DataFrame
    classes: list[str]
    columns: list[str]
    folds: int

    @property
    def train(self) -> DataFrame:
        return self.data.filter("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.data.filter("split = 'test'")

    def scaled(self) -> "ClassFrame":
        """z-scored columns; mean and deviation come from the training rows."""
        data = zscore(self.data, self.columns, fitted=moments(self.train, self.columns))
        return ClassFrame(data, self.classes, self.columns, self.folds)

    def balanced(self, method: str = "oversample") -> "ClassFrame":
        """Equal class sizes among the training rows; test rows stay as they are.

        Copies keep the fold of their source, so none crosses a fold or the split.
        """
        train = balance(self.train, "id", "label", method)
        if "draw" in train.columns:
            train = train.withColumn("id", F.concat_ws("#", F.col("id").cast("string"), F.col("draw").cast("string"))).drop("draw")
        data = train.withColumn("id", F.col("id").cast("string")).unionByName(
            self.test.withColumn("id", F.col("id").cast("string")))
        return ClassFrame(cut_lineage(data), self.classes, self.columns, self.folds)


def make_frame(
    df: DataFrame, label: str, columns: Sequence[str], id_col: str, share: float = 0.2, folds: int = 5, seed: int = SEED
) -> ClassFrame:
    """Split, fold and write the rows once; every fit reads that table."""
    columns = list(columns)
    rows = df.na.drop("any", subset=[*columns, label]).select(
        F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    placed = cut_lineage(split_and_folds(rows, "id", "label", share, folds, seed))
    classes = sorted(class_counts(placed, "label"))
    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1).cast("double")
    data = placed.withColumn("y", y)
    return ClassFrame(data, classes, columns, folds)


def assembled(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def first_largest(values: Column, classes: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(values, F.array_max(values)).cast("int"))


def predicted(scorer: Scorer, df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(id, label, split, fold, prediction, probability)."""
    scored = scorer(df)
    by = F.col("score") if "score" in scored.columns else F.col("probability")
    return scored.select("id", "label", "split", "fold", first_largest(by, classes).alias("prediction"), "probability")


def settings(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


@dataclass(frozen=True)
class ModelResult:
    name: str
    predictions: DataFrame  # model, id, label, split, prediction, probability
    params: dict
    cv: DataFrame  # model, params, mean_accuracy, rank


def together(fn: Callable, items: Sequence, width: int = 4) -> list:
    """Run independent fits a few at a time; short jobs of one fit then overlap with those of another."""
    with ThreadPoolExecutor(max(1, min(width, len(items)))) as pool:
        return list(pool.map(fn, items))


def cv_table(frame: ClassFrame, name: str, scores: Sequence[tuple[dict, float]]) -> tuple[DataFrame, dict]:
    """Search result as a table, and the best setting (the first on a tie; the last digits do not part equals)."""
    order = sorted(range(len(scores)), key=lambda i: (-round(scores[i][1], 12), i))
    rank = {i: r + 1 for r, i in enumerate(order)}
    rows = [(name, json.dumps(p, sort_keys=True), float(a), rank[i]) for i, (p, a) in enumerate(scores)]
    table = frame.data.sparkSession.createDataFrame(rows, "model string, params string, mean_accuracy double, rank int")
    return table, scores[order[0]][0]


def by_most_steps(grid: Sequence[dict], steps: str) -> list[list[int]]:
    """Places of the settings that differ in ``steps`` only, fewest steps first."""
    lines: dict[str, list[int]] = {}
    for i, point in enumerate(grid):
        lines.setdefault(json.dumps({key: v for key, v in point.items() if key != steps}, sort_keys=True), []).append(i)
    return [sorted(line, key=lambda i: grid[i].get(steps) or 0) for line in lines.values()]


def cross_validate(frame: ClassFrame, fit: Fit, grid: Sequence[dict], parallelism: int = 2, steps: str = "max_iter") -> list[tuple[dict, float]]:
    """Mean held-out accuracy per setting over the folds; at least ``parallelism`` fits run at a time.

    A scorer with ``ended`` set came to its end before its most ``steps``: it is also what more steps would give.
    """
    totals = {i: 0.0 for i in range(len(grid))}
    lines = by_most_steps(grid, steps)
    rows = frame.train.persist()

    def score(job: tuple[int, list[int]]) -> list[tuple[int, float]]:
        fold, line = job
        part, held = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        out, ended = [], False
        for i in line:
            if not ended:
                scorer = fit(part, frame, **grid[i])
                ended = getattr(scorer, "ended", False)
                found = predicted(scorer, held, frame.classes)
                got = found.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
            out.append((i, got or 0.0))
        return out

    try:
        # A fit has one task per partition: as many fits of all folds run at a time as give every core a task.
        width = max(parallelism, frame.data.sparkSession.sparkContext.defaultParallelism // max(rows.rdd.getNumPartitions(), 1))
        for line in together(score, [(fold, line) for fold in range(frame.folds) for line in lines], width):
            for i, accuracy in line:
                totals[i] += accuracy / frame.folds
    finally:
        rows.unpersist()
    return [(grid[i], totals[i]) for i in range(len(grid))]


def search(frame: ClassFrame, name: str, fit: Fit, grid: Mapping[str, Sequence], parallelism: int = 2, final: Fit | None = None) -> ModelResult:
    """Pick the best setting by cross-validation, refit on all training rows and score every row."""
    table, best = cv_table(frame, name, cross_validate(frame, fit, settings(grid), parallelism))
    scorer = (final or fit)(frame.train, frame, **best)
    return result(frame, name, predicted(scorer, frame.data, frame.classes), best, table)


def result(frame: ClassFrame, name: str, rows: DataFrame, params: dict, cv: DataFrame) -> ModelResult:
    """Scored rows are written once, since every metric reads them."""
    rows = rows.select(F.lit(name).alias("model"), "id", "label", "split", "prediction", "probability")
    return ModelResult(name, cut_lineage(rows), params, cv)


def probability_scores(classes: Sequence[str]) -> dict[str, Column]:
    return {c: F.get("probability", F.lit(i)) for i, c in enumerate(classes)}

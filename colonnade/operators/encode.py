"""One-hot columns and scaling. Parameters come from one aggregate; applying them is a projection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators.ordering import ranked
from colonnade.operators.rows import column_names
from colonnade.session import cut_lineage

MAX_CATEGORIES = 10_000

# A deviation below this share of the mean is rounding: the column is constant.
CONSTANT = 1e-12


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values of each column, in one job.

    One-hot output has a column per value, so a column with very many values is an error; ``one_hot_vector`` takes those.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    rows = (
        df.select(pairs.alias("p")).select("p.*").filter("v is not null").distinct()
        .limit(MAX_CATEGORIES + 1).collect()
    )
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in {list(columns)}")
    return {c: sorted(r.v for r in rows if r.c == c) for c in columns}


def dummy_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def safe_names(names: Sequence[str], pattern: str = r"[.`]") -> list[str]:
    """Column names that need no quoting: matches of ``pattern`` become ``_``, and a name that was taken gets a number."""
    out: list[str] = []
    for name in names:
        plain = candidate = re.sub(pattern, "_", name)
        while candidate in out or (candidate != name and candidate in names):
            candidate = f"{plain}_{len(out)}"
        out.append(candidate)
    return out


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = True,
    values: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace each column by 0/1 columns; null gives zeros in all of them."""
    values = values or categories(df, columns)
    chosen = [(c, v) for c in columns for v in list(values[c])[1 if drop_first else 0:]]
    dummies = [
        F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(name)
        for (c, v), name in zip(chosen, safe_names([dummy_name(c, v) for c, v in chosen]))
    ]
    return df.select(*[c for c in df.columns if c not in columns], *dummies)


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, at): the place of every value of every column, from 0, as a written table of any size.

    Values are in order, but the first of a column, its baseline, comes last.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()
    placed = ranked(values, [("value", True)], "at", ["column"])
    sizes = placed.groupBy("column").agg(F.max("at").alias("n"))
    moved = F.when(F.col("at") == 1, F.col("n") - 1).otherwise(F.col("at") - 2)
    return cut_lineage(placed.join(F.broadcast(sizes), "column").select("column", "value", moved.alias("at")))


def one_hot_vector(df: DataFrame, columns: Sequence[str], name: str = "features", drop_first: bool = True, index: DataFrame | None = None) -> DataFrame:
    """Replace ``columns`` by one sparse vector, for columns of very many values.

    The vector has the places of ``index`` (by default ``category_index`` of these rows), one column after another,
    without each baseline if ``drop_first``; null and unknown values give zeros. Values meet their places in a join,
    so no list of them is collected.
    """
    index = category_index(df, columns) if index is None else index
    sizes = {r["column"]: r["n"] for r in index.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # columns
    out, parts = df, []
    for i, c in enumerate(columns):
        value, at, part = (f"_{kind}{i}_{name}" for kind in ("value", "at", "part"))
        own = index.filter(F.col("column") == c).select(F.col("value").alias(value), F.col("at").cast("double").alias(at))
        out = out.join(own, F.col(f"`{c}`").cast("string") == F.col(value), "left").drop(value)
        # A place behind the last one stands for no value and is dropped, as the baseline is on request.
        n = sizes.get(c, 0)
        out = out.withColumn(at, F.coalesce(at, F.lit(float(n - 1 if drop_first and n else n))))
        out = place_encoder(max(n, 1) if drop_first and n else n + 1, at, part).transform(out).drop(at)
        parts.append(part)
    out = VectorAssembler(inputCols=parts, outputCol=name).transform(out)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], name)


def place_encoder(size: int, source: str, target: str):
    """An encoder of ``size`` places, the last of which is left out; the size comes from two rows, not from the table."""
    ends = SparkSession.active().createDataFrame([(0.0,), (float(size - 1),)], f"`{source}` double")
    return OneHotEncoder(inputCols=[source], outputCols=[target], dropLast=True).fit(ends)


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, from one pass."""
    aggs = [f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def scaled(c: str, mean: float | None, std: float | None) -> Column:
    x = F.col(c).cast("double")
    if mean is None or not std or std <= CONSTANT * max(abs(mean), 1.0):
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(mean)) / F.lit(std)


def zscore(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    ignore: Sequence[str] = (),
    fitted: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """z-score with the population deviation; a constant column becomes 0."""
    names = [c for c in (columns or column_names(df)) if c not in ignore]
    fitted = fitted or moments(df, names)
    return df.withColumns({c: scaled(c, *fitted[c]) for c in names})


def zscore_target(df: DataFrame, target: str) -> DataFrame:
    """Scaled target next to the mean and deviation that undo the scaling."""
    mean, std = moments(df, [target])[target]
    return df.withColumns(
        {target: scaled(target, mean, std), "mean": F.lit(mean).cast("double"), "std": F.lit(std).cast("double")}
    )


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    row = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()

    def scale(i: int, c: str) -> Column:
        lo, hi, x = row[f"lo{i}"], row[f"hi{i}"], F.col(c).cast("double")
        if lo is None or lo == hi:
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - F.lit(lo)) / F.lit(hi - lo)

    return df.withColumns({c: scale(i, c) for i, c in enumerate(columns)})


def label_indicators(df: DataFrame, label: str, classes: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per sorted class, named ``is_<class>``; classes whose names would meet get a number."""
    classes = classes or categories(df, [label])[label]
    names = safe_names([f"is_{v}" for v in classes], r"\W")
    return df.withColumns(
        {
            name: F.coalesce((F.col(label).cast("string") == F.lit(v)).cast("int"), F.lit(0))
            for name, v in zip(names, classes)
        }
    )

"""Grouped summaries, trip roll-up, class balance and matrices in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.ordering import Order, running_totals
from colonnade.operators.rows import column_names, drop_null_rows

TRIP_KEYS = ("date", "train_id")
TRIP_FIRST = ("from_id",)
TRIP_LAST = (
    "to_id", "scheduled_time", "actual_time", "stop_sequence", "delay_minutes",
    "status", "line", "type", "arrival_minutes",
)


def trip_rollup(
    df: DataFrame,
    keys: Sequence[str] = TRIP_KEYS,
    first: Sequence[str] = TRIP_FIRST,
    last: Sequence[str] = TRIP_LAST,
    order: Sequence[str] = ("stop_sequence", "scheduled_time", "stop_id"),
) -> DataFrame:
    """One row per key: first / last non-null value of each column along the order.

    Nulls are skipped column by column and rows with a null key are left out. min_by / max_by combine
    on the map side, so a key with very many rows sends one partial row per task.
    """
    along = F.struct(*order)

    def pick(fn, c: str) -> Column:
        return fn(F.col(c), F.when(F.col(c).isNotNull(), along)).alias(c)

    return (
        df.na.drop("any", subset=list(keys))
        .groupBy(*keys)
        .agg(*[pick(F.min_by, c) for c in first], *[pick(F.max_by, c) for c in last])
    )


def mean_by(df: DataFrame, keys: Sequence[str | Column], value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(name or f"mean_{value}"))


def share_true(df: DataFrame, key: str, flag: str, name: str = "share") -> DataFrame:
    return mean_by(df, [key], flag, name).orderBy(F.col(name).desc(), key)


def weekday_means(df: DataFrame, day: str, value: str) -> DataFrame:
    """Mean per weekday, Monday first; the ordinal is computed from the date."""
    d = F.col(day)
    return (
        df.groupBy(F.date_format(d, "EEEE").alias("day_of_weeks"), (F.weekday(d) + 1).alias("num"))
        .agg(F.avg(value).alias(f"mean_{value}"))
        .orderBy("num")
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class, nulls left out. The window runs over one row per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def balance_check(df: DataFrame, label: str) -> DataFrame:
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        (F.min("n") == F.max("n")).alias("balanced"),
    )


def class_list(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies; identical rows are merged before the shuffle."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column."""
    wide = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def resample(
    df: DataFrame, time_column: str, target: str, freq: str = "DAY", columns: Sequence[str] | None = None
) -> DataFrame:
    """Mean of the numeric columns per time bin; rows with a null and empty bins are left out."""
    names = list(columns or [c for c in column_names(df) if c != target])
    numeric = df.withColumns(
        {time_column: F.col(time_column).cast("timestamp_ntz"), target: F.col(target).try_cast("double")}
    )
    kept = drop_null_rows(numeric)
    bin_start = F.date_trunc(freq, F.col(time_column)).cast("timestamp_ntz").alias(time_column)
    return kept.groupBy(bin_start).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in [*names, target]]
    )


def _matrix(df: DataFrame, columns: Sequence[str], fn, name: str, mask_diagonal: bool) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[fn(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            if not (mask_diagonal and x == y):
                cells.append(F.struct(F.lit(x).alias("row"), F.lit(y).alias("col"), F.col(f"p{i}").alias(name)))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def covariance(df: DataFrame, columns: Sequence[str] | None = None, mask_diagonal: bool = False) -> DataFrame:
    """Sample covariances as (row, col, value), pairs with a null skipped; one pass."""
    return _matrix(df, list(columns or column_names(df)), F.covar_samp, "covariance", mask_diagonal)


def correlation(df: DataFrame, columns: Sequence[str] | None = None, mask_diagonal: bool = False) -> DataFrame:
    return _matrix(df, list(columns or column_names(df)), F.corr, "correlation", mask_diagonal)


def cumulative_share(df: DataFrame, order: Order, value: str) -> DataFrame:
    """Running sum of a column along an order, and its share of the total."""
    total = df.agg(F.sum(value)).first()[0]
    out = running_totals(df, order, {"cumulative": F.col(value).cast("double")})
    return out.withColumn("share", F.try_divide(F.col("cumulative"), F.lit(total).cast("double")))

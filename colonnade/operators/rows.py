"""Projections, filters, sorts and small picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.ordering import Order, ranked


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def column_names(df: DataFrame, kind: str = "number") -> list[str]:
    """Names of the numeric ('number') or text ('text') columns; booleans are neither."""
    wanted = T.NumericType if kind == "number" else T.StringType
    return [f.name for f in df.schema if isinstance(f.dataType, wanted)]


def select_kind(df: DataFrame, kind: str = "number", also: Sequence[str] = ()) -> DataFrame:
    names = column_names(df, kind)
    return df.select(*[c for c in also if c not in names], *names)


def keep_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.filter(predicate)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for other in others:
        out = out.unionByName(other)
    return out


def sorted_by(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order])


def top_n(df: DataFrame, order: Order, n: int) -> DataFrame:
    """First n rows along the order; Spark keeps n rows per task and merges them."""
    return sorted_by(df, order).limit(n)


def with_index(df: DataFrame, order: Order, name: str = "index") -> DataFrame:
    """1-based position along the order, computed bucket by bucket."""
    return ranked(df, order, name)


def first_reaching(df: DataFrame, index: str, value: str, bound: float) -> DataFrame:
    """Smallest index whose value reaches the bound; 1 when none does."""
    hit = F.min(F.when(F.col(value) >= bound, F.col(index)))
    return df.agg(F.coalesce(hit, F.lit(1).cast(df.schema[index].dataType)).alias(index))


def best_row(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the highest score; the smallest ``order`` value wins a tie (numeric order)."""
    row = F.struct(*df.columns)
    return df.agg(F.max_by(row, F.struct(F.col(score), -F.col(order))).alias("r")).select("r.*")


def lookup_pairs(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key -> value table; the last pair along ``order`` wins, as when filling a dictionary."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(value, F.struct(*order)).alias(value))
    )


def overview(df: DataFrame) -> DataFrame:
    """One row per column: rows, columns and nulls, from one pass."""
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(names)]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(names)])
    )
    return wide.select("_n", pairs.alias("p")).select(
        "p.column", F.col("_n").alias("rows"), F.lit(len(names)).cast("bigint").alias("columns"), "p.nulls"
    )


def preview(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*key).limit(n)

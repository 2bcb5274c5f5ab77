"""Repeatable splits, folds and class balancing keyed on md5(id), independent of the data layout.

Splits and folds need only a few cut points per class: a digest-prefix count finds the prefix that
holds each cut, the exact cut is read from that prefix alone, and rows are then marked by comparing
their digest with the cuts. The table itself is never shuffled. ``id`` must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.ordering import hash_bucket, ranked
from colonnade.session import broadcast_if_small

SEED = 5805
MAX_CLASSES = 100_000
DRAW_CHUNK = 50_000


def digest(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def draw(bound: Column, *key: Column | str) -> Column:
    """Repeatable integer in [0, bound) for a key."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint"), bound)


def unit_draw(*key: Column | str) -> Column:
    """Repeatable double in [0, 1) for a key."""
    return draw(F.lit(2**52), *key).cast("double") / F.lit(float(2**52))


def class_counts(df: DataFrame, strata: str) -> dict:
    rows = (
        df.filter(F.col(strata).isNotNull()).groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
        .limit(MAX_CLASSES + 1).collect()
    )
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{strata} has more than {MAX_CLASSES} classes")
    return {r[strata]: r["n"] for r in sorted(rows, key=lambda r: str(r[strata]))}


def cut_points(df: DataFrame, id_col: str, strata: str, ranks: Mapping[object, Sequence[int]], seed: int = SEED) -> DataFrame:
    """Digest of the r-th smallest digest of each class, for every requested rank: (class, cuts)."""
    spark = df.sparkSession
    keyed = df.filter(F.col(strata).isNotNull()).select(F.col(strata), digest(id_col, seed).alias("_h")).withColumn(
        "_b", hash_bucket("_h")
    )
    wanted = spark.createDataFrame(
        [(c, int(r)) for c, rs in ranks.items() for r in rs if r > 0],
        T.StructType([T.StructField(strata, df.schema[strata].dataType), T.StructField("_r", T.LongType())]),
    )
    before = Window.partitionBy(strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(strata, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_o", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    edges = (
        starts.join(F.broadcast(wanted), strata)  # classes x cuts, bounded by MAX_CLASSES
        .filter((F.col("_r") > F.col("_o")) & (F.col("_r") <= F.col("_o") + F.col("_n")))
        .select(strata, "_b", (F.col("_r") - F.col("_o")).alias("_local"))
    )
    edge_prefixes = broadcast_if_small(edges.groupBy(strata, "_b").agg(F.collect_set("_local").alias("_locals")))
    order = Window.partitionBy(strata, "_b").orderBy("_h")
    return (
        keyed.join(edge_prefixes, [strata, "_b"])
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.array_contains("_locals", F.col("_rn").cast("bigint")))
        .groupBy(strata).agg(F.array_sort(F.collect_list("_h")).alias("_cuts"))
    )


def mark(df: DataFrame, id_col: str, strata: str, ranks: Mapping[object, Sequence[int]], name: str, seed: int = SEED) -> DataFrame:
    """Add the number of cut points below each row's digest (0 for the first slice of its class)."""
    cuts = broadcast_if_small(cut_points(df, id_col, strata, ranks, seed))
    below = F.size(F.filter(F.col("_cuts"), lambda c: c < digest(id_col, seed)))
    return (
        df.filter(F.col(strata).isNotNull()).join(cuts, strata, "left")
        .select(*df.columns, F.coalesce(F.when(F.col("_cuts").isNotNull(), below), F.lit(0)).alias(name))
    )


def test_sizes(counts: Mapping[object, int], share: float) -> dict:
    """Test rows per class: ceil(share * n) in total, by largest remainder, ties to the first class."""
    n = sum(counts.values())
    target = math.ceil(round(share * n, 9))
    exact = {c: target * k / n for c, k in counts.items()}
    sizes = {c: math.floor(e) for c, e in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (-round(exact[c] - sizes[c], 9), str(c)))
    for c in by_remainder[: target - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(df: DataFrame, id_col: str, label: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``split``: 'test' for the given share of each class, 'train' for the rest."""
    sizes = test_sizes(class_counts(df, label), share)
    # A class without test rows gets no cut and counts as all train.
    out = mark(df, id_col, label, {c: [k] for c, k in sizes.items()}, "_slice", seed)
    empty = [c for c, k in sizes.items() if k == 0]
    is_test = (F.col("_slice") == 0) & ~F.col(label).isin(empty) if empty else F.col("_slice") == 0
    return out.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_slice")


def plain_split(df: DataFrame, id_col: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    one = df.withColumn("_all", F.lit(1))
    return stratified_split(one, id_col, "_all", share, seed).drop("_all")


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Add ``fold`` in 0..folds-1; within a class the fold sizes differ by at most one."""
    ranks = {}
    for c, n in class_counts(df, label).items():
        size, extra = divmod(n, folds)
        ends = [size * (i + 1) + min(i + 1, extra) for i in range(folds - 1)]
        ranks[c] = sorted({e for e in ends if 0 < e < n})
    return mark(df, id_col, label, ranks, name, seed)


def split_and_folds(df: DataFrame, id_col: str, label: str, share: float = 0.2, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``split`` as ``stratified_split`` does, and a stratified ``fold`` for train rows (-1 for test rows).

    Test rows and folds are consecutive slices of the same digest order, so one set of cut points serves both.
    """
    counts = class_counts(df, label)
    sizes, ranks, parts = test_sizes(counts, share), {}, {}
    for c, n in counts.items():
        size, extra = divmod(n - sizes[c], folds)
        ends = [sizes[c]] + [sizes[c] + size * (i + 1) + min(i + 1, extra) for i in range(folds)]
        ranks[c] = sorted({e for e in ends if 0 < e < n})
        starts = [0, *ranks[c]]
        parts[c] = [next((i - 1 for i, e in enumerate(ends) if first < e), folds - 1) for first in starts]
    sliced = mark(df, id_col, label, ranks, "_slice", seed)
    names = df.sparkSession.createDataFrame(
        list(parts.items()),
        T.StructType([T.StructField(label, df.schema[label].dataType), T.StructField("_parts", T.ArrayType(T.IntegerType()))]),
    )
    named = sliced.join(F.broadcast(names), label)  # one row per class, at most MAX_CLASSES
    return named.select(
        *df.columns,
        F.when(F.get("_parts", F.col("_slice")) < 0, "test").otherwise("train").alias("split"),
        F.get("_parts", F.col("_slice")).alias("fold"),
    )


def undersample(df: DataFrame, id_col: str, label: str, seed: int = SEED) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement."""
    counts = class_counts(df, label)
    if not counts:
        return df
    low = min(counts.values())
    return mark(df, id_col, label, {c: [low] for c in counts}, "_slice", seed).filter("_slice = 0").drop("_slice")


def class_draws(df: DataFrame, label: str, needed: Mapping[object, int], counts: Mapping[object, int], seed: int) -> DataFrame:
    """(class, draw, _rn): for each class ``needed`` draws of a row number in 1..count.

    Draw numbers are generated chunk by chunk, so one large class is spread over many tasks. Spark takes the size of
    the generated rows for that of the few class rows and would broadcast them; they are to be joined by sorting.
    """
    fields = [T.StructField(label, df.schema[label].dataType)] + [T.StructField(n, T.LongType()) for n in ("_need", "_count")]
    wanted = [(c, int(needed[c]), int(counts[c])) for c in needed if needed[c] > 0]
    sizes = df.sparkSession.createDataFrame(wanted, T.StructType(fields))
    chunk = F.lit(DRAW_CHUNK).cast("bigint")
    chunks = sizes.withColumn("_lo", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_need"), chunk)))
    return (
        chunks.repartition(label, "_lo")
        .withColumn("draw", F.explode(F.sequence("_lo", F.least(F.col("_lo") + chunk - 1, F.col("_need")))))
        .withColumn("_rn", draw(F.col("_count"), F.col(label), F.col("draw"), str(seed)) + 1)
        .select(label, "draw", "_rn").hint("merge")
    )


def oversample(df: DataFrame, id_col: str, label: str, seed: int = SEED) -> DataFrame:
    """Every class drawn with replacement up to the size of the largest.

    Rows and draws meet on (class, row number), so a large class spreads over all tasks.
    """
    counts = class_counts(df, label)
    if not counts:
        return df.withColumn("draw", F.lit(0).cast("bigint"))
    top = max(counts.values())
    rows = ranked(
        df.filter(F.col(label).isNotNull()).withColumn("_h", digest(id_col, seed)), [("_h", True)], "_rn", [label],
        bucket=hash_bucket("_h"),
    ).drop("_h")
    draws = class_draws(df, label, {c: top for c in counts}, counts, seed)
    return rows.join(draws, [label, "_rn"]).select(*df.columns, "draw")


def balance(df: DataFrame, id_col: str, label: str, method: str = "oversample", seed: int = SEED) -> DataFrame:
    if method == "oversample":
        return oversample(df, id_col, label, seed)
    if method == "undersample":
        return undersample(df, id_col, label, seed)
    raise ValueError("method must be 'undersample' or 'oversample'")


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Repeatable random order, returned as a 1-based ``position`` column."""
    hashed = df.withColumn("_h", digest(key, seed))
    return ranked(hashed, [("_h", True)], "position", bucket=hash_bucket("_h")).drop("_h").orderBy("position")

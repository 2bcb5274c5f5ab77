"""Table profile: column statistics, top values and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.ordering import running_totals
from colonnade.operators.rows import column_names
from colonnade.session import cut_lineage

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

# Size parameter of a quantile sketch: its ranks are off by about 0.5 %.
SKETCH = 400


def value_counts(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> DataFrame:
    """(column, value, n) for every distinct non-null value; combined on the map side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(counts: DataFrame, at: Sequence[float] = QUANTILES) -> DataFrame:
    """(column, q, quantile) from value counts: smallest value whose cumulative count reaches q of the rows."""
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    running = running_totals(counts, [("value", True)], {"seen": F.col("n")}, by=["column"])
    points = F.explode(F.array(*[F.lit(float(q)) for q in at]))
    reached = (
        running.join(F.broadcast(totals), "column")  # one row per profiled column
        .withColumn("q", points)
        .filter(F.col("seen") >= F.col("q") * F.col("total"))
    )
    return reached.groupBy("column", "q").agg(F.min("value").alias("quantile"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per numeric column; ``profile_others`` has those of the other types.

    Without ``exact`` all figures come from one scan: mergeable sketches estimate distinct values (about 5 %) and
    quantiles (ranks within about 0.5 %). ``exact`` counts every value instead. Skewness and kurtosis carry the sample
    correction.
    """
    columns = list(columns or column_names(df))
    names = [f"q{round(q * 100):02d}" for q in QUANTILES]
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"nulls{i}"), F.count_if(x == 0).alias(f"zeros{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"), F.skewness(x).alias(f"skew{i}"), F.kurtosis(x).alias(f"kurt{i}"),
        ]
        if not exact:
            aggs += [F.approx_count_distinct(x).alias(f"distinct{i}"), F.expr(f"kll_sketch_agg_double(cast(`{c}` as double), {SKETCH})").alias(f"sketch{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        n = F.col(f"n{i}").cast("double")
        fields = [
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"nulls{i}").alias("nulls"),
            F.col(f"zeros{i}").alias("zeros"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
            F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
            F.when(n > 2, F.col(f"skew{i}") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, ((n + 1) * F.col(f"kurt{i}") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        ]
        if not exact:
            ranks = ", ".join(f"{float(q)}D" for q in QUANTILES)
            found = F.expr(f"if(n{i} > 0, kll_sketch_get_quantile_double(sketch{i}, array({ranks})), null)")
            fields += [F.col(f"distinct{i}").alias("distinct"), *[F.get(found, F.lit(j)).alias(n) for j, n in enumerate(names)]]
        rows.append(F.struct(*fields))
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if not exact:
        return out
    counts = cut_lineage(value_counts(df, columns, "double"))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    quantiles = exact_quantiles(counts).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(n) for q, n in zip(QUANTILES, names)]
    )
    return out.join(distinct, "column", "left").join(quantiles, "column", "left")


KINDS = {"text": ("string", "char", "varchar"), "time": ("date", "timestamp", "timestamp_ntz"), "boolean": ("boolean",)}


def profile_others(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text, date, time or boolean column, from one scan.

    Returns column, kind, count, nulls, distinct (estimated: within about 2 %), empty (texts without characters),
    min_length, max_length, mean_length (characters), true_share, first and last (least and greatest value as text);
    figures that a kind does not have are null. Other types (numbers, arrays, maps, structs) have no row.
    """
    kinds = {}
    for f in df.schema:
        name = f.dataType.simpleString().split("(")[0]
        kinds.update({f.name: kind for kind, types in KINDS.items() if name in types})
    columns = [c for c in (df.columns if columns is None else columns) if c in kinds]
    if not columns:
        return df.sparkSession.createDataFrame([], OTHER_FORM)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        long = F.char_length(x) if kinds[c] == "text" else F.lit(None).cast("int")
        share = F.avg(x.cast("double")) if kinds[c] == "boolean" else F.lit(None).cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"nulls{i}"), F.approx_count_distinct(x, 0.02).alias(f"distinct{i}"),
            F.count_if(long == 0).alias(f"empty{i}"), F.min(long).alias(f"low{i}"), F.max(long).alias(f"high{i}"), F.avg(long).alias(f"mean{i}"),
            share.alias(f"true{i}") if kinds[c] == "boolean" else F.max(share).alias(f"true{i}"),
            F.min(x).cast("string").alias(f"first{i}"), F.max(x).cast("string").alias(f"last{i}"),
        ]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(f"n{i}").alias("count"), F.col(f"nulls{i}").alias("nulls"),
            F.col(f"distinct{i}").alias("distinct"), (F.col(f"empty{i}") if kinds[c] == "text" else F.lit(None).cast("bigint")).alias("empty"),
            F.col(f"low{i}").alias("min_length"), F.col(f"high{i}").alias("max_length"), F.col(f"mean{i}").alias("mean_length"),
            F.col(f"true{i}").alias("true_share"), F.col(f"first{i}").alias("first"), F.col(f"last{i}").alias("last"))
        for i, c in enumerate(columns)
    ])
    return df.agg(*aggs).select(F.explode(cells).alias("r")).select("r.*")


OTHER_FORM = (
    "column string, kind string, count bigint, nulls bigint, distinct bigint, empty bigint, min_length int, max_length int, mean_length double, "
    "true_share double, first string, last string"
)


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Most frequent values per column; the rank filter is applied in each task before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins between the minimum and maximum; the maximum falls in the last bin."""
    edge = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns)
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = []
    for i, c in enumerate(columns):
        lo, hi = edge[f"lo{i}"], edge[f"hi{i}"]
        if lo is None:
            continue
        x = F.col(c).cast("double")
        raw = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)) + 1 if hi > lo else F.lit(1)
        cells.append(F.struct(
            F.lit(c).alias("column"),
            F.when(x.isNotNull(), F.least(raw, F.lit(bins))).cast("int").alias("bin"),
        ))
    return (
        df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def profile(df: DataFrame, exact: bool = False, bins: int = 10, top: int = 10) -> dict[str, DataFrame]:
    """All profile tables, ready for ``sources.tables.write_report``."""
    from colonnade.operators.aggregate import correlation, covariance, duplicate_count

    numeric, text = column_names(df), column_names(df, "text")
    tables = {
        "columns": profile_columns(df, numeric, exact),
        "others": profile_others(df),
        "histogram": histogram(df, numeric, bins),
        "duplicates": duplicate_count(df),
        "covariance": covariance(df, numeric),
        "correlation": correlation(df, numeric),
    }
    if text:
        tables["top_values"] = top_values(df, text, top)
    return tables

"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One row per stop, as the CSV input carries it.
STOP_SCHEMA = T.StructType(
    [
        T.StructField("stop_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("train_id", T.StringType()),
        T.StructField("stop_sequence", T.IntegerType()),
        T.StructField("from", T.StringType()),
        T.StructField("from_id", T.LongType()),
        T.StructField("to", T.StringType()),
        T.StructField("to_id", T.LongType()),
        T.StructField("scheduled_time", T.StringType()),
        T.StructField("actual_time", T.StringType()),
        T.StructField("delay_minutes", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("k", T.IntegerType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = STOP_SCHEMA, needed: Sequence[str] = (), corrupt: str | None = None
) -> DataFrame:
    """CSV with a header, columns found by name in whatever order the file has them.

    Names in ``schema`` take its types, other columns stay as text, and no pass over the input infers types.
    A file without a ``needed`` column is an error. With ``corrupt``, a column of that name holds the text of
    records that do not fit; without it their broken fields are null. Files whose headers differ are refused.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in needed if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    fields = [schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if corrupt:
        fields.append(T.StructField(corrupt, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(T.StructType(fields)).csv(path)


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    """Stop records from CSV; a file without ``stop_id`` gets one from a hash of the whole record."""
    rows = read_csv(spark, path, needed=[c for c in STOP_SCHEMA.names if c not in ("stop_id", "from", "to", "k")])
    if "stop_id" in rows.columns:
        return rows
    return rows.withColumn("stop_id", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; timestamps keep their microseconds."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode("errorifexists").options(header=True, timestampFormat=micros, timestampNTZFormat=micros).csv(path)
    return path


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each named result table below ``path`` and return where it went."""
    written = {}
    for name, table in tables.items():
        target = f"{path}/{name}"
        table.write.mode("errorifexists").format(fmt).save(target)
        written[name] = target
    return written


def stops(spark: SparkSession, folder: str) -> DataFrame:
    """The events table seen as stop records (see FIXTURES.md): a projection, no shuffle."""
    ts, value = F.col("ts"), F.col("value")
    delay = value - F.lit(50.0)
    shift = F.round(delay * F.lit(60.0)).cast("int")
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("stop_id"),
        ts.cast("date").alias("date"),
        F.col("user_id").cast("string").alias("train_id"),
        (F.hour(ts) + 1).alias("stop_sequence"),
        F.pmod("event_id", F.lit(17)).cast("bigint").alias("from_id"),
        F.pmod("event_id", F.lit(19)).cast("bigint").alias("to_id"),
        ts.alias("scheduled_time"),
        F.timestamp_add("SECOND", shift, ts).alias("actual_time"),
        delay.alias("delay_minutes"),
        F.when(value < 10, "cancelled").when(value < 100, "departed").otherwise("estimated").alias("status"),
        F.col("event_type").alias("line"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "local").otherwise("express").alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )

"""Registry and the shared inputs of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions import derive
from colonnade.operators import aggregate
from colonnade.plans import phases
from colonnade.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero removed."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c)
        for c in df.columns
    ])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; doubles are rounded to the same number of places on both sides."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder), digits)
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read_table(spark, folder, name)


def stops(spark: SparkSession, folder: str) -> DataFrame:
    return tables.stops(spark, folder)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Stops with arrival minutes, class and the long-delay flag as 0/1."""
    return phases.with_arrival(stops(spark, folder)).withColumns(
        {"arrival_status": derive.delay_class("arrival_minutes"), "long_delay": derive.exceeds("delay_minutes").cast("int")}
    )


def holed(spark: SparkSession, folder: str) -> DataFrame:
    """Stops with nulls put in by a rule, to exercise null handling on every row of the table."""
    return stops(spark, folder).withColumns(
        {
            "delay_minutes": F.when(F.col("from_id") != 3, F.col("delay_minutes")),
            "line": F.when(F.col("to_id") != 5, F.col("line")),
            "k": F.when(F.col("k") != 7, F.col("k")),
        }
    )


def trips(spark: SparkSession, folder: str) -> DataFrame:
    return phases.with_features(phases.clean_trips(aggregate.trip_rollup(phases.with_arrival(stops(spark, folder)))))


STOPS = """
stops AS (
  SELECT event_id AS stop_id, CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS train_id,
         CAST(hour(ts) + 1 AS INTEGER) AS stop_sequence, event_id % 17 AS from_id, event_id % 19 AS to_id,
         ts AS scheduled_time,
         ts + to_seconds(CAST(round((value - 50.0::DOUBLE) * 60.0::DOUBLE) AS BIGINT)) AS actual_time,
         value - 50.0::DOUBLE AS delay_minutes,
         CASE WHEN value < 10 THEN 'cancelled' WHEN value < 100 THEN 'departed' ELSE 'estimated' END AS status,
         event_type AS line,
         CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'express' END AS type,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events)"""

LABELLED = STOPS + """,
timed AS (
  SELECT *, (epoch_us(actual_time) - epoch_us(scheduled_time))::DOUBLE / 60000000.0::DOUBLE AS arrival_minutes
  FROM stops),
labelled AS (
  SELECT *, CASE WHEN arrival_minutes < -0.5 THEN 'early' WHEN arrival_minutes <= 0.5 THEN 'on-time' ELSE 'late' END
            AS arrival_status,
         CASE WHEN delay_minutes > 5 THEN 1 ELSE 0 END AS long_delay
  FROM timed)"""

HOLED = STOPS + """,
holed AS (
  SELECT * REPLACE (
    CASE WHEN from_id <> 3 THEN delay_minutes END AS delay_minutes,
    CASE WHEN to_id <> 5 THEN line END AS line,
    CASE WHEN k <> 7 THEN k END AS k)
  FROM stops)"""

_LAST = ", ".join(
    f"arg_max({c}, row(stop_sequence, scheduled_time, stop_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in aggregate.TRIP_LAST
)
TRIPS = LABELLED + f""",
rolled AS (
  SELECT date, train_id,
         arg_min(from_id, row(stop_sequence, scheduled_time, stop_id)) FILTER (WHERE from_id IS NOT NULL) AS from_id,
         {_LAST}
  FROM timed WHERE date IS NOT NULL AND train_id IS NOT NULL GROUP BY date, train_id),
clean AS (
  SELECT DISTINCT *,
         CASE WHEN arrival_minutes < -0.5 THEN 'early' WHEN arrival_minutes <= 0.5 THEN 'on-time' ELSE 'late' END
           AS arrival_status,
         CASE WHEN hour(scheduled_time) >= 5 AND hour(scheduled_time) < 12 THEN 'morning'
              WHEN hour(scheduled_time) >= 12 AND hour(scheduled_time) < 17 THEN 'afternoon'
              WHEN hour(scheduled_time) >= 17 AND hour(scheduled_time) < 21 THEN 'evening' ELSE 'night' END AS time_of_day
  FROM rolled
  WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND scheduled_time IS NOT NULL AND actual_time IS NOT NULL
    AND stop_sequence IS NOT NULL AND delay_minutes IS NOT NULL AND status IS NOT NULL AND line IS NOT NULL
    AND type IS NOT NULL AND arrival_minutes IS NOT NULL),
trips AS (
  SELECT *, delay_minutes > 5 AS long_delay, dayname(date) AS day_of_weeks,
         CAST(date AS VARCHAR) || '|' || train_id AS trip_id
  FROM clean)"""

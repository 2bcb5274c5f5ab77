"""Scans, derived columns, filters, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.catalogue.registry import HOLED, LABELLED, STOPS, holed, labelled, query, stops, table
from colonnade.functions import derive
from colonnade.operators import encode, rows
from colonnade.session import scratch_path
from colonnade.sources import tables

CUSTOMER_HOLES = "SELECT * REPLACE (CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal) FROM customer"


def _customer(spark, folder):
    return table(spark, folder, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))


@query("csv_scan", f"""WITH {STOPS}
SELECT stop_id, date, train_id, stop_sequence, scheduled_time, round(delay_minutes, 6) AS delay_minutes, line, k FROM stops""")
def csv_scan(spark, folder):
    path = tables.write_csv(stops(spark, folder), scratch_path(spark, "csv"))
    return tables.read_csv(spark, path).select(
        "stop_id", "date", "train_id", "stop_sequence", derive.parse_time("scheduled_time").alias("scheduled_time"),
        "delay_minutes", "line", "k",
    )


@query("table_overview", f"""WITH c AS ({CUSTOMER_HOLES}), n AS (
  SELECT 'c_custkey' AS "column", count(*) FILTER (WHERE c_custkey IS NULL) AS nulls FROM c UNION ALL
  SELECT 'c_name', count(*) FILTER (WHERE c_name IS NULL) FROM c UNION ALL
  SELECT 'c_nationkey', count(*) FILTER (WHERE c_nationkey IS NULL) FROM c UNION ALL
  SELECT 'c_acctbal', count(*) FILTER (WHERE c_acctbal IS NULL) FROM c UNION ALL
  SELECT 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment IS NULL) FROM c)
SELECT "column", (SELECT count(*) FROM c) AS rows, 5::BIGINT AS columns, nulls FROM n""")
def table_overview(spark, folder):
    return rows.overview(_customer(spark, folder))


@query("preview_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(spark, folder):
    return rows.preview(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])


@query("name_lookup", f"""WITH {STOPS}
SELECT line, arg_max(from_id, row(scheduled_time, stop_id)) AS from_id FROM stops WHERE line IS NOT NULL GROUP BY line""")
def name_lookup(spark, folder):
    return rows.lookup_pairs(stops(spark, folder), "line", "from_id", ["scheduled_time", "stop_id"])


@query("parse_times", """WITH t AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad ' || event_type
                        WHEN event_type = 'view' THEN NULL
                        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM events)
SELECT event_id, try_cast(txt AS TIMESTAMP) AS parsed FROM t""")
def parse_times(spark, folder):
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(F.lit("bad "), kind)).when(
        kind != "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, folder, "events").select("event_id", derive.parse_time(text).alias("parsed"))


@query("numeric_coerce", """WITH t AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE CAST(event_id AS VARCHAR) || '.25' END AS txt
  FROM events)
SELECT event_id, try_cast(txt AS DOUBLE) AS number FROM t""")
def numeric_coerce(spark, folder):
    kind = F.col("event_type")
    text = F.when(kind == "error", kind).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".25")))
    return table(spark, folder, "events").select("event_id", derive.to_number(text).alias("number"))


@query("elapsed_minutes", f"WITH {LABELLED} SELECT stop_id, round(arrival_minutes, 6) AS arrival_minutes FROM timed")
def elapsed(spark, folder):
    return labelled(spark, folder).select("stop_id", "arrival_minutes")


@query("delay_status", f"""WITH {HOLED}
SELECT stop_id, CASE WHEN delay_minutes < -0.5 THEN 'early' WHEN delay_minutes <= 0.5 THEN 'on-time' ELSE 'late' END
       AS status FROM holed""")
def delay_status(spark, folder):
    return holed(spark, folder).select("stop_id", derive.delay_class("delay_minutes").alias("status"))


@query("day_part", f"""WITH {HOLED}, t AS (SELECT stop_id, CASE WHEN line IS NOT NULL THEN hour(scheduled_time) END AS h FROM holed)
SELECT stop_id, CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon'
                     WHEN h >= 17 AND h < 21 THEN 'evening' ELSE 'night' END AS time_of_day FROM t""")
def day_part(spark, folder):
    at = F.when(F.col("line").isNotNull(), F.col("scheduled_time"))
    return holed(spark, folder).select("stop_id", derive.day_part(at).alias("time_of_day"))


@query("long_delay_flag", f"WITH {HOLED} SELECT stop_id, coalesce(delay_minutes > 5, FALSE) AS long_delay FROM holed")
def long_delay_flag(spark, folder):
    return holed(spark, folder).select("stop_id", derive.exceeds("delay_minutes").alias("long_delay"))


@query("weekday_name", f"WITH {STOPS} SELECT stop_id, dayname(date) AS day_of_weeks FROM stops")
def weekday_name(spark, folder):
    return stops(spark, folder).select("stop_id", derive.weekday_name("date").alias("day_of_weeks"))


@query("calendar_features", f"""WITH {STOPS}
SELECT stop_id, year(scheduled_time) AS year, month(scheduled_time) AS month, day(scheduled_time) AS day,
       hour(scheduled_time) AS hour, isodow(scheduled_time) - 1 AS day_of_week, isodow(scheduled_time) >= 6 AS is_weekend
FROM stops""")
def calendar_features(spark, folder):
    return derive.calendar(stops(spark, folder).select("stop_id", "scheduled_time"), "scheduled_time", keep=False)


@query("clean_rows", f"""WITH {HOLED}
SELECT stop_id, round(delay_minutes, 6) AS delay_minutes, line, k FROM holed
WHERE delay_minutes IS NOT NULL AND line IS NOT NULL AND k IS NOT NULL""")
def clean_rows(spark, folder):
    return rows.drop_null_rows(holed(spark, folder).select("stop_id", "delay_minutes", "line", "k"))


@query("project_numeric", f"""WITH {STOPS}
SELECT stop_id, stop_sequence, from_id, round(delay_minutes, 6) AS delay_minutes, k FROM stops""")
def project_numeric(spark, folder):
    return rows.select_kind(rows.drop_columns(stops(spark, folder), "to_id", "not_there"), "number")


@query("recode_status", f"""WITH {LABELLED}
SELECT stop_id, CASE arrival_status WHEN 'early' THEN '1' WHEN 'on-time' THEN '2' WHEN 'late' THEN '3'
       ELSE arrival_status END AS code,
       CASE line WHEN 'view' THEN 'seen' WHEN 'click' THEN 'hit' ELSE line END AS line FROM labelled""")
def recode_status(spark, folder):
    return labelled(spark, folder).select(
        "stop_id", derive.recode("arrival_status", derive.STATUS_CODES).alias("code"),
        derive.recode("line", {"view": "seen", "click": "hit"}).alias("line"),
    )


@query("filter_rows", f"WITH {HOLED} SELECT stop_id, line, k FROM holed WHERE delay_minutes > 5 AND NOT (line = 'error')")
def filter_rows(spark, folder):
    kept = rows.keep_where(holed(spark, folder), (F.col("delay_minutes") > 5) & ~(F.col("line") == "error"))
    return kept.select("stop_id", "line", "k")


@query("select_columns", f"WITH {STOPS} SELECT stop_id, train_id, actual_time FROM stops")
def select_columns(spark, folder):
    return stops(spark, folder).select("stop_id", "train_id", "actual_time")


@query("indexed_result", """WITH g AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT row_number() OVER (ORDER BY round(total, 2) DESC, o_custkey) AS "index", o_custkey, round(total, 2) AS total FROM g""")
def indexed_result(spark, folder):
    totals = table(spark, folder, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.with_index(totals, [("total", False), ("o_custkey", True)])


def _dummies(column, values):
    return ", ".join(
        f"""CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS "{column}_{v}" """ for v in values)


@query("one_hot", f"""WITH {HOLED}
SELECT stop_id, {_dummies("line", ["error", "purchase", "signup", "view"])},
       {_dummies("status", ["departed", "estimated"])}, {_dummies("type", ["local"])} FROM holed""")
def one_hot(spark, folder):
    return encode.one_hot(holed(spark, folder).select("stop_id", "line", "status", "type"), ["line", "status", "type"])


@query("zscore", f"""WITH {STOPS}
SELECT stop_id, round((delay_minutes - avg(delay_minutes) OVER ()) / stddev_pop(delay_minutes) OVER (), 6) AS delay_minutes,
       round((k - avg(k) OVER ()) / stddev_pop(k) OVER (), 6) AS k FROM stops""")
def zscore(spark, folder):
    return encode.zscore(stops(spark, folder).select("stop_id", "delay_minutes", "k"), ["delay_minutes", "k"])


@query("zscore_ignore", f"""WITH {STOPS}
SELECT stop_id, round((delay_minutes - avg(delay_minutes) OVER ()) / stddev_pop(delay_minutes) OVER (), 6) AS delay_minutes,
       k, 0.0::DOUBLE AS one FROM stops""")
def zscore_ignore(spark, folder):
    base = stops(spark, folder).select("stop_id", "delay_minutes", "k", F.lit(1).alias("one"))
    return encode.zscore(base, ignore=["stop_id", "k"])


@query("zscore_target", f"""WITH {STOPS}
SELECT stop_id, round((delay_minutes - avg(delay_minutes) OVER ()) / stddev_pop(delay_minutes) OVER (), 6) AS delay_minutes,
       round(avg(delay_minutes) OVER (), 6) AS mean, round(stddev_pop(delay_minutes) OVER (), 6) AS std FROM stops""")
def zscore_target(spark, folder):
    return encode.zscore_target(stops(spark, folder).select("stop_id", "delay_minutes"), "delay_minutes")


@query("minmax", f"""WITH {STOPS}, c AS (
  SELECT stop_id, month(scheduled_time) AS month, day(scheduled_time) AS day, hour(scheduled_time) AS hour FROM stops)
SELECT stop_id, 0.0::DOUBLE AS month,
       round((day - min(day) OVER ())::DOUBLE / (max(day) OVER () - min(day) OVER ()), 6) AS day,
       round((hour - min(hour) OVER ())::DOUBLE / (max(hour) OVER () - min(hour) OVER ()), 6) AS hour FROM c""")
def minmax(spark, folder):
    base = derive.calendar(stops(spark, folder).select("stop_id", "scheduled_time"), "scheduled_time", keep=False)
    return encode.minmax(base.select("stop_id", "month", "day", "hour"), ["month", "day", "hour"])


@query("label_indicators", f"""WITH {LABELLED}
SELECT stop_id, (arrival_status = 'early')::INT AS is_early, (arrival_status = 'late')::INT AS is_late,
       (arrival_status = 'on-time')::INT AS is_on_time FROM labelled""")
def label_indicators(spark, folder):
    return encode.label_indicators(labelled(spark, folder).select("stop_id", "arrival_status"), "arrival_status").drop("arrival_status")

"""Grouped summaries, profiles, sampling and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.catalogue.registry import HOLED, LABELLED, STOPS, TRIPS, holed, labelled, query, stops, table, trips
from colonnade.operators import aggregate, profile, rows, sampling
from colonnade.plans import phases
from colonnade.session import scratch_path
from colonnade.sources import tables

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("trip_rollup", f"""WITH {TRIPS}
SELECT date, train_id, from_id, to_id, scheduled_time, actual_time, stop_sequence, round(delay_minutes, 6) AS delay_minutes,
       status, line, type, round(arrival_minutes, 6) AS arrival_minutes FROM rolled""")
def trip_rollup(spark, folder):
    return aggregate.trip_rollup(phases.with_arrival(stops(spark, folder)))


HOLED_ROLLED = ", ".join(
    f"arg_max({c}, row(stop_sequence, scheduled_time, stop_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in ("line", "k"))


@query("trip_rollup_nulls", f"""WITH {HOLED}
SELECT date, train_id, round(arg_min(delay_minutes, row(stop_sequence, scheduled_time, stop_id))
         FILTER (WHERE delay_minutes IS NOT NULL), 6) AS delay_minutes, {HOLED_ROLLED} FROM holed GROUP BY date, train_id""")
def trip_rollup_nulls(spark, folder):
    return aggregate.trip_rollup(holed(spark, folder), first=["delay_minutes"], last=["line", "k"])


# A mean of cents over 32 rows can end exactly on half a millionth; nine places leave no such ties here.
def _mean_sql(key, name):
    return f"WITH {TRIPS} SELECT {key} AS {name}, round(avg(delay_minutes), 9) AS mean_delay_minutes FROM trips GROUP BY 1"


@query("mean_delay_by_day_part", _mean_sql("time_of_day", "time_of_day"), digits=9)
def mean_by_day_part(spark, folder):
    return phases.explore(trips(spark, folder))["by_day_part"]


@query("mean_delay_by_date", _mean_sql("date", "date"), digits=9)
def mean_by_date(spark, folder):
    return phases.explore(trips(spark, folder))["by_date"]


@query("mean_delay_by_sequence", _mean_sql("stop_sequence", "stop_sequence"), digits=9)
def mean_by_sequence(spark, folder):
    return phases.explore(trips(spark, folder))["by_sequence"]


@query("mean_delay_by_weekday", f"""WITH {TRIPS}
SELECT day_of_weeks, isodow(date) AS num, round(avg(delay_minutes), 9) AS mean_delay_minutes FROM trips GROUP BY 1, 2""", digits=9)
def mean_by_weekday(spark, folder):
    return phases.explore(trips(spark, folder))["by_weekday"]


@query("long_delay_share_by_line", f"""WITH {TRIPS}
SELECT line, round(avg(long_delay::INT), 6) AS share FROM trips GROUP BY 1 ORDER BY 2 DESC""")
def long_delay_share(spark, folder):
    return phases.explore(trips(spark, folder))["long_delay_by_line"]


@query("class_distribution", f"""WITH {TRIPS}
SELECT arrival_status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS proportion
FROM trips GROUP BY 1""")
def class_distribution(spark, folder):
    return aggregate.class_distribution(trips(spark, folder), "arrival_status")


@query("balance_check", """WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)
SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, min(n) = max(n) AS balanced FROM c""")
def balance_check(spark, folder):
    return aggregate.balance_check(table(spark, folder, "labels"), "quality")


@query("class_list", f"WITH {LABELLED} SELECT DISTINCT arrival_status FROM labelled")
def class_list(spark, folder):
    return aggregate.class_list(labelled(spark, folder), "arrival_status")


@query("duplicate_rows", """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT (SELECT count(*) FROM lineitem) AS rows, count(*) AS distinct_rows,
       (SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM d""")
def duplicate_rows(spark, folder):
    return aggregate.duplicate_count(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem")
def distinct_rows(spark, folder):
    return aggregate.drop_duplicates(
        table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))


# A mean of cents over 60,000 rows can end exactly on half a millionth, hence seven places.
@query("column_moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 7) AS mean, round(stddev_pop({c}), 7) AS std FROM lineitem""" for c in NUMBERS), digits=7)
def column_moments(spark, folder):
    return aggregate.column_moments(table(spark, folder, "lineitem"), NUMBERS)


@query("daily_resample", f"""WITH {HOLED}
SELECT CAST(date_trunc('day', scheduled_time) AS TIMESTAMP) AS scheduled_time, round(avg(k), 9) AS k,
       round(avg(stop_sequence), 9) AS stop_sequence, round(avg(delay_minutes), 9) AS delay_minutes
FROM holed WHERE k IS NOT NULL AND delay_minutes IS NOT NULL GROUP BY 1""", digits=9)
def daily_resample(spark, folder):
    base = holed(spark, folder).select("scheduled_time", "k", "stop_sequence", "delay_minutes")
    return aggregate.resample(base, "scheduled_time", "delay_minutes")


@query("hourly_resample", f"""WITH {STOPS}
SELECT CAST(date_trunc('hour', scheduled_time) AS TIMESTAMP) AS scheduled_time, round(avg(k), 9) AS k,
       round(avg(delay_minutes), 9) AS delay_minutes FROM stops GROUP BY 1""", digits=9)
def hourly_resample(spark, folder):
    base = stops(spark, folder).select("scheduled_time", "k", "delay_minutes")
    return aggregate.resample(base, "scheduled_time", "delay_minutes", "HOUR")


def _matrix_sql(fn, name, keep=lambda a, b: True):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS "row", '{b}' AS col, round({fn}({a}, {b}), 6) AS {name} FROM lineitem"""
        for a in NUMBERS for b in NUMBERS if keep(a, b))


@query("covariance_long", _matrix_sql("covar_samp", "covariance"))
def covariance_long(spark, folder):
    return aggregate.covariance(table(spark, folder, "lineitem"), NUMBERS)


@query("correlation_long", _matrix_sql("corr", "correlation", lambda a, b: a != b))
def correlation_long(spark, folder):
    return aggregate.correlation(table(spark, folder, "lineitem"), NUMBERS, mask_diagonal=True)


def _profile_sql(c):
    quantiles = ", ".join(
        f"(SELECT min(v) FROM r WHERE rn >= {q} * n) AS q{round(q * 100):02d}" for q in profile.QUANTILES)
    return f"""SELECT * FROM (WITH x AS (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem),
  r AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(v) OVER () AS n FROM x WHERE v IS NOT NULL),
  m AS (SELECT count(v)::DOUBLE AS n, avg(v) AS a FROM x),
  p AS (SELECT avg((v - a) * (v - a)) AS m2, avg((v - a) * (v - a) * (v - a)) AS m3,
               avg((v - a) * (v - a) * (v - a) * (v - a)) AS m4 FROM x, m)
  SELECT '{c}' AS "column", count(v) AS count, count(*) FILTER (WHERE v IS NULL) AS nulls,
         count(*) FILTER (WHERE v = 0) AS zeros, min(v) AS min, max(v) AS max, round(avg(v), 7) AS mean,
         round(stddev_samp(v), 7) AS std,
         (SELECT round(m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 7) FROM p, m) AS skewness,
         (SELECT round(((n + 1) * (m4 / (m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)), 7) FROM p, m) AS kurtosis,
         count(DISTINCT v) AS "distinct", {quantiles}
  FROM x)"""


@query("profile_columns", " UNION ALL ".join(_profile_sql(c) for c in NUMBERS), digits=7)
def profile_columns(spark, folder):
    return profile.profile_columns(table(spark, folder, "lineitem"), NUMBERS, exact=True)


@query("profile_sketch", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) FILTER (WHERE {c} = 0) AS zeros, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(avg({c}), 6) AS mean, TRUE AS distinct_near, {', '.join(f'TRUE AS q{round(q * 100):02d}_near' for q in profile.QUANTILES)} FROM lineitem"""
    for c in NUMBERS))
def profile_sketch(spark, folder):
    """The sketched figures next to counts of the rows: a quantile is near if its true rank is within 1 %."""
    rows = table(spark, folder, "lineitem")
    found = profile.profile_columns(rows, NUMBERS)
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in NUMBERS])).alias("p")).select("p.*")
    names = [f"q{round(q * 100):02d}" for q in profile.QUANTILES]
    ranks = [F.avg((F.col("x") <= F.col(n)).cast("double")).alias(f"{n}_to") for n in names]
    ranks += [F.avg((F.col("x") < F.col(n)).cast("double")).alias(f"{n}_from") for n in names]
    true = values.join(F.broadcast(found), "column").groupBy("column").agg(*ranks, F.count_distinct("x").alias("exact"))
    near = [((F.col(f"{n}_from") <= q + 0.01) & (F.col(f"{n}_to") >= q - 0.01)).alias(f"{n}_near") for n, q in zip(names, profile.QUANTILES)]
    return found.join(true, "column").select(
        "column", "count", "zeros", "min", "max", "mean", (F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.15).alias("distinct_near"), *near)


_TEXTS = """SELECT '{c}' AS "column", 'text' AS kind, count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS nulls, TRUE AS distinct_near,
  count(*) FILTER (WHERE {c} = '') AS empty, min(length({c}))::INTEGER AS min_length, max(length({c}))::INTEGER AS max_length,
  round(avg(length({c})), 6) AS mean_length, NULL::DOUBLE AS true_share, min({c}) AS first, max({c}) AS last FROM holed"""


@query("profile_others", f"WITH {HOLED} " + " UNION ALL ".join(_TEXTS.format(c=c) for c in ("line", "type")) + """ UNION ALL
SELECT 'date', 'time', count(date), count(*) FILTER (WHERE date IS NULL), TRUE, NULL, NULL, NULL, NULL, NULL, min(date)::VARCHAR, max(date)::VARCHAR FROM holed
UNION ALL SELECT 'late', 'boolean', count(delay_minutes), count(*) FILTER (WHERE delay_minutes IS NULL), TRUE, NULL, NULL, NULL, NULL,
  round(avg((delay_minutes > 5)::INT), 6), 'false', 'true' FROM holed""")
def profile_others(spark, folder):
    rows = holed(spark, folder).withColumn("late", F.col("delay_minutes") > 5).select("line", "type", "date", "late", "k")
    found = profile.profile_others(rows)
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in ("line", "type", "date", "late")])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in exact.columns])).alias("p")
    near = F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.1
    return found.join(exact.select(pairs).select("p.*"), "column").withColumn("distinct_near", near).select(
        "column", "kind", "count", "nulls", "distinct_near", "empty", "min_length", "max_length", "mean_length", "true_share", "first", "last")


@query("profile_top_values", """WITH v AS (
  SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem UNION ALL
  SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem), c AS (
  SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), r AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
SELECT * FROM r WHERE rank <= 5""")
def profile_top_values(spark, folder):
    return profile.top_values(table(spark, folder, "lineitem"), ["l_returnflag", "l_linenumber"])


def _histogram_sql(c):
    return f"""SELECT '{c}' AS "column",
  CAST(least(floor(({c} - (SELECT min({c}) FROM lineitem)) /
       (((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) / 10)) + 1, 10) AS INTEGER) AS bin,
  count(*) AS n FROM lineitem GROUP BY 1, 2"""


@query("profile_histogram", " UNION ALL ".join(_histogram_sql(c) for c in ("l_quantity", "l_extendedprice")))
def profile_histogram(spark, folder):
    return profile.histogram(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("report_sink", """SELECT 'orders' AS "table", count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT 'customer', count(*), round(sum(c_acctbal), 2) FROM customer""")
def report_sink(spark, folder):
    parts = {
        "orders": table(spark, folder, "orders").select(F.col("o_totalprice").alias("v")),
        "customer": table(spark, folder, "customer").select(F.col("c_acctbal").alias("v")),
    }
    written = tables.write_report(parts, scratch_path(spark, "report"), "json")
    read = [spark.read.schema("v double").json(path).select(F.lit(n).alias("table"), "v") for n, path in written.items()]
    return rows.union_all(*read).groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("cumulative_share", """WITH g AS (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_shipdate, n, CAST(sum(n) OVER (ORDER BY l_shipdate) AS DOUBLE) AS cumulative,
       round(sum(n) OVER (ORDER BY l_shipdate)::DOUBLE / sum(n) OVER (), 6) AS share FROM g""")
def cumulative_share(spark, folder):
    per_day = table(spark, folder, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return aggregate.cumulative_share(per_day, [("l_shipdate", True)], "n")


@query("threshold_index", """WITH g AS (SELECT l_linenumber AS i, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT i, sum(n) OVER (ORDER BY i)::DOUBLE / sum(n) OVER () AS share FROM g)
SELECT coalesce(min(i) FILTER (WHERE share >= 0.7), 1) AS i FROM c""")
def threshold_index(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return rows.first_reaching(aggregate.cumulative_share(counts, [("i", True)], "n"), "i", "share", 0.7)


@query("union_subsets", """SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_returnflag = 'N'""")
def union_subsets(spark, folder):
    base = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return rows.union_all(*[base.filter(F.col("l_returnflag") == f) for f in ("A", "R", "N")])


@query("sorted_groups", """SELECT p_brand, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1 ORDER BY 2 DESC, 1""")
def sorted_groups(spark, folder):
    means = table(spark, folder, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"))
    return rows.sorted_by(means, [("mean_price", False), ("p_brand", True)])


@query("top_n", """SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 2""")
def top_n(spark, folder):
    return rows.top_n(table(spark, folder, "part").select("p_partkey", "p_retailprice"), [("p_retailprice", False), ("p_partkey", True)], 2)


@query("best_row", """WITH g AS (SELECT p_size, max(p_retailprice) AS price FROM part GROUP BY 1)
SELECT p_size, price FROM g ORDER BY price DESC, p_size LIMIT 1""")
def best_row(spark, folder):
    groups = table(spark, folder, "part").groupBy("p_size").agg(F.max("p_retailprice").alias("price"))
    return rows.best_row(groups, "price", "p_size")


@query("shuffled", """SELECT p_partkey, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':5805')) AS position FROM part""")
def shuffled(spark, folder):
    return sampling.shuffled(table(spark, folder, "part").select("p_partkey"), "p_partkey")


def split_sql(source, key, label):
    """CTEs that give every row of ``source`` its split, as a suffix to other CTEs."""
    return f"""
split_counts AS (SELECT {label} AS c, count(*) AS n FROM {source} WHERE {label} IS NOT NULL GROUP BY 1),
split_total AS (SELECT ceil(round(sum(n) * 0.2, 9)) AS t, sum(n)::DOUBLE AS s FROM split_counts),
split_exact AS (SELECT c, t, t * n / s AS e, floor(t * n / s) AS f FROM split_counts, split_total),
split_extra AS (SELECT c, f, row_number() OVER (ORDER BY round(e - f, 9) DESC, CAST(c AS VARCHAR)) AS r, t - sum(f) OVER () AS rest FROM split_exact),
split_size AS (SELECT c, f + CASE WHEN r <= rest THEN 1 ELSE 0 END AS size FROM split_extra),
split_rank AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR) || ':5805')) AS split_rn
               FROM {source} WHERE {label} IS NOT NULL),
splitted AS (SELECT split_rank.* EXCLUDE (split_rn), CASE WHEN split_rn <= size THEN 'test' ELSE 'train' END AS split
             FROM split_rank JOIN split_size ON {label} = c)"""


@query("stratified_split", f"""WITH {LABELLED}, {split_sql('labelled', 'stop_id', 'arrival_status')}
SELECT stop_id, arrival_status, split FROM splitted""")
def stratified_split(spark, folder):
    return sampling.stratified_split(labelled(spark, folder).select("stop_id", "arrival_status"), "stop_id", "arrival_status")


@query("plain_split", f"""WITH o AS (SELECT o_orderkey, 1 AS one FROM orders), {split_sql('o', 'o_orderkey', 'one')}
SELECT o_orderkey, split FROM splitted""")
def plain_split(spark, folder):
    return sampling.plain_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("stratified_folds", """SELECT o_orderkey, o_orderstatus,
  ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':5805')) - 1 AS fold FROM orders""")
def stratified_folds(spark, folder):
    return sampling.stratified_folds(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("undersample", """WITH c AS (SELECT min(n) AS low FROM (SELECT count(*) AS n FROM labels GROUP BY quality)),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':5805')) AS rn FROM labels)
SELECT doc_id, quality FROM r, c WHERE rn <= low""")
def undersample(spark, folder):
    return sampling.undersample(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("oversample", f"""WITH {LABELLED},
r AS (SELECT stop_id, arrival_status, row_number() OVER (PARTITION BY arrival_status ORDER BY md5(CAST(stop_id AS VARCHAR) || ':5805')) AS rn FROM labelled),
c AS (SELECT arrival_status, count(*) AS n, max(count(*)) OVER () AS top FROM labelled GROUP BY 1),
d AS (SELECT arrival_status, n, unnest(generate_series(1, top)) AS draw FROM c),
p AS (SELECT arrival_status, draw,
        CAST('0x' || substr(md5(arrival_status || ':' || CAST(draw AS VARCHAR) || ':5805'), 1, 15) AS BIGINT) % n + 1 AS rn FROM d)
SELECT stop_id, arrival_status, draw FROM p JOIN r USING (arrival_status, rn)""")
def oversample(spark, folder):
    return sampling.balance(labelled(spark, folder).select("stop_id", "arrival_status"), "stop_id", "arrival_status")


@query("load_trips", f"""WITH {TRIPS}
SELECT 'stops' AS level, arrival_status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS proportion FROM labelled GROUP BY 2
UNION ALL SELECT 'trips', arrival_status, count(*), round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) FROM trips GROUP BY 2""")
def load_trips(spark, folder):
    loaded = phases.load_trips(stops(spark, folder))
    of_trips = aggregate.class_distribution(phases.clean_trips(loaded["trips"]), "arrival_status")
    return loaded["stop_classes"].select(F.lit("stops").alias("level"), "*").unionByName(
        of_trips.select(F.lit("trips").alias("level"), "*"))


@query("clean_trips", f"""WITH {TRIPS}
SELECT trip_id, arrival_status, time_of_day, day_of_weeks, long_delay, round(delay_minutes, 6) AS delay_minutes FROM trips""")
def clean_trips(spark, folder):
    return trips(spark, folder).select("trip_id", "arrival_status", "time_of_day", "day_of_weeks", "long_delay", "delay_minutes")


EXPLORED = (("by_day_part", "time_of_day"), ("by_date", "CAST(date AS VARCHAR)"), ("by_sequence", "CAST(stop_sequence AS VARCHAR)"),
            ("by_weekday", "day_of_weeks"))


@query("explore", f"WITH {TRIPS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS part, {key} AS key, round(avg(delay_minutes), 9) AS value FROM trips GROUP BY 2" for name, key in EXPLORED)
    + " UNION ALL SELECT 'long_delay_by_line', line, round(avg(long_delay::INT), 9) FROM trips GROUP BY 2", digits=9)
def explore(spark, folder):
    parts = phases.explore(trips(spark, folder))
    keyed = [
        part.select(F.lit(name).alias("part"), F.col(part.columns[0]).cast("string").alias("key"), F.col(part.columns[-1]).alias("value"))
        for name, part in parts.items()
    ]
    return rows.union_all(*keyed)

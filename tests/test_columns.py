import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from colonnade.functions import derive
from colonnade.operators import aggregate, encode, rows


def test_delay_class_bounds(spark):
    values = [-0.51, -0.5, 0.0, 0.5, 0.51, None, math.nan]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, m double")
    got = [r[0] for r in df.orderBy("id").select(derive.delay_class("m")).collect()]
    assert got == ["early", "on-time", "on-time", "on-time", "late", "late", "late"]
    flags = [r[0] for r in df.orderBy("id").select(derive.exceeds("m", 0.5)).collect()]
    assert flags == [False, False, False, False, True, False, False]


def test_day_part_bounds(spark):
    hours = [4, 5, 11, 12, 16, 17, 20, 21, None]
    data = [(i, None if h is None else dt.datetime(2024, 1, 1, h, 30)) for i, h in enumerate(hours)]
    df = spark.createDataFrame(data, "id int, ts timestamp_ntz")
    got = [r[0] for r in df.orderBy("id").select(derive.day_part("ts")).collect()]
    assert got == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night", "night"]


def test_parsing_is_lenient_or_strict(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00.5",), ("soon",), (None,)], "s string")
    got = [r[0] for r in df.select(derive.parse_time("s")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 10, 0, 0, 500000), None, None]
    with pytest.raises(Exception):
        df.select(derive.parse_time("s", strict=True)).collect()
    assert [r[0] for r in df.select(derive.to_number(F.lit("1e3")), derive.to_number("s")).collect()] == [1000.0] * 3


def test_calendar_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7),), (dt.datetime(2024, 1, 7, 7),)], "ts timestamp_ntz")
    got = derive.calendar(df, "ts").orderBy("ts").select("day_of_week", "is_weekend").collect()
    assert [tuple(r) for r in got] == [(0, False), (6, True)]


def test_recode_keeps_other_values(spark):
    df = spark.createDataFrame([("early",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(derive.recode("s", derive.STATUS_CODES)).collect()] == ["1", "other", None]


def test_rollup_skips_nulls_per_column(spark):
    data = [("d", "t", 1, 1, "a", 5.0), ("d", "t", 2, 2, None, 6.0), ("d", "t", 3, 3, "c", None), ("d", None, 1, 4, "x", 1.0)]
    df = spark.createDataFrame(data, "date string, train_id string, stop_sequence int, stop_id int, line string, delay double")
    got = aggregate.trip_rollup(df, first=["line"], last=["delay"], order=["stop_sequence", "stop_id"]).collect()
    assert [tuple(r) for r in got] == [("d", "t", "a", 6.0)]


def test_scaling_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0), (3, None, None)], "id int, a double, b double")
    z = encode.zscore(df, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in z] == [(0.0, -1.0), (0.0, 1.0), (None, None)]
    m = encode.minmax(df, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in m] == [(0.0, 0.0), (0.0, 1.0), (None, None)]


def test_one_hot_null_is_all_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, c string")
    out = encode.one_hot(df, ["c"], drop_first=False).orderBy("id")
    assert out.columns == ["id", "c_a", "c_b"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 1), (1, 0), (0, 0)]


def test_first_reaching_defaults_to_one(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.6)], "i int, v double")
    assert rows.first_reaching(df, "i", "v", 0.5).first()[0] == 2
    assert rows.first_reaching(df, "i", "v", 0.95).first()[0] == 1


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert tuple(aggregate.duplicate_count(df).first()) == (3, 2, 1)
    assert aggregate.drop_duplicates(df).count() == 2


def test_wide_one_hot_equals_the_narrow_one(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, "c", "y"), (4, None, "x"), (5, "b", "z")]
    df = spark.createDataFrame(rows, "id int, p string, q string")
    narrow = encode.one_hot(df, ["p", "q"])
    want = {r.id: list(r)[1:] for r in narrow.collect()}
    got = encode.one_hot_vector(df, ["p", "q"])
    assert got.columns == ["id", "features"]
    assert {r.id: r.features.toArray().tolist() for r in got.collect()} == want
    full = encode.one_hot_vector(df, ["p"], drop_first=False)
    assert {r.id: r.features.toArray().tolist() for r in full.collect()} == {1: [1, 0, 0], 2: [0, 0, 1], 3: [0, 1, 0], 4: [0, 0, 0], 5: [1, 0, 0]}
    # Values the index does not know, and a column of one value, give no entry.
    index = encode.category_index(df, ["p", "q"])
    new = spark.createDataFrame([(9, "new", "x")], "id int, p string, q string")
    assert encode.one_hot_vector(new, ["p", "q"], index=index).first().features.toArray().tolist() == [0, 0, 0, 0]
    flat = spark.createDataFrame([(1, "s", "t"), (2, "s", "u")], "id int, p string, q string")
    assert {r.id: r.features.toArray().tolist() for r in encode.one_hot_vector(flat, ["p", "q"]).collect()} == {1: [0.0], 2: [1.0]}


def test_a_column_of_50000_values_goes_into_a_fit(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(60_000).select(
        F.concat(F.lit("v"), F.col("id") % 50_000).alias("p"), (F.col("id") % 3).cast("string").alias("q"), (F.col("id") % 2).cast("double").alias("y"))
    with pytest.raises(ValueError):
        encode.one_hot(df, ["p"])
    rows = encode.one_hot_vector(df, ["p", "q"])
    model = LogisticRegression(labelCol="y", maxIter=3, regParam=0.001).fit(rows)
    assert model.numFeatures == 49_999 + 2
    hit = model.transform(rows).filter("prediction = y").count()
    assert hit > 55_000

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colonnade.operators import ordering, sampling


def _skewed(spark, n=2000):
    """A third of the rows share one value and one class."""
    i = F.col("id")
    return spark.range(n).select(
        "id", F.when(i % 3 == 0, 7).otherwise((i * 37 % 101)).cast("double").alias("v"),
        F.when(i % 3 == 0, "hot").when(i % 7 == 0, "mid").otherwise("low").alias("c"))


@pytest.mark.parametrize("buckets", [1, 7, 64])
@pytest.mark.parametrize("by", [[], ["c"]])
def test_running_totals_equal_a_plain_window(spark, buckets, by):
    df = _skewed(spark).repartition(5)
    order = [("v", False), ("id", True)]
    got = ordering.running_totals(df, order, {"n": F.lit(1), "s": F.col("v")}, by, buckets)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("v").desc(), "id")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rank_with_text_keys_and_mixed_directions(spark):
    df = _skewed(spark, 300).withColumn("t", F.concat("c", F.col("v").cast("string")))
    got = {r.id: r["rank"] for r in ordering.ranked(df, [("t", True), ("v", False), ("id", True)], buckets=9).collect()}
    w = Window.partitionBy(F.lit(0)).orderBy("t", F.col("v").desc(), "id")
    assert got == {r.id: r.r for r in df.select("id", F.row_number().over(w).alias("r")).collect()}


def test_split_is_exact_and_layout_independent(spark):
    df = _skewed(spark)
    a = sampling.stratified_split(df.repartition(1), "id", "c")
    b = sampling.stratified_split(df.repartition(7), "id", "c")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sizes = sampling.test_sizes(sampling.class_counts(df, "c"), 0.2)
    got = {r.c: r["count"] for r in a.filter("split = 'test'").groupBy("c").count().collect()}
    assert got == sizes and sum(sizes.values()) == 400


def test_folds_are_even_and_small_classes_survive(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(23)], "id int, c string")
    got = sampling.stratified_folds(df, "id", "c", 5)
    sizes = sorted(r["count"] for r in got.filter("c = 'a'").groupBy("fold").count().collect())
    assert sizes == [4, 4, 4, 5, 5] and got.count() == 23
    split = sampling.stratified_split(df, "id", "c")
    assert split.filter("split = 'test'").count() == 5


@pytest.mark.parametrize("folds", [2, 5])
def test_split_with_folds(spark, folds):
    small = spark.createDataFrame([(5000 + i, 1.0, "tiny") for i in range(3)] + [(6000, 1.0, "one")], "id long, v double, c string")
    df = _skewed(spark).unionByName(small)
    got = sampling.split_and_folds(df.repartition(3), "id", "c", folds=folds)
    plain = sampling.stratified_split(df, "id", "c")
    assert sorted(got.select("id", "split").collect()) == sorted(plain.select("id", "split").collect())
    assert got.filter("(split = 'test') <> (fold = -1)").count() == 0
    for r in got.filter("fold >= 0").groupBy("c").pivot("fold", list(range(folds))).count().na.fill(0).collect():
        assert max(r[1:]) - min(r[1:]) <= 1


def test_balancing(spark):
    df = _skewed(spark)
    counts = sampling.class_counts(df, "c")
    over = {r.c: r["count"] for r in sampling.oversample(df, "id", "c").groupBy("c").count().collect()}
    under = sampling.undersample(df, "id", "c")
    assert set(over.values()) == {max(counts.values())}
    assert {r["count"] for r in under.groupBy("c").count().collect()} == {min(counts.values())}
    assert under.select("id").distinct().count() == under.count()
    with pytest.raises(ValueError):
        sampling.balance(df, "id", "c", "both")


def test_shuffle_is_a_permutation(spark):
    got = sampling.shuffled(_skewed(spark, 500).select("id"), "id").collect()
    assert sorted(r.position for r in got) == list(range(1, 501))
    assert [r.id for r in got] != sorted(r.id for r in got)


def test_draws_are_not_broadcast(spark):
    """Spark sees a few chunks of draw numbers where the draws are as many as the table's rows."""
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)
    try:
        out = sampling.oversample(spark.range(200_000).select("id", (F.col("id") % 3 == 0).cast("string").alias("c")), "id", "c")
        rows = out.toArrow().num_rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    joins = re.findall(r"(\w+Join) \[c#\d+, _rn#", out._jdf.queryExecution().executedPlan().toString())
    assert rows == 2 * 133_333 and joins and set(joins) == {"SortMergeJoin"}

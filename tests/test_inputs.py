"""The study on a CSV as it comes: columns in any order, station names, lines with a dot, ids that are text."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.models.direct import TreeNodes
from colonnade.operators import density, encode, evaluate, ordering
from colonnade.operators.itemsets import baskets
from colonnade.plans import phases
from colonnade.sources import tables

HEADER = ["type", "status", "delay_minutes", "to", "date", "line", "from_id", "train_id", "actual_time", "stop_sequence", "scheduled_time", "to_id", "from", "note"]


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    pick = random.Random(3)
    lines = ["Bergen Co. Line", "No Jersey Coast", "Main.Line", "Main_Line"]
    rows = [",".join(HEADER)]
    for train, day, stop in itertools.product(range(30), range(1, 8), range(1, 4)):
        planned = dt.datetime(2020, 3, day, 5 + train % 18, 10 * stop)
        delay = pick.choice([-2.0, 0.0, 0.2, 3.0, 7.5, 20.0])
        row = {
            "type": "rail", "status": pick.choice(["departed", "estimated"]), "delay_minutes": delay, "to": f"Station {stop + 1}",
            "date": planned.date(), "line": lines[train % 4], "from_id": stop, "train_id": f"A{train}",
            "actual_time": planned + dt.timedelta(minutes=delay), "stop_sequence": stop, "scheduled_time": planned, "to_id": stop + 1,
            "from": f"Station {stop}", "note": "x.y",
        }
        rows.append(",".join(str(row[c]) for c in HEADER))
    path = tmp_path_factory.mktemp("csv") / "stops.csv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_columns_are_found_by_name(spark, csv):
    got = tables.read_stops(spark, csv)
    assert got.columns == [*HEADER, "stop_id"]
    row = got.filter("train_id = 'A4' and stop_sequence = 2 and day(date) = 3").first()
    assert (row["line"], row["from"], row["from_id"], row["date"]) == ("Bergen Co. Line", "Station 2", 2, dt.date(2020, 3, 3))
    assert got.select("stop_id").distinct().count() == got.count()


def test_missing_column_and_corrupt_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,line\n2020-01-01,x\n")
    with pytest.raises(ValueError, match="train_id"):
        tables.read_stops(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("k,line\n1,x\nmany,y\n")
    rows = tables.read_csv(spark, str(tmp_path / "b.csv"), corrupt="bad").cache()
    assert {(r.k, r.line, r.bad) for r in rows.collect()} == {(1, "x", None), (None, "y", "many,y")}


def test_load_and_clean(spark, csv):
    loaded = phases.load_trips(tables.read_stops(spark, csv))
    assert {(r["from"], r.from_id) for r in loaded["from_lookup"].collect()} == {(f"Station {i}", i) for i in (1, 2, 3)}
    assert {(r["to"], r.to_id) for r in loaded["to_lookup"].collect()} == {(f"Station {i}", i) for i in (2, 3, 4)}
    assert loaded["trips"].count() == 210
    assert phases.clean_trips(loaded["trips"]).count() == 210


def test_prepare_with_dotted_categories(spark, csv):
    config = phases.StudyConfig(trees=3, max_depth=3, folds=2, restarts=1, ks=range(2, 4))
    out = phases.prepare(tables.read_stops(spark, csv), config)
    assert out["prepared"].count() > 100


def test_mine_with_text_ids(spark, csv):
    trips = phases.with_features(phases.clean_trips(phases.load_trips(tables.read_stops(spark, csv))["trips"]))
    config = phases.StudyConfig(restarts=1, ks=range(2, 4))
    out = phases.cluster_and_mine(trips, "trip_id", ["delay_minutes", "stop_sequence"], ["time_of_day", "line"], config)
    assert out["dbscan_count"].first().clusters >= 1
    assert out["itemsets"].count() > 0


def test_dummy_names_need_no_quoting(spark):
    df = spark.createDataFrame([("a.b",), ("a_b",), ("c",), (None,)], "line string")
    out = encode.one_hot(df, ["line"], drop_first=False)
    assert len(set(out.columns)) == 3 and not any("." in c for c in out.columns)
    assert out.agg(*[F.sum(c) for c in out.columns]).first() == (1, 1, 1)
    names = encode.label_indicators(spark.createDataFrame([("on-time",), ("on_time",)], "s string"), "s").columns
    assert len(set(names)) == 3


def test_constant_up_to_rounding(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (0.3,)], "x double")
    assert {r.x for r in encode.zscore(df).collect()} == {0.0}


def test_baskets_of_many_values(spark):
    df = spark.range(12_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("t"))
    assert baskets(df, ["t"]).filter(F.size("items") == 0).count() == 1


@pytest.mark.parametrize("kind", ["double", "date", "timestamp", "string"])
@pytest.mark.parametrize("up", [True, False])
def test_ranks_equal_a_plain_window(spark, kind, up):
    pick = random.Random(5)
    rows = [(i, pick.choice("abc") if i % 11 else None, None if i % 13 == 0 else pick.randrange(40)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, n int").repartition(5)
    value = {
        "double": F.when(F.col("n") == 7, float("nan")).otherwise(F.col("n") - 20.0), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")),
        "timestamp": F.timestamp_seconds(F.col("n") * 100), "string": F.concat(F.lit("v"), F.col("n").cast("string")),
    }[kind]
    df = df.withColumn("v", value)
    order = [("v", up), ("id", True)]
    from pyspark.sql import Window

    for by in ([], ["g"]):
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("v").asc() if up else F.col("v").desc(), "id")
        want = {r.id: r.r for r in df.withColumn("r", F.row_number().over(window)).collect()}
        assert {r.id: r["rank"] for r in ordering.ranked(df, order, by=by).collect()} == want


def test_dbscan_takes_text_ids(spark):
    points = [(f"p{i}", float(i % 10) * 0.1, float(i // 10) * 0.1) for i in range(50)] + [("far", 9.0, 9.0)]
    got = {r.id: r.label for r in density.dbscan(spark.createDataFrame(points, "id string, x double, y double"), "id", ["x", "y"], 0.2, 4).collect()}
    assert got["far"] is None and {v for k, v in got.items() if k != "far"} == {"p0"}


def test_pairwise_curves_have_origins(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.2, 0.8), ("a", 0.4, 0.6)], "label string, pa double, pb double")
    out = evaluate.pairwise_roc(df, {"a": F.col("pa"), "b": F.col("pb")}).collect()
    assert sum(r.threshold is None and r.tp == r.fp == 0 for r in out) == 1




def brute_path(shape):
    cut, out, alpha = set(), [(0.0, frozenset(shape.leaf_of.values()))], 0.0

    def under(n):
        return [n] if n not in shape.left or n in cut else under(shape.left[n]) + under(shape.right[n])

    while 0 in shape.left and 0 not in cut:
        live = [n for n in shape.left if n not in cut and not any(a in cut for a in above(shape, n))]
        gain = {n: (shape.cost(n) - sum(map(shape.cost, under(n)))) / (len(under(n)) - 1) for n in live}
        low = min(gain.values())
        cut |= {n for n in live if gain[n] <= low + 1e-12}
        alpha = max(alpha, low)
        out.append((alpha, frozenset(under(0))))
    return out


def above(shape, n):
    while n in shape.parent:
        n = shape.parent[n]
        yield n


def random_tree(seed, splits):
    pick, nodes, open_ = random.Random(seed), [{"id": 0, "leftChild": -1, "rightChild": -1}], [0]
    for _ in range(splits):
        at = open_.pop(pick.randrange(len(open_)))
        a, b = len(nodes), len(nodes) + 1
        nodes[at].update(leftChild=a, rightChild=b)
        nodes += [{"id": a, "leftChild": -1, "rightChild": -1}, {"id": b, "leftChild": -1, "rightChild": -1}]
        open_ += [a, b]
    counts = {i: np.array([pick.randrange(1, 30), pick.randrange(30), pick.randrange(30)], float) for i in range(splits + 1)}
    return TreeNodes(nodes, counts, 3)


@pytest.mark.parametrize("seed", range(12))
def test_pruning_path_equals_brute_force(seed):
    shape = random_tree(seed, 1 + 2 * seed)
    now = dict(shape.leaf_of)
    got = []
    for alpha, cut in shape.path():
        shape.ends(cut, now)
        got.append((alpha, frozenset(now.values())))
    want = brute_path(shape)
    assert [ends for _, ends in got] == [ends for _, ends in want]
    assert np.allclose([a for a, _ in got], [a for a, _ in want])


def test_pruning_path_of_a_large_tree_is_quick():
    import time

    shape = random_tree(1, 50_000)
    started = time.perf_counter()
    assert shape.path()[-1][1] == [0]
    assert time.perf_counter() - started < 30

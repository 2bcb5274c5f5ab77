import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.catalogue import learning
from colonnade.catalogue.registry import QUERIES
from colonnade.models import builtin, composed, direct, ensembles
from colonnade.models.frame import make_frame, probability_scores
from colonnade.operators import evaluate, itemsets
from colonnade.plans import phases
from colonnade.sources import tables

BASKETS = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["a"], [], ["a", "b", "c", "d"]]


def _sets(spark, **kw):
    df = spark.createDataFrame([(b,) for b in BASKETS], "items array<string>")
    return itemsets.frequent_itemsets(df, 0.3, **kw)


def test_itemsets_and_rules_match_a_count(spark, monkeypatch):
    want = {}
    for size in (1, 2, 3):
        for s in itertools.combinations("abcd", size):
            n = sum(set(s) <= set(b) for b in BASKETS)
            if n / 6 >= 0.3:
                want[s] = n
    got = {tuple(r.itemset): r.freq for r in _sets(spark).collect()}
    assert got == want
    assert {s for s in got if len(s) <= 2} == {tuple(r.itemset) for r in _sets(spark, max_size=2).collect()}
    monkeypatch.setattr(itemsets, "SUBSET_WIDTH", 1)
    assert {tuple(r.itemset): r.freq for r in _sets(spark).collect()} == want
    rules = itemsets.association_rules(_sets(spark)).collect()
    assert len(rules) == 2 * 3 + 6
    for r in rules:
        a, c = tuple(r.antecedent), tuple(r.consequent)
        both = want[tuple(sorted(a + c))] / 6
        assert r.confidence == pytest.approx(both / (want[a] / 6))
        assert r.lift == pytest.approx(r.confidence / (want[c] / 6))
    assert any(len(r.consequent) == 2 for r in rules)


@pytest.mark.parametrize("least", [0.1, 0.55, 0.9])
def test_rules_of_wide_baskets_equal_a_count(spark, least):
    rng = np.random.default_rng(5)
    rows = [sorted({f"i{j:02d}" for j in range(30) if rng.random() < (0.85 if j < 6 else 0.25)}) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    sets = itemsets.frequent_itemsets(df, 0.2, max_size=5)
    freq = {tuple(r.itemset): r.freq for r in sets.collect()}
    assert max(map(len, freq)) == 5 and any("i20" in s for s in freq)
    want = {}
    for s, n in freq.items():
        for size in range(1, len(s)):
            for c in itertools.combinations(s, size):
                a = tuple(x for x in s if x not in c)
                if (n / 300) / (freq[a] / 300) >= least:
                    want[a, c] = n / freq[a]
    got = {(tuple(r.antecedent), tuple(r.consequent)): r.confidence for r in itemsets.association_rules(sets, least).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_baskets_leave_the_first_category_out(spark):
    df = spark.createDataFrame([("x", "u"), ("y", None)], "p string, q string")
    assert [r[0] for r in itemsets.baskets(df).collect()] == [[], ["p_y"]]
    assert [r[0] for r in itemsets.baskets(df, drop_baseline=False).collect()] == [["p_x", "q_u"], ["p_y"]]


def test_auc_of_ties_and_extremes(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 0.9), (False, 0.1)], "y boolean, s double")
    assert evaluate.auc(df, "s", F.col("y")).first()[0] == pytest.approx(0.875)
    assert evaluate.auc(df, -F.col("s"), F.col("y")).first()[0] == pytest.approx(0.125)
    assert evaluate.auc(df.filter("y"), "s", F.col("y")).first()[0] is None


def test_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "label string, prediction string")
    row = {r["class"]: r for r in evaluate.per_class(df).collect()}["b"]
    assert (row.precision, row.recall, row.f1, row.specificity) == (0.0, 0.0, 0.0, 1.0)
    assert evaluate.weighted_metrics(df).first().accuracy == pytest.approx(2 / 3)


@pytest.fixture(scope="module")
def frame(spark):
    """Three classes that follow from two of the three columns."""
    i = F.col("id")
    a, b, noise = (F.pmod(F.xxhash64(i, F.lit(s)), F.lit(1000)) / 100.0 for s in (1, 2, 3))
    df = spark.range(900).select("id", a.alias("a"), b.alias("b"), noise.alias("noise")).withColumn(
        "y", F.when(F.col("a") + F.col("b") < 8, "low").when(F.col("a") + F.col("b") < 12, "mid").otherwise("top"))
    return make_frame(df, "y", ["a", "b", "noise"], "id", folds=2)


RUNS = {
    "tree": (lambda f: ensembles.decision_tree(f, {"max_depth": [2, 8]}), 0.85),
    "pruned": (lambda f: direct.pruned_tree(f, 8)[0], 0.8),
    "logistic": (lambda f: builtin.logistic(f, {"c": [10.0], "max_iter": [50]}), 0.9),
    "knn": (lambda f: direct.nearest_neighbors(f, {"k": [3, 7], "weights": ["distance"], "p": [1, 2]}), 0.75),
    "bayes": (lambda f: direct.naive_bayes(f), 0.8),
    "network": (lambda f: builtin.neural_network(f, {"hidden": [6], "max_iter": [60]}), 0.8),
    "forest": (lambda f: ensembles.random_forest(f, {"trees": [15], "max_depth": [6]}), 0.85),
    "bagging": (lambda f: ensembles.bagging(f, {"estimators": [5], "column_share": [1.0], "max_depth": [6]}), 0.8),
    "boosting": (lambda f: ensembles.boosting(f, {"rounds": [5], "rate": [0.2], "max_depth": [4]}), 0.8),
    "svm": (lambda f: composed.svm(f, {"kernel": ["poly"], "max_iter": [15]}), 0.7),
    "stacking": (lambda f: composed.stacking(f, {"c": [1.0]}, {"trees": 5, "max_depth": 6}, {"kernel": "linear", "max_iter": 10}), 0.8),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_classifier_learns(spark, frame, name):
    run, least = RUNS[name]
    result = run(frame)
    row = evaluate.metric_table(result.predictions, probability_scores(frame.classes)).first()
    assert row.test_accuracy >= least and row.auc > 0.8
    assert sum(map(sum, row.confusion)) == frame.test.count()
    sums = result.predictions.select(F.aggregate("probability", F.lit(0.0), lambda x, v: x + v).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    assert result.predictions.count() == frame.data.count()


def test_pruning_path_is_nested(frame):
    path = direct.pruned_tree(frame, 8)[1].collect()
    alphas, leaves = [r.alpha for r in path], [r.leaves for r in path]
    assert alphas == sorted(alphas) and leaves == sorted(leaves, reverse=True) and leaves[-1] == 1


def test_naive_bayes_equals_numpy(frame):
    rows = frame.data.orderBy("id").toPandas()
    train, cols = rows[rows.split == "train"], frame.columns
    eps = 1e-9 * train[cols].var(ddof=0).max()
    score = np.column_stack([
        np.log(len(g) / len(train)) - 0.5 * (np.log(2 * np.pi * (g[cols].var(ddof=0) + eps)).sum())
        - ((rows[cols] - g[cols].mean()) ** 2 / (2 * (g[cols].var(ddof=0) + eps))).sum(axis=1)
        for _, g in train.groupby("label")])
    want = [frame.classes[i] for i in score.argmax(axis=1)]
    got = direct.naive_bayes(frame, [1e-9]).predictions.orderBy("id").toPandas()["prediction"].tolist()
    assert got == want


def test_importance_and_subsets(frame):
    table = ensembles.classification_importance(frame, trees=10, max_depth=5).orderBy("rank").collect()
    assert {table[0].feature, table[1].feature} == {"a", "b"}
    good = builtin.subset_accuracy(frame, ["a", "b"], trees=10, max_depth=6)
    assert good > builtin.subset_accuracy(frame, ["noise"], trees=10, max_depth=6)
    assert builtin.subset_accuracy(frame, ["a", "b"], "logistic", max_iter=30) > 0.8


def test_fits_that_ended_serve_larger_limits(frame, monkeypatch):
    """Steps do not depend on their largest number: a fit that ended before it is not repeated with a larger one."""
    asked, fit = [], builtin.fit_logistic
    monkeypatch.setattr(builtin, "fit_logistic", lambda train, f, **p: (asked.append(p["max_iter"]), fit(train, f, **p))[1])
    found = {r.params: r.mean_accuracy for r in builtin.logistic(frame, {"c": [1.0], "max_iter": [500, 2, 900]}).cv.collect()}
    assert sorted(asked)[:4] == [2, 2, 500, 500] and asked.count(900) == 0
    assert len(found) == 3 and found['{"c": 1.0, "max_iter": 500}'] == found['{"c": 1.0, "max_iter": 900}']


def test_binary_logistic(spark, frame):
    df = frame.data.withColumn("top", F.when(F.col("label") == "top", "yes").otherwise("no"))
    two = make_frame(df, "top", ["a", "b"], "id", folds=2)
    row = builtin.binary_logistic(two, "yes").first()
    assert row.auc > 0.95 and row.tp + row.tn + row.fp + row.fn == two.test.count()
    with pytest.raises(ValueError):
        builtin.binary_logistic(frame, "top")


@pytest.mark.parametrize("method", ["oversample", "undersample"])
def test_balanced_frame_touches_training_rows_only(frame, method):
    even = frame.balanced(method)
    assert len({r["count"] for r in even.train.groupBy("label").count().collect()}) == 1
    assert even.test.count() == frame.test.count()
    assert even.data.select("id").distinct().count() == even.data.count()
    result = direct.nearest_neighbors(even, {"k": [3], "weights": ["uniform"], "p": [2]})
    assert result.predictions.count() == even.data.count()


CONFIG = phases.StudyConfig(trees=5, max_depth=4, folds=2, ks=range(2, 4), restarts=1)


def test_study_phases_run_end_to_end(spark):
    stops = tables.stops(spark, "/root/testdata/sf0.001")
    out = phases.prepare(stops, CONFIG)
    sizes = {r["count"] for r in out["prepared"].groupBy("arrival_status").count().collect()}
    assert len(sizes) == 1
    assert out["scores"].filter("best").count() == 1
    assert out["kept"].count() <= out["encoded"].count()
    mined = phases.cluster_and_mine(phases.with_features(out["clean"]), "trip_id", ["delay_minutes", "stop_sequence"], ["time_of_day", "arrival_status"], CONFIG)
    assert mined["kmeans_curve"].filter("best").count() == 1
    assert mined["k_distance"].count() == out["clean"].count()


def test_first_columns_stand_in_for_components(spark):
    rows = phases.one_hot(phases.with_features(phases.clean_trips(phases.load_trips(tables.stops(spark, "/root/testdata/sf0.001"))["trips"])), ["line"])
    rows = rows.drop("status", "type")
    cfg = dict(trees=2, max_depth=3, folds=2, encode=("line",))
    first = phases.select_features(rows, phases.StudyConfig(first_n_columns=True, **cfg))
    named = {r.selector: r.features.split(",") for r in first["scores"].collect()}
    n = first["pca"].first().n95
    numeric = [c for c in phases.column_names(rows) if c != "arrival_minutes"]
    assert named["pca"] == numeric[:n] and n > 1


MODEL_QUERIES = {
    "tree_grid": (ensembles, "decision_tree"), "cv_results": (ensembles, "decision_tree"), "logistic_grid": (builtin, "logistic"),
    "mlp_grid": (builtin, "neural_network"), "forest_grid": (ensembles, "random_forest"), "bagging_grid": (ensembles, "bagging"),
    "boosting_grid": (ensembles, "boosting"), "stacking_grid": (composed, "stacking"), "svm_grid": (composed, "svm"),
}


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_queries_run_the_full_grids(monkeypatch, name):
    class Called(Exception):
        pass

    def called(*args, **params):
        raise Called(args[1:], params)

    monkeypatch.setattr(learning, "_frame", lambda spark, folder: None)
    monkeypatch.setattr(*MODEL_QUERIES[name], called)
    with pytest.raises(Called) as found:
        QUERIES[name](None, "")
    assert found.value.args == ((), {})


def test_study_queries_run_the_full_settings(monkeypatch):
    for name in ("GRIDS", "CONFIG"):
        assert not hasattr(learning, name)
    assert list(phases.StudyConfig().ks) == list(range(2, 21)) and phases.StudyConfig().restarts == 10
    seen = []
    monkeypatch.setattr(learning, "labelled", lambda spark, folder: None)
    monkeypatch.setattr(learning, "trips", lambda spark, folder: None)
    monkeypatch.setattr(phases, "compare_classifiers", lambda *a, **b: seen.append((len(a), b)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES["compare_classifiers"](None, "")
    monkeypatch.setattr(phases, "cluster_and_mine", lambda *a, **b: seen.append((len(a), b)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES["cluster_and_mine"](None, "")
    assert seen == [(4, {}), (4, {})]


def test_fits_of_several_folds_run_at_a_time(spark):
    import threading

    from colonnade.models import frame as frames

    rows = spark.range(200).selectExpr("id", "if(id % 2 = 0, 'a', 'b') AS label", "id % 2 + 0.0 AS x").coalesce(1)
    frame = frames.make_frame(rows, "label", ["x"], "id")
    frame = frames.ClassFrame(frame.data.coalesce(1), frame.classes, frame.columns, frame.folds)
    both, met, seen, turn = threading.Barrier(2), [], [], itertools.count()

    def fit(train, frame, right):
        # Only one line of settings, so that two fits can meet here only if they belong to two folds.
        seen.append(sorted(r.fold for r in train.select("fold").distinct().collect()))
        if next(turn) < 2:
            try:
                both.wait(30)
                met.append(True)
            except threading.BrokenBarrierError:
                pass
        truth = F.array(*[(F.col("label") == c).cast("double") for c in frame.classes])
        return lambda df: df.withColumn("probability", truth if right else F.array(F.lit(1.0), F.lit(0.0)))

    found = frames.cross_validate(frame, fit, [{"right": True}])
    assert len(met) == 2 and sorted(seen) == [[f for f in range(5) if f != out] for out in reversed(range(5))]
    assert found == [({"right": True}, pytest.approx(1.0))]

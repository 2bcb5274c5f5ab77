"""Model queries over all stops, with five folds and the library's full grids and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.catalogue.algebra import elimination_sql, least_squares_sql
from colonnade.catalogue.registry import LABELLED, TRIPS, labelled, query, stops, trips
from colonnade.catalogue.scoring import STEPS_SQL, rounded_steps, rounded_terms, terms_sql
from colonnade.catalogue.summaries import split_sql
from colonnade.functions import derive
from colonnade.models import builtin, composed, direct, ensembles
from colonnade.models.frame import make_frame, probability_scores
from colonnade.operators.evaluate import metric_table
from colonnade.plans import phases

COLUMNS = ["delay_minutes", "k", "stop_sequence", "from_id"]


def _frame(spark, folder):
    return make_frame(labelled(spark, folder), "arrival_status", COLUMNS, "stop_id")


def _metrics(frame, result):
    return metric_table(result.predictions, probability_scores(frame.classes)).withColumn("confusion", F.col("confusion").cast("string"))


def _register(name, run):
    def fn(spark, folder):
        frame = _frame(spark, folder)
        return _metrics(frame, run(frame))

    query(name)(fn)


_register("tree_grid", lambda f: ensembles.decision_tree(f))
_register("tree_pruned", lambda f: direct.pruned_tree(f)[0])
_register("logistic_grid", lambda f: builtin.logistic(f))
_register("knn_grid", lambda f: direct.nearest_neighbors(f))
_register("mlp_grid", lambda f: builtin.neural_network(f))
_register("forest_grid", lambda f: ensembles.random_forest(f))
_register("bagging_grid", lambda f: ensembles.bagging(f))
_register("boosting_grid", lambda f: ensembles.boosting(f))
_register("stacking_grid", lambda f: composed.stacking(f))
_register("svm_grid", lambda f: composed.svm(f))


@query("gaussian_nb", f"""WITH {LABELLED},
{split_sql('labelled', 'stop_id', 'arrival_status')},
t AS (SELECT * FROM splitted WHERE split = 'train'),
g AS (SELECT greatest(var_pop(delay_minutes), var_pop(k)) * 1e-9 AS eps, count(*)::DOUBLE AS n FROM t),
c AS (SELECT arrival_status AS c, ln(count(*) / max(g.n)) AS prior, avg(delay_minutes) AS md, var_pop(delay_minutes) + max(eps) AS vd,
             avg(k) AS mk, var_pop(k) + max(eps) AS vk FROM t, g GROUP BY 1),
s AS (SELECT stop_id, split, c, prior - 0.5 * (ln(2 * pi() * vd) + ln(2 * pi() * vk)) - (delay_minutes - md) * (delay_minutes - md) / (2 * vd)
             - (k - mk) * (k - mk) / (2 * vk) AS score FROM splitted, c),
r AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY score DESC, c) AS r FROM s)
SELECT stop_id, split, c AS prediction FROM r WHERE r = 1""")
def gaussian_nb(spark, folder):
    frame = make_frame(labelled(spark, folder), "arrival_status", ["delay_minutes", "k"], "stop_id")
    out = direct.naive_bayes(frame, [1e-9]).predictions
    return out.select(F.col("id").alias("stop_id"), "split", "prediction")


def _nb_sql() -> str:
    """Accuracy of every smoothing on each fold, by the statistics of the others."""
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in COLUMNS)
    largest = ", ".join(f"var_pop({c})" for c in COLUMNS)
    likely = " - ".join(
        ["ln(g.n / a.n)"] + [f"0.5 * ln(2 * pi() * (v_{c} + eps)) - (t.{c} - m_{c}) * (t.{c} - m_{c}) / (2 * (v_{c} + eps))" for c in COLUMNS])
    return f"""WITH {LABELLED}, {split_sql('labelled', 'stop_id', 'arrival_status')},
t AS (SELECT *, ntile(5) OVER (PARTITION BY arrival_status ORDER BY md5(CAST(stop_id AS VARCHAR) || ':5805')) - 1 AS fold FROM splitted WHERE split = 'train'),
other AS (SELECT f, t.* FROM t, (SELECT unnest(range(5)) AS f) WHERE fold <> f),
a AS (SELECT f, count(*)::DOUBLE AS n, greatest({largest}) AS widest FROM other GROUP BY f),
g AS (SELECT f, arrival_status AS c, count(*)::DOUBLE AS n, {stats} FROM other GROUP BY 1, 2),
e AS (SELECT unnest([{', '.join(f"{{'text': '{x}', 'value': {x}::DOUBLE, 'at': {i}}}" for i, x in enumerate(direct.SMOOTHING))}], recursive := true)),
s AS (SELECT t.stop_id, t.fold, t.arrival_status, text, "at", c, {likely} AS score
  FROM (SELECT e.*, a.*, value * widest AS eps FROM e, a) a JOIN g ON g.f = a.f JOIN t ON t.fold = a.f),
r AS (SELECT fold, text, "at", arg_max(c, score) = any_value(arrival_status) AS hit FROM s GROUP BY fold, text, "at", stop_id),
h AS (SELECT text, "at", avg(share) AS mean_accuracy FROM (SELECT fold, text, "at", avg(hit::INT) AS share FROM r GROUP BY ALL) GROUP BY ALL)
SELECT 'naive bayes' AS model, '{{"smoothing": ' || text || '}}' AS params, round(mean_accuracy, 6) AS mean_accuracy,
  row_number() OVER (ORDER BY round(mean_accuracy, 12) DESC, "at")::INTEGER AS rank FROM h"""


@query("nb_search", _nb_sql())
def nb_search(spark, folder):
    return direct.naive_bayes(_frame(spark, folder)).cv


@query("cv_results")
def cv_results(spark, folder):
    return ensembles.decision_tree(_frame(spark, folder)).cv


@query("pruning_path")
def pruning_path(spark, folder):
    return direct.pruned_tree(_frame(spark, folder))[1]


@query("binary_logistic")
def binary_logistic(spark, folder):
    late = F.when(F.col("arrival_status") == "late", "late").otherwise("not late")
    frame = make_frame(labelled(spark, folder).withColumn("late", late), "late", COLUMNS, "stop_id")
    return builtin.binary_logistic(frame, "late")


@query("rf_importance")
def rf_importance(spark, folder):
    rows = labelled(spark, folder).withColumnRenamed("stop_id", "id").withColumn(
        "code", derive.recode("arrival_status", derive.STATUS_CODES, F.lit(0)))
    return ensembles.regression_importance(rows, "code", COLUMNS)


@query("rf_classifier_importance")
def rf_classifier_importance(spark, folder):
    return ensembles.classification_importance(_frame(spark, folder))


@query("selector_scores")
def selector_scores(spark, folder):
    return phases.select_features(phases.one_hot(trips(spark, folder), ["status", "line", "type"]), phases.StudyConfig())["scores"]


@query("subset_logistic")
def subset_logistic(spark, folder):
    value = builtin.subset_accuracy(_frame(spark, folder), ["delay_minutes", "k"], "logistic")
    return spark.createDataFrame([(float(value),)], "accuracy double")


@query("prepare")
def prepare(spark, folder):
    return phases.prepare(stops(spark, folder))["prepared"].groupBy("arrival_status", "is_weekend").agg(F.count(F.lit(1)).alias("n"))


def _daily_sql(source: str, features) -> str:
    """Daily means, the plain split of the days, all subsets of the features on the training days and the elimination."""
    means = ", ".join(f"avg({c}) AS {c}" for c in [*features, "arrival_minutes"])
    return f"""b AS (SELECT CAST(date_trunc('day', scheduled_time) AS TIMESTAMP) AS d, 1 AS one, {means} FROM {source} GROUP BY 1),
{split_sql('b', 'd', 'one')}, days AS (SELECT * FROM splitted WHERE split = 'train'),
{least_squares_sql('days', 'arrival_minutes', features)}, {elimination_sql(features)}"""


TRIP_FEATURES, STOP_FEATURES = ["stop_sequence", "from_id", "to_id"], ["stop_sequence", "from_id", "to_id", "k"]


@query("regress", f"""WITH RECURSIVE {TRIPS}, {_daily_sql('trips', TRIP_FEATURES)},
chosen AS (SELECT CASE WHEN p > 0.1 THEN [x FOR x IN names IF x <> removed] ELSE names END AS names FROM walk ORDER BY step DESC LIMIT 1)
{terms_sql('names = (SELECT names FROM chosen)', 4)}""")
def regress(spark, folder):
    rows = phases.with_features(trips(spark, folder))
    return rounded_terms(phases.regress(rows.select("scheduled_time", "stop_sequence", "from_id", "to_id", "delay_minutes", "arrival_minutes"))["terms"], 4)


@query("daily_stepwise", f"WITH RECURSIVE {LABELLED}, {_daily_sql('labelled', STOP_FEATURES)} {STEPS_SQL.format(digits=6)}")
def daily_stepwise(spark, folder):
    rows = labelled(spark, folder).select("scheduled_time", "stop_sequence", "from_id", "to_id", "k", "delay_minutes", "arrival_minutes")
    return rounded_steps(phases.regress(rows)["steps"], 6)


@query("compare_classifiers")
def compare_classifiers(spark, folder):
    out = phases.compare_classifiers(labelled(spark, folder), "arrival_status", COLUMNS, "stop_id")
    return out.withColumn("confusion", F.col("confusion").cast("string"))


@query("cluster_and_mine")
def cluster_and_mine(spark, folder):
    found = phases.cluster_and_mine(
        trips(spark, folder), "trip_id", ["delay_minutes", "stop_sequence"], ["time_of_day", "arrival_status", "day_of_weeks"])
    return found["kmeans_curve"].select("k", "best").join(
        found["dbscan_count"].select(F.col("clusters").alias("dbscan_clusters"), "noise", F.lit(True).alias("best")), "best", "left")

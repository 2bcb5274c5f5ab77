"""Evaluation on rule-based predictions, and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.catalogue.algebra import elimination_sql, jacobi_sql, least_squares_sql
from colonnade.catalogue.registry import LABELLED, STOPS, labelled, query, stops, table
from colonnade.catalogue.summaries import split_sql
from colonnade.functions import derive
from colonnade.operators import aggregate, evaluate, moments, regress, sampling

SCORED = LABELLED + """,
scored AS (SELECT stop_id, arrival_status AS label, delay_minutes, k, arrival_minutes,
  CASE WHEN delay_minutes < -5 THEN 'early' WHEN delay_minutes <= 5 THEN 'on-time' ELSE 'late' END AS prediction,
  (450.0::DOUBLE - delay_minutes) / 500.0::DOUBLE AS s_early, (delay_minutes + 50.0::DOUBLE) / 500.0::DOUBLE AS s_late,
  k / 100.0::DOUBLE AS s_on FROM labelled)"""
CLASSES = SCORED + """,
cells AS (SELECT label AS a, prediction AS p, count(*) AS n FROM scored GROUP BY 1, 2),
classes AS (SELECT c, coalesce(sum(n) FILTER (WHERE a = c), 0) AS support, coalesce(sum(n) FILTER (WHERE p = c), 0) AS predicted,
            coalesce(sum(n) FILTER (WHERE a = c AND p = c), 0) AS tp, sum(n) AS total
            FROM cells, (SELECT DISTINCT label AS c FROM scored) GROUP BY c),
rated AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
          coalesce((total - support - predicted + tp) / nullif(total - support, 0)::DOUBLE, 0) AS specificity FROM classes),
full_rated AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rated)"""


def _scores():
    return {"early": F.col("s_early"), "late": F.col("s_late"), "on-time": F.col("s_on")}


def _scored(spark, folder):
    d, k = F.col("delay_minutes"), F.col("k")
    return labelled(spark, folder).select(
        "stop_id", F.col("arrival_status").alias("label"), d, k, "arrival_minutes",
        derive.delay_class(d, -5.0, 5.0).alias("prediction"),
        ((F.lit(450.0) - d) / F.lit(500.0)).alias("s_early"), ((d + F.lit(50.0)) / F.lit(500.0)).alias("s_late"),
        (k / F.lit(100.0)).alias("s_on"),
    )


@query("confusion_matrix", f"""WITH {SCORED}
SELECT actual, predicted, (SELECT count(*) FROM scored WHERE label = actual AND prediction = predicted) AS n
FROM (SELECT DISTINCT label AS actual FROM scored), (SELECT DISTINCT label AS predicted FROM scored)""")
def confusion_matrix(spark, folder):
    return evaluate.confusion(_scored(spark, folder))


@query("class_metrics", f"""WITH {CLASSES}
SELECT c AS class, support::BIGINT AS support, tp::BIGINT AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(specificity, 6) AS specificity, round(f1, 6) AS f1 FROM full_rated""")
def class_metrics(spark, folder):
    return evaluate.per_class(_scored(spark, folder)).select("class", "support", "tp", "precision", "recall", "specificity", "f1")


@query("weighted_metrics", f"""WITH {CLASSES}
SELECT sum(support)::BIGINT AS rows, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
  round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
  round(sum(f1 * support) / sum(support), 6) AS f1, round(sum(specificity * support) / sum(support), 6) AS specificity FROM full_rated""")
def weighted_metrics(spark, folder):
    return evaluate.weighted_metrics(_scored(spark, folder))


@query("binary_metrics", f"""WITH {SCORED}, c AS (SELECT
  count(*) FILTER (WHERE label = 'late' AND prediction = 'late') AS tp, count(*) FILTER (WHERE label <> 'late' AND prediction <> 'late') AS tn,
  count(*) FILTER (WHERE label <> 'late' AND prediction = 'late') AS fp, count(*) FILTER (WHERE label = 'late' AND prediction <> 'late') AS fn FROM scored)
SELECT *, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision,
  round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy FROM c""")
def binary_metrics(spark, folder):
    return evaluate.binary_metrics(_scored(spark, folder), "late")


def _curve_sql(source, by="", digits=6):
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""
score_groups AS (SELECT {lead}threshold, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM {source} GROUP BY ALL),
curve AS (SELECT {lead}threshold, pos, neg, sum(pos) OVER ({part}ORDER BY threshold DESC)::BIGINT AS tp,
          sum(neg) OVER ({part}ORDER BY threshold DESC)::BIGINT AS fp, sum(pos) OVER ({part.strip()})::DOUBLE AS p, sum(neg) OVER ({part.strip()})::DOUBLE AS n
          FROM score_groups),
points AS (SELECT {lead}round(threshold, 6) AS threshold, tp, fp, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM curve)"""


ORIGIN = " SELECT * FROM points UNION ALL SELECT NULL, 0, 0, 0.0, 0.0"
AREA = "round(sum(neg * (tp - pos / 2.0)) / (max(p) * max(n)), 6) AS auc"
BINARY_SCORES = SCORED + ", flat AS (SELECT delay_minutes + k AS threshold, label = 'late' AS y FROM scored)"
MICRO_SCORES = SCORED + """, flat AS (
  SELECT s_early AS threshold, label = 'early' AS y FROM scored UNION ALL
  SELECT s_late, label = 'late' FROM scored UNION ALL SELECT s_on, label = 'on-time' FROM scored)"""
PAIR_SCORES = SCORED + ", flat AS (" + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS pair, {s} AS threshold, label = '{c}' AS y FROM scored"
    for a, b in (("early", "late"), ("early", "on-time"), ("late", "on-time"))
    for c, s in (("early", "s_early"), ("late", "s_late"), ("on-time", "s_on")) if c in (a, b)) + ")"


@query("roc_binary", f"WITH {BINARY_SCORES}, {_curve_sql('flat')} {ORIGIN}")
def roc_binary(spark, folder):
    return evaluate.roc_points(_scored(spark, folder), F.col("delay_minutes") + F.col("k"), F.col("label") == "late")


@query("auc_binary", f"WITH {BINARY_SCORES}, {_curve_sql('flat')} SELECT {AREA} FROM curve")
def auc_binary(spark, folder):
    return evaluate.auc(_scored(spark, folder), F.col("delay_minutes") + F.col("k"), F.col("label") == "late")


@query("roc_micro", f"WITH {MICRO_SCORES}, {_curve_sql('flat')} {ORIGIN}")
def roc_micro(spark, folder):
    return evaluate.micro_roc(_scored(spark, folder), _scores())


@query("auc_micro", f"WITH {MICRO_SCORES}, {_curve_sql('flat')} SELECT {AREA} FROM curve")
def auc_micro(spark, folder):
    return evaluate.micro_auc(_scored(spark, folder), _scores())


@query("roc_pairwise", f"WITH {PAIR_SCORES}, {_curve_sql('flat', 'pair')} SELECT * FROM points UNION ALL SELECT DISTINCT pair, NULL, 0, 0, 0.0, 0.0 FROM points")
def roc_pairwise(spark, folder):
    return evaluate.pairwise_roc(_scored(spark, folder), _scores())


@query("auc_pairwise", f"""WITH {PAIR_SCORES}, {_curve_sql('flat', 'pair')}, areas AS (
  SELECT pair, sum(neg * (tp - pos / 2.0)) / (max(p) * max(n)) AS auc FROM curve GROUP BY 1)
SELECT pair, round(auc, 6) AS auc, round(avg(auc) OVER (), 6) AS mean_auc FROM areas""")
def auc_pairwise(spark, folder):
    return evaluate.pairwise_auc(_scored(spark, folder), _scores())


@query("auc_pairwise_models", f"""WITH {PAIR_SCORES}, models AS (
  SELECT 'all' AS model, pair, threshold, y FROM flat UNION ALL SELECT 'inverse', pair, -threshold, y FROM flat),
g AS (SELECT model, pair, threshold, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM models GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY model, pair) AS p, sum(neg) OVER (PARTITION BY model, pair) AS n
      FROM g WINDOW w AS (PARTITION BY model, pair ORDER BY threshold DESC)),
areas AS (SELECT model, pair, sum(neg * (tp - pos / 2.0)) / (max(p) * max(n)) AS auc FROM c GROUP BY 1, 2)
SELECT model, pair, round(auc, 6) AS auc, round(avg(auc) OVER (PARTITION BY model), 6) AS mean_auc FROM areas""")
def auc_pairwise_models(spark, folder):
    rows = _scored(spark, folder)
    names = ("s_early", "s_late", "s_on")
    inverse = rows.withColumns({c: -F.col(c) for c in names})
    both = rows.withColumn("model", F.lit("all")).unionByName(inverse.withColumn("model", F.lit("inverse")))
    return evaluate.pairwise_auc(both, _scores(), by=["model"])


@query("regression_metrics", f"""WITH {SCORED}, e AS (SELECT arrival_minutes AS y, arrival_minutes - (delay_minutes * 0.9::DOUBLE + 1.0::DOUBLE) AS e FROM scored)
SELECT count(*) AS rows, round(avg(e * e), 6) AS mse, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM e""")
def regression_metrics(spark, folder):
    rows = _scored(spark, folder).withColumn("guess", F.col("delay_minutes") * F.lit(0.9) + F.lit(1.0))
    return evaluate.regression_metrics(rows, "arrival_minutes", "guess")


@query("cv_mean_score", f"""WITH {LABELLED},
f AS (SELECT *, ntile(5) OVER (PARTITION BY arrival_status ORDER BY md5(CAST(stop_id AS VARCHAR) || ':5805')) - 1 AS fold FROM labelled),
g AS (SELECT bound, fold, avg((arrival_status = CASE WHEN delay_minutes < -bound THEN 'early' WHEN delay_minutes <= bound THEN 'on-time' ELSE 'late' END)::INT) AS a
      FROM f, (SELECT unnest([1.0::DOUBLE, 5.0, 10.0]) AS bound) GROUP BY 1, 2)
SELECT bound, round(avg(a), 6) AS mean_accuracy, count(*) AS folds FROM g GROUP BY 1""")
def cv_mean_score(spark, folder):
    rows = sampling.stratified_folds(labelled(spark, folder), "stop_id", "arrival_status")
    bounds = F.explode(F.array(*[F.lit(b) for b in (1.0, 5.0, 10.0)]))
    tried = rows.withColumn("bound", bounds)
    guess = F.when(F.col("delay_minutes") < -F.col("bound"), "early").when(F.col("delay_minutes") <= F.col("bound"), "on-time").otherwise("late")
    return evaluate.cv_mean(tried.withColumn("prediction", guess).withColumnRenamed("arrival_status", "label"), ["bound"])


NAMES = ("early", "late", "on-time")


def _weighted_sql(split, prefix):
    figures = {"precision": "pr", "recall": "re", "f1": "coalesce(2 * pr * re / nullif(pr + re, 0), 0)", "specificity": "sp"}
    only = f"FILTER (WHERE split = '{split}')"
    return ", ".join(f"round(sum({f} * support) {only} / sum(support) {only}, 6) AS {prefix}{n}" for n, f in figures.items())


def _metric_sql(model, bound):
    matrix = " || ';' || ".join(
        " || ',' || ".join(f"CAST(count(*) FILTER (WHERE label = '{a}' AND prediction = '{p}') AS VARCHAR)" for p in NAMES) for a in NAMES)
    return f"""SELECT * FROM (WITH
m AS (SELECT label, split, s_early, s_late, s_on, CASE WHEN delay_minutes < -{bound} THEN 'early' WHEN delay_minutes <= {bound} THEN 'on-time' ELSE 'late' END AS prediction FROM base),
t AS (SELECT * FROM m WHERE split = 'test'),
k AS (SELECT split, c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted,
      count(*) FILTER (WHERE label = c AND prediction = c) AS tp, count(*) AS total FROM m, (SELECT unnest(['early', 'late', 'on-time']) AS c) GROUP BY 1, 2),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS re,
      coalesce((total - support - predicted + tp) / nullif(total - support, 0)::DOUBLE, 0) AS sp FROM k),
flat AS (SELECT s_early AS threshold, label = 'early' AS y FROM t UNION ALL SELECT s_late, label = 'late' FROM t UNION ALL SELECT s_on, label = 'on-time' FROM t),
{_curve_sql('flat')}
SELECT '{model}' AS model, (SELECT round(avg((label = prediction)::INT), 6) FROM m WHERE split = 'train') AS train_accuracy,
  (SELECT round(avg((label = prediction)::INT), 6) FROM t) AS test_accuracy,
  {_weighted_sql('test', '')}, {_weighted_sql('train', 'train_')},
  (SELECT {AREA} FROM curve) AS auc, (SELECT {matrix} FROM t) AS confusion FROM r)"""


@query("metric_table", f"""WITH {SCORED}, {split_sql('scored', 'stop_id', 'label')}, base AS (SELECT * FROM splitted)
{_metric_sql('narrow', '1.0::DOUBLE')} UNION ALL {_metric_sql('wide', '5.0::DOUBLE')}""")
def metric_table(spark, folder):
    rows = sampling.stratified_split(_scored(spark, folder), "stop_id", "label")
    models = [
        rows.withColumns({"model": F.lit(name), "prediction": derive.delay_class("delay_minutes", -b, b)}) for name, b in (("narrow", 1.0), ("wide", 5.0))
    ]
    out = evaluate.metric_table(models[0].unionByName(models[1]), _scores())
    flat = F.array_join(F.transform("confusion", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), ",")), ";")
    return out.withColumn("confusion", flat)


# Simple regression of price on quantity: every figure has a closed form.
SIMPLE = """s AS (SELECT count(*)::DOUBLE AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy,
  avg(l_quantity) AS mx FROM lineitem),
o AS (SELECT *, syy - sxy * sxy / sxx AS ssr FROM s),
f AS (SELECT *, ssr / (n - 2) AS s2, sqrt(ssr / (n - 2) / sxx) AS se_b, sqrt(ssr / (n - 2) * (1 / n + mx * mx / sxx)) AS se_a,
      n * (ln(2 * pi() * ssr / n) + 1) AS dev,
      1.959963984540054 + (power(1.959963984540054, 3) + 1.959963984540054) / (4 * (n - 2)) AS q FROM o)"""


def _simple(spark, folder):
    m = moments.cross_moments(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return regress.fit_linear(m, "l_extendedprice", ["l_quantity"])


@query("ols_fit", f"""WITH {SIMPLE} SELECT round(ssr / n / 1e6, 6) AS mse_m, round(1 - ssr / syy, 6) AS r2,
round(1 - (ssr / syy) * (n - 1) / (n - 2), 6) AS adj_r2, round(dev + 4, 4) AS aic, round(dev + 2 * ln(n), 4) AS bic FROM f""")
def ols_fit(spark, folder):
    fit = _simple(spark, folder)
    return spark.createDataFrame(
        [(float(fit.mse / 1e6), float(fit.r2), float(fit.adj_r2), round(float(fit.aic), 4), round(float(fit.bic), 4))],
        "mse_m double, r2 double, adj_r2 double, aic double, bic double")


@query("ols_predict", f"""WITH {SIMPLE} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
round(a + b * l_quantity, 4) AS predicted FROM lineitem, f""")
def ols_predict(spark, folder):
    fit = _simple(spark, folder)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.round(fit.predict(), 4).alias("predicted"))


@query("t_tests", f"""WITH {SIMPLE} SELECT 'const' AS term, round(a, 4) AS coef, round(se_a, 4) AS se, round(a / se_a, 4) AS t, abs(a / se_a) > q AS significant FROM f
UNION ALL SELECT 'l_quantity', round(b, 4), round(se_b, 4), round(b / se_b, 4), abs(b / se_b) > q FROM f""")
def t_tests(spark, folder):
    out = regress.coefficient_table(spark, _simple(spark, folder))
    return out.select("term", *[F.round(c, 4).alias(c) for c in ("coef", "se", "t")], "significant")


@query("conf_intervals", f"""WITH {SIMPLE} SELECT 'const' AS term, round(a - q * se_a, 3) AS low, round(a + q * se_a, 3) AS high FROM f
UNION ALL SELECT 'l_quantity', round(b - q * se_b, 3), round(b + q * se_b, 3) FROM f""")
def conf_intervals(spark, folder):
    out = regress.coefficient_table(spark, _simple(spark, folder))
    return out.select("term", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("f_test", f"WITH {SIMPLE} SELECT round((syy - ssr) / s2, 2) AS f, 1 AS df_model, (n - 2)::INT AS df_resid, (syy - ssr) / s2 > q * q AS significant FROM f")
def f_test(spark, folder):
    out = regress.f_test_table(spark, _simple(spark, folder))
    return out.select(F.round("f", 2).alias("f"), "df_model", "df_resid", "significant")


PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


PRICE_SQL = least_squares_sql("lineitem", "l_extendedprice", PRICE_FEATURES)
NORMAL_95 = "1.959963984540054"


def terms_sql(where: str, digits: int = 3) -> str:
    """The table of coefficients; the interval's quantile follows from the normal one."""
    z = float(NORMAL_95)
    steps = [  # Student's quantile as a series in 1 / df
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    q = f"({NORMAL_95} + {' + '.join(f'{v!r}::DOUBLE / power(df, {i + 1})' for i, v in enumerate(steps))})"
    return f"""SELECT term, round(coef, {digits}) AS coef, round(se, {digits}) AS se, round(t, 4) AS t, round(p, 6) AS p, p < 0.05 AS significant,
  round(coef - {q} * se, {digits}) AS low, round(coef + {q} * se, {digits}) AS high FROM terms WHERE {where}"""


def rounded_terms(terms, digits: int = 3):
    return terms.select("term", *[F.round(c, digits).alias(c) for c in ("coef", "se", "low", "high")], F.round("t", 4).alias("t"), "p", "significant")


STEPS_SQL = """SELECT step::INTEGER AS step, removed, round(p, 6) AS p, round(r2, 6) AS r2, round(adj_r2, 6) AS adj_r2, round(aic, 3) AS aic,
  round(bic, 3) AS bic, round(mse, {digits}) AS mse FROM walk JOIN fits USING (names) WHERE p > 0.1"""


def rounded_steps(steps, digits: int):
    return steps.select("step", "removed", "p", "r2", "adj_r2", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), F.round("mse", digits).alias("mse"))


@query("ols_multiple", f"WITH RECURSIVE {PRICE_SQL} {terms_sql(f'len(names) = {len(PRICE_FEATURES)}')}")
def ols_multiple(spark, folder):
    rows = table(spark, folder, "lineitem")
    m = moments.cross_moments(rows, [*PRICE_FEATURES, "l_extendedprice"])
    return rounded_terms(regress.coefficient_table(spark, regress.fit_linear(m, "l_extendedprice", PRICE_FEATURES)))


@query("stepwise_steps", f"WITH RECURSIVE {PRICE_SQL}, {elimination_sql(PRICE_FEATURES)} {STEPS_SQL.format(digits=0)}")
def stepwise_steps(spark, folder):
    m = moments.cross_moments(table(spark, folder, "lineitem"), [*PRICE_FEATURES, "l_extendedprice"])
    return rounded_steps(regress.steps_table(spark, regress.backward(m, "l_extendedprice", PRICE_FEATURES)[1]), 0)


@query("prediction_series", f"""WITH {STOPS},
b AS (SELECT CAST(date_trunc('day', scheduled_time) AS TIMESTAMP) AS d, 1 AS one, avg(k) AS k, avg(delay_minutes) AS y FROM stops GROUP BY 1),
{split_sql('b', 'd', 'one')},
r AS (SELECT regr_slope(y, k) AS slope, regr_intercept(y, k) AS icept FROM splitted WHERE split = 'train')
SELECT row_number() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, d) AS position, split, round(y, 6) AS actual,
       round(icept + slope * k, 6) AS predicted FROM splitted, r""")
def prediction_series(spark, folder):
    base = stops(spark, folder).select("scheduled_time", "k", "delay_minutes")
    rows = sampling.plain_split(aggregate.resample(base, "scheduled_time", "delay_minutes"), "scheduled_time")
    fit = regress.fit_linear(moments.cross_moments(rows.filter("split = 'train'"), ["k", "delay_minutes"]), "delay_minutes", ["k"])
    return regress.prediction_series(rows, fit.predict(), "delay_minutes", "scheduled_time")


CORR3 = """c AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem),
d AS (SELECT *, 1 + 2 * qe * qd * ed - qe * qe - qd * qd - ed * ed AS det FROM c)"""


@query("vif_table", f"""WITH {CORR3} SELECT 'l_quantity' AS feature, round((1 - ed * ed) / det, 6) AS vif, CASE WHEN (1 - ed * ed) / det < 10 THEN 'keep' ELSE 'remove' END AS decision FROM d
UNION ALL SELECT 'l_extendedprice', round((1 - qd * qd) / det, 6), CASE WHEN (1 - qd * qd) / det < 10 THEN 'keep' ELSE 'remove' END FROM d
UNION ALL SELECT 'l_discount', round((1 - qe * qe) / det, 6), CASE WHEN (1 - qe * qe) / det < 10 THEN 'keep' ELSE 'remove' END FROM d""")
def vif_table(spark, folder):
    return moments.vif(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


PAIR = "c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)"


@query("pca_pair", f"""WITH {PAIR} SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cumulative,
CASE WHEN (1 + r) / 2 >= 0.95 THEN 1 ELSE 2 END AS n95 FROM c
UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0, CASE WHEN (1 + r) / 2 >= 0.95 THEN 1 ELSE 2 END FROM c""")
def pca_pair(spark, folder):
    found = moments.pca(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return found.table(spark).select("component", "ratio", "cumulative", "n95")


FIVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
CORR5 = "corr5 AS (SELECT [" + ", ".join(f"corr({a}, {b})" if a != b else "1.0::DOUBLE" for a in FIVE for b in FIVE) + "] AS m FROM lineitem)"


def _variance_sql(ratio: str, share: str) -> str:
    return f"""shares AS (SELECT position, {ratio} AS ratio, {share} AS share FROM eigen),
sums AS (SELECT *, sum(ratio) OVER (ORDER BY position) AS cumulative FROM shares)
SELECT position::INTEGER AS component, round(ratio, 6) AS ratio, round(cumulative, 6) AS cumulative, round(share, 6) AS share,
  coalesce((SELECT min(position) FROM sums WHERE cumulative >= 0.95), 1)::INTEGER AS n95 FROM sums"""


@query("pca_variance", f"WITH RECURSIVE {CORR5}, {jacobi_sql('corr5', 5)}, {_variance_sql('value / 5', 'value / 5')}")
def pca_variance(spark, folder):
    return moments.pca(table(spark, folder, "lineitem"), FIVE).table(spark)


@query("pca_embeddings")
def pca_embeddings(spark, folder):
    wide = moments.unpack(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", 64)
    return moments.pca(wide, [f"x{i}" for i in range(64)]).table(spark)


@query("svd_ranking", f"""WITH RECURSIVE {CORR5}, {jacobi_sql('corr5', 5)},
w AS (SELECT ['{"', '".join(FIVE)}'][i + 1] AS feature, abs(vector[i + 1]) AS importance FROM (SELECT *, unnest(range(5)) AS i FROM eigen WHERE position = 1))
SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC)::INTEGER AS rank FROM w""")
def svd_ranking(spark, folder):
    return moments.svd(table(spark, folder, "lineitem"), FIVE).ranking(spark)


def _second_sql() -> str:
    """Mean products of the z-scored columns and the raw last one, and the same about the mean."""
    raw = FIVE[-1]
    cells = []
    for a in FIVE:
        for b in FIVE:
            scale = "".join(f" * stddev_pop({raw})" for c in (a, b) if c == raw)
            cells.append(("1.0::DOUBLE" if a == b else f"corr({a}, {b})") + scale)
    about = ", ".join(cells)
    cells[-1] = f"avg({raw} * {raw})"
    return f"second5 AS (SELECT [{', '.join(cells)}] AS m FROM lineitem), about5 AS (SELECT [{about}] AS cross5 FROM lineitem)"


@query("svd_variance", f"""WITH RECURSIVE {_second_sql()}, {jacobi_sql('second5', 5, 'all5')},
eigen AS (SELECT *, (SELECT cross5 FROM about5) AS c5 FROM all5 WHERE position <= 4),
{_variance_sql('list_sum([c5[x + 1] * vector[x // 5 + 1] * vector[x % 5 + 1] FOR x IN range(25)]) / (c5[1] + c5[7] + c5[13] + c5[19] + c5[25])',
               'value / sum(value) OVER ()')}""")
def svd_variance(spark, folder):
    return moments.svd(table(spark, folder, "lineitem"), FIVE, ignore=["l_linenumber"]).table(spark)

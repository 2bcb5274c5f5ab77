"""Scores of predictions, all as aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.ordering import running_totals
from colonnade.session import broadcast_if_small, cut_lineage


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) with zero cells for every pair of classes that occurs."""
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted")))
    grid = (
        counts.agg(classes.alias("c"))
        .select("c", F.explode("c").alias("actual"))
        .select("actual", F.explode("c").alias("predicted"))
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Counts and precision, recall, F1, specificity of each class (0 where a denominator is 0)."""
    return _rated(df.groupBy(*by, F.col(label).alias("a"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n")), by)


def _rated(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The figures of each class from counts (a, p, n) of actual and predicted class."""
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    ))
    sums = cells.select(*by, sides.alias("s")).select(*by, "s.*").groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    # One row per class from here on.
    total = F.sum("support").over(Window.partitionBy(*(by or [F.lit(0)])))
    out = sums.withColumn("total", total).withColumns(
        {
            "fp": F.col("predicted") - F.col("tp"),
            "fn": F.col("support") - F.col("tp"),
            "tn": F.col("total") - F.col("support") - F.col("predicted") + F.col("tp"),
        }
    )
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return out.withColumns(
        {"precision": p, "recall": r, "specificity": _ratio(F.col("tn"), F.col("tn") + F.col("fp"))}
    ).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 and specificity."""
    return _weighted(per_class(df, label, prediction, by), by)


def _weighted(classes: DataFrame, by: Sequence[str]) -> DataFrame:
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        total.alias("rows"),
        (F.sum("tp") / total).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1", "specificity")],
    )


def binary_metrics(df: DataFrame, positive, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """TP, TN, FP, FN with recall, precision (null where undefined) and accuracy."""
    a, p = F.col(label) == F.lit(positive), F.col(prediction) == F.lit(positive)
    counts = df.agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        "*",
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )


def _score_groups(df: DataFrame, score: Column, positive: Column, by: Sequence[str]) -> DataFrame:
    """Rows with the same score merged before any ordering: hot scores become one row."""
    return df.select(*by, (score.cast("double") + F.lit(0.0)).alias("threshold"), positive.alias("_y")).groupBy(*by, "threshold").agg(
        F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg")
    )


def _curve(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    groups = cut_lineage(groups)  # read for the ranges, the totals and the curve
    running = running_totals(groups, [("threshold", False)], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if not by:
        row = totals.first()
        return running.withColumns({"_p": F.lit(row["_p"]).cast("bigint"), "_n": F.lit(row["_n"]).cast("bigint")})
    return running.join(broadcast_if_small(totals), list(by))


def roc_points(df: DataFrame, score: Column | str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """ROC curve: one point per distinct score, plus the origin (null threshold)."""
    score = F.col(score) if isinstance(score, str) else score
    return _points(_curve(_score_groups(df, score, positive, by), by), by)


def _points(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    points = curve.select(
        *by, "threshold", "tp", "fp",
        F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"),
    )
    zero = F.lit(0).cast("bigint")
    origin = curve.select(*by).distinct() if by else curve.sparkSession.range(1).select()
    origin = origin.select(
        *by, F.lit(None).cast("double").alias("threshold"), zero.alias("tp"), zero.alias("fp"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def _auc_of(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area by trapezoids: each score group adds neg * (positives above + half its own)."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return curve.groupBy(*by).agg(F.try_divide(area, F.max("_p").cast("double") * F.max("_n")).alias("auc"))


def auc(df: DataFrame, score: Column | str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    score = F.col(score) if isinstance(score, str) else score
    return _auc_of(_curve(_score_groups(df, score, positive, by), by), by)


def class_scores(df: DataFrame, scores: Mapping[str, Column], label: str = "label", also: Sequence[str] = ()) -> DataFrame:
    """One row per (input row, class): class, indicator, score."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col(label) == F.lit(c)).alias("indicator"), s.cast("double").alias("score"))
        for c, s in scores.items()
    ])
    return df.select(*also, F.explode(cells).alias("s")).select(*also, "s.*")


def micro_roc(df: DataFrame, scores: Mapping[str, Column], label: str = "label") -> DataFrame:
    return roc_points(class_scores(df, scores, label), "score", F.col("indicator"))


def micro_auc(df: DataFrame, scores: Mapping[str, Column], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return auc(class_scores(df, scores, label, by), "score", F.col("indicator"), by)


def _pair_groups(df: DataFrame, scores: Mapping[str, Column], label: str, by: Sequence[str]) -> DataFrame:
    """Score groups per class, then copied to each class pair: rows are merged before they multiply."""
    per_score = _score_groups(class_scores(df, scores, label, by), F.col("score"), F.col("indicator"), [*by, "class"])
    names = sorted(scores)
    pairs = {c: [f"{a}|{b}" for i, a in enumerate(names) for b in names[i + 1:] if c in (a, b)] for c in names}
    lookup = F.create_map(*[x for c in names for x in (F.lit(c), F.array(*[F.lit(p) for p in pairs[c]]))])
    return (
        per_score.withColumn("pair", F.explode(F.element_at(lookup, F.col("class"))))
        .groupBy(*by, "pair", "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def pairwise_auc(df: DataFrame, scores: Mapping[str, Column], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """One-vs-one AUC per class pair, and per ``by`` (such as the model); the mean over pairs is ``mean_auc``."""
    keys = [*by, "pair"]
    out = _auc_of(_curve(_pair_groups(df, scores, label, by), keys), keys)
    return out.withColumn("mean_auc", F.avg("auc").over(Window.partitionBy(*(by or [F.lit(0)]))))


def pairwise_roc(df: DataFrame, scores: Mapping[str, Column], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """ROC curve per class pair, and per ``by``, each with its origin."""
    keys = [*by, "pair"]
    return _points(_curve(_pair_groups(df, scores, label, by), keys), keys)


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    y, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(e * e).alias("mse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )


def cv_mean(df: DataFrame, params: Sequence[str], fold: str = "fold", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean over folds of the fold accuracy, per parameter setting."""
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return (
        df.groupBy(*params, fold).agg(F.avg(hit).alias("_a"))
        .groupBy(*params).agg(F.avg("_a").alias("mean_accuracy"), F.count(F.lit(1)).alias("folds"))
    )


METRICS = ("precision", "recall", "f1", "specificity")


def metric_table(
    df: DataFrame, scores: Mapping[str, Column], label: str = "label", prediction: str = "prediction",
    model: str = "model", split: str = "split",
) -> DataFrame:
    """One row per model: accuracy and weighted metrics of both splits, micro AUC and confusion matrix of the test rows.

    The predictions are read twice: once for the counts of (split, actual, predicted), from which all but the
    area follows, and once for the area.
    """
    cells = cut_lineage(df.groupBy(model, split, F.col(label).alias("a"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    metrics = _weighted(_rated(cells, [model, split]), [model, split])
    test = metrics.filter(F.col(split) == "test").select(model, F.col("accuracy").alias("test_accuracy"), *METRICS)
    train = metrics.filter(F.col(split) == "train").select(
        model, F.col("accuracy").alias("train_accuracy"), *[F.col(m).alias(f"train_{m}") for m in METRICS])
    areas = micro_auc(df.filter(F.col(split) == "test"), scores, label, [model])
    names = sorted(scores)
    matrix = cells.filter(F.col(split) == "test").groupBy(model).agg(
        F.array(*[
            F.array(*[F.coalesce(F.sum(F.when((F.col("a") == a) & (F.col("p") == p), F.col("n"))), F.lit(0)) for p in names])
            for a in names
        ]).alias("confusion")
    )
    return (
        train.join(test, model).join(areas, model).join(matrix, model)
        .select(model, "train_accuracy", "test_accuracy", *METRICS, *[f"train_{m}" for m in METRICS], "auc", "confusion")
    )

"""The study as four phases over any table with the stop columns; each returns named DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import derive
from colonnade.models import builtin, composed, direct, ensembles
from colonnade.models.frame import ClassFrame, ModelResult, make_frame, predicted, probability_scores
from colonnade.operators import aggregate, moments
from colonnade.operators.cluster import kmeans_sweep
from colonnade.operators.density import cluster_count, dbscan, drop_outliers
from colonnade.operators.encode import minmax, one_hot, zscore
from colonnade.operators.evaluate import metric_table
from colonnade.operators.itemsets import association_rules, baskets, frequent_itemsets, strong_rules
from colonnade.operators.neighbors import feature_array, k_distance
from colonnade.operators.profile import profile
from colonnade.operators.regress import stepwise_by_time
from colonnade.operators.rows import column_names, drop_null_rows, lookup_pairs
from colonnade.operators.sampling import balance
from colonnade.session import cut_lineage


@dataclass(frozen=True)
class StudyConfig:
    """Column roles and sizes; the defaults are those of the train study."""

    label: str = "arrival_status"
    exclude: Sequence[str] = ("arrival_minutes",)  # kept out of the features; add delay_minutes to avoid the leak
    encode: Sequence[str] = ("status", "line", "type")
    outlier_columns: Sequence[str] = ("delay_minutes", "long_delay")
    vif_bound: float = 10.0
    importance_bound: float = 0.01
    trees: int = 100
    max_depth: int = ensembles.DEEPEST
    balance_method: str = "oversample"
    folds: int = 5
    restarts: int = 10
    ks: Sequence[int] = field(default_factory=lambda: range(2, 21))
    first_n_columns: bool = False  # stand the first n columns in for n components, instead of projecting
    eps: float = 0.5
    min_points: int = 5


def with_arrival(stops: DataFrame) -> DataFrame:
    return stops.withColumns(
        {
            "scheduled_time": derive.parse_time("scheduled_time"),
            "actual_time": derive.parse_time("actual_time"),
        }
    ).withColumn("arrival_minutes", derive.elapsed_minutes("scheduled_time", "actual_time"))


def load_trips(stops: DataFrame) -> dict[str, DataFrame]:
    """Parse times, count stop-level classes, look up station ids and collapse stops to trips."""
    rows = with_arrival(stops)
    classes = rows.withColumn("arrival_status", derive.delay_class("arrival_minutes"))
    out = {"stop_classes": aggregate.class_distribution(classes, "arrival_status"), "trips": aggregate.trip_rollup(rows)}
    for name in ("from", "to"):
        if name in stops.columns:
            out[f"{name}_lookup"] = lookup_pairs(stops, name, f"{name}_id", ["scheduled_time", "stop_id"])
    return out


def clean_trips(trips: DataFrame) -> DataFrame:
    labelled = trips.withColumns(
        {"arrival_status": derive.delay_class("arrival_minutes"), "time_of_day": derive.day_part("scheduled_time")}
    )
    return aggregate.drop_duplicates(drop_null_rows(labelled))


def with_features(clean: DataFrame) -> DataFrame:
    """Long-delay flag, weekday name and a row key for repeatable sampling."""
    return clean.withColumns(
        {
            "long_delay": derive.exceeds("delay_minutes"),
            "day_of_weeks": derive.weekday_name("date"),
            "trip_id": F.concat_ws("|", F.col("date").cast("string"), F.col("train_id")),
        }
    )


def explore(clean: DataFrame) -> dict[str, DataFrame]:
    rows = with_features(clean)
    return {
        "by_day_part": aggregate.mean_by(rows, ["time_of_day"], "delay_minutes"),
        "by_date": aggregate.mean_by(rows, ["date"], "delay_minutes"),
        "by_sequence": aggregate.mean_by(rows, ["stop_sequence"], "delay_minutes"),
        "by_weekday": aggregate.weekday_means(rows, "date", "delay_minutes"),
        "long_delay_by_line": aggregate.share_true(rows, "line", "long_delay"),
    }


def compare_selectors(frame: ClassFrame, subsets: Mapping[str, ClassFrame], trees: int, max_depth: int) -> tuple[DataFrame, str]:
    """(selector, features, accuracy, best) and the winner; the first selector wins a tie."""
    scores = [(name, builtin.subset_accuracy(f, f.columns, trees=trees, max_depth=max_depth)) for name, f in subsets.items()]
    best = max(scores, key=lambda s: s[1])[0]
    rows = [(name, ",".join(subsets[name].columns), float(a), name == best) for name, a in scores]
    return frame.data.sparkSession.createDataFrame(rows, "selector string, features string, accuracy double, best boolean"), best


def select_features(rows: DataFrame, cfg: StudyConfig, id_col: str = "trip_id") -> dict:
    """Importance, components, collinearity and SVD ranking, and which of them scores best.

    Component scores are real projections of the train rows; a winning PCA therefore yields new columns, unless
    ``cfg.first_n_columns`` takes as many of the original ones in their place.
    """
    spark = rows.sparkSession
    numeric = [c for c in column_names(rows) if c not in cfg.exclude]
    dummies = [c for c in numeric if any(c.startswith(f"{e}_") for e in cfg.encode)]
    frame = make_frame(rows, cfg.label, numeric, id_col, folds=cfg.folds)
    collinear = moments.vif(rows, numeric, cfg.vif_bound)
    removed = [r["feature"] for r in collinear.filter("decision = 'remove'").collect()]
    coded = frame.train.withColumn("code", derive.recode("label", derive.STATUS_CODES, F.lit(0)))
    importance = ensembles.regression_importance(coded, "code", numeric, cfg.trees, cfg.max_depth, cfg.importance_bound)
    chosen = [r["feature"] for r in importance.filter("selected").orderBy("rank").collect()] or numeric[:1]
    pca = moments.pca(frame.train, numeric, ignore=dummies)
    svd = moments.svd(frame.train, [c for c in numeric if c not in removed], ignore=dummies)
    projected = pca.project(frame.data)
    components = numeric[: pca.n95] if cfg.first_n_columns else [f"pc{i + 1}" for i in range(pca.n95)]
    subsets = {
        "forest": ClassFrame(frame.data, frame.classes, chosen, frame.folds),
        "pca": ClassFrame(projected, frame.classes, components, frame.folds),
        "svd": ClassFrame(frame.data, frame.classes, svd.top_features(), frame.folds),
    }
    scores, best = compare_selectors(frame, subsets, cfg.trees, cfg.max_depth)
    return {
        "vif": collinear, "importance": importance, "pca": pca.table(spark), "svd": svd.table(spark),
        "svd_ranking": svd.ranking(spark), "scores": scores, "best": best, "removed": removed,
        "features": {"forest": chosen, "pca": components, "svd": svd.top_features()}[best], "projection": pca,
    }


def balanced(df: DataFrame, label: str, id_col: str, time_column: str, method: str = "oversample") -> DataFrame:
    """Calendar features scaled to [0, 1], then equal class sizes."""
    scaled = minmax(derive.calendar(df, time_column, keep=False), ["month", "day", "hour", "day_of_week"])
    return balance(scaled, id_col, label, method)


def prepare(stops: DataFrame, cfg: StudyConfig = StudyConfig()) -> dict[str, DataFrame]:
    loaded = load_trips(stops)
    clean = cut_lineage(clean_trips(loaded["trips"]))
    rows = with_features(clean)
    encoded = cut_lineage(one_hot(rows, list(cfg.encode)))
    picked = select_features(encoded, cfg)
    kept = cut_lineage(drop_outliers(encoded.drop(*picked["removed"]), "trip_id", list(cfg.outlier_columns)))
    if picked["best"] == "pca" and not cfg.first_n_columns:
        source = encoded.join(kept.select("trip_id"), "trip_id", "left_semi")
        chosen = picked["projection"].project(source).select("trip_id", *picked["features"], "scheduled_time", cfg.label)
    else:
        features = [c for c in picked["features"] if c in kept.columns]
        chosen = kept.select("trip_id", *features, "scheduled_time", cfg.label)
    even = aggregate.balance_check(chosen, cfg.label).first()["balanced"]
    calendar_columns = ["month", "day", "hour", "day_of_week"]
    if even:
        out = chosen
    else:
        out = balanced(chosen, cfg.label, "trip_id", "scheduled_time", cfg.balance_method).drop(*calendar_columns)
    return {
        **{k: v for k, v in loaded.items()}, "clean": clean, "encoded": encoded, "kept": kept, "chosen": chosen,
        "prepared": out, "correlation": aggregate.correlation(kept, mask_diagonal=True),
        **{f"explore_{k}": v for k, v in explore(clean).items()},
        **{f"profile_{k}": v for k, v in profile(kept).items()},
        **{k: picked[k] for k in ("vif", "importance", "pca", "svd", "svd_ranking", "scores")},
    }


def regress(rows: DataFrame, target: str = "arrival_minutes", freq: str = "DAY") -> dict[str, DataFrame]:
    """Backward elimination on the time-binned means; identifiers are dropped first."""
    return stepwise_by_time(rows.drop("train_id", "trip_id"), target, "scheduled_time", freq)


def all_models(frame: ClassFrame, grids: Mapping[str, Mapping] | None = None, parallelism: int = 2) -> list[ModelResult]:
    """The eleven classifiers; ``grids`` replaces a model's default search grid."""
    g = dict(grids or {})
    stack = g.get("stacking", {})
    return [
        ensembles.decision_tree(frame, g.get("decision_tree", ensembles.TREE_GRID)),
        direct.pruned_tree(frame, **g.get("pruned_tree", {}))[0],
        builtin.logistic(frame, g.get("logistic", builtin.LOGISTIC_GRID), parallelism),
        direct.nearest_neighbors(frame, g.get("nearest_neighbors", direct.KNN_GRID)),
        direct.naive_bayes(frame, g.get("naive_bayes", direct.SMOOTHING)),
        builtin.neural_network(frame, g.get("neural_network", builtin.NETWORK_GRID), parallelism),
        ensembles.random_forest(frame, g.get("random_forest", ensembles.FOREST_GRID)),
        ensembles.bagging(frame, g.get("bagging", ensembles.BAGGING_GRID)),
        ensembles.boosting(frame, g.get("boosting", ensembles.BOOSTING_GRID)),
        composed.stacking(frame, stack.get("grid", composed.STACKING_GRID), stack.get("forest"), stack.get("machine"), parallelism),
        composed.svm(frame, g.get("svm", composed.SVM_GRID), parallelism),
    ]


def compare_classifiers(
    df: DataFrame, label: str, columns: Sequence[str], id_col: str, grids: Mapping[str, Mapping] | None = None,
    folds: int = 5, parallelism: int = 2, balance_train: str | None = None,
) -> DataFrame:
    """One metric row per model, best test accuracy first.

    ``balance_train`` ('oversample' or 'undersample') evens out the classes of the training rows after the split.
    """
    frame = make_frame(df, label, columns, id_col, folds=folds)
    if balance_train:
        frame = frame.balanced(balance_train)
    results = all_models(frame, grids, parallelism)
    rows = results[0].predictions
    for r in results[1:]:
        rows = rows.unionByName(r.predictions)
    return metric_table(rows, probability_scores(frame.classes)).orderBy(F.col("test_accuracy").desc(), "model")


def cluster_and_mine(rows: DataFrame, id_col: str, columns: Sequence[str], text: Sequence[str], cfg: StudyConfig = StudyConfig()) -> dict[str, DataFrame]:
    numeric = rows.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any")
    scaled = cut_lineage(zscore(numeric, columns))
    curve, labels = kmeans_sweep(scaled, columns, cfg.ks, cfg.restarts)
    density = cut_lineage(dbscan(scaled, id_col, columns, cfg.eps, cfg.min_points))
    points = scaled.select(F.col(id_col).alias("id"), feature_array(columns).alias("features"))
    items = cut_lineage(frequent_itemsets(baskets(rows, text)))
    rules = cut_lineage(association_rules(items))
    return {
        "kmeans_curve": curve, "kmeans_labels": labels, "dbscan_labels": density, "dbscan_count": cluster_count(density),
        "k_distance": k_distance(points, cfg.min_points), "itemsets": items, "rules": rules, "strong_rules": strong_rules(rules),
    }

"""Trees, forests, bagging and boosting from the histogram builder, and feature importances from it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.models import trees as T
from colonnade.models.frame import ClassFrame, ModelResult, Scorer, cv_table, first_largest, predicted, result, settings
from colonnade.operators.sampling import SEED
from colonnade.session import keep_table, remove_table

DEEPEST = 30  # stands for an unlimited depth

# Default search grids.
TREE_GRID = {
    "impurity": ["gini", "entropy"], "max_depth": [DEEPEST, 10, 20], "min_split": [2, 10, 20], "feature_subset": ["all", "sqrt", "log2"],
}
FOREST_GRID = {"trees": [50, 100, 200], "max_depth": [10, 20, DEEPEST], "min_split": [2, 5, 10], "min_rows": [1, 2, 4]}
BAGGING_GRID = {
    "estimators": [10, 50, 100], "row_share": [0.5, 0.75, 1.0], "column_share": [0.5, 0.75, 1.0], "max_depth": [5, 10, DEEPEST],
}
BOOSTING_GRID = {
    "rounds": [50, 100, 200], "rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 10], "min_split": [2, 5, 10], "min_rows": [1, 2, 4],
}

# Boosted models whose margins are kept and advanced together.
MODELS_AT_ONCE = 512

# Nodes of trees that the driver, and each task that scores, hold at once, some hundred bytes each. One tree is the least,
# in a search the trees of one fold.
NODES_AT_ONCE = 1 << 21

# Rows of a block that carries such margins: some megabytes.
MARGIN_ROWS = 1 << 10


def drawn_columns(subset: str, p: int) -> int:
    """Columns tried per node; 0 stands for all."""
    return {"all": 0, "sqrt": max(1, int(math.sqrt(p))), "log2": max(1, int(math.log2(p)))}[subset]


def tree_plans(p: int, fold: int = -2, impurity="gini", max_depth=DEEPEST, min_split=2, min_rows=1, feature_subset="all") -> list[T.Plan]:
    return [T.Plan(fold, T.seed_of("tree", SEED), 0.0, None, drawn_columns(feature_subset, p), min_rows, min_split, max_depth)]


def forest_plans(p: int, fold: int = -2, trees=100, max_depth=DEEPEST, min_split=2, min_rows=1, feature_subset="sqrt") -> list[T.Plan]:
    """Every tree sees each row a Poisson(1) number of times."""
    return [
        T.Plan(fold, T.seed_of("forest", e, SEED), 1.0, None, drawn_columns(feature_subset, p), min_rows, min_split, max_depth) for e in range(trees)
    ]


def bagging_plans(p: int, fold: int = -2, estimators=10, row_share=1.0, column_share=1.0, max_depth=DEEPEST) -> list[T.Plan]:
    """Every member sees a Poisson(row_share) number of copies of each row and columns of its own."""
    width, out = max(1, int(column_share * p)), []
    for e in range(estimators):
        columns = np.zeros(p, bool)
        columns[sorted(range(p), key=lambda j: T.seed_of("column", j, e, SEED))[:width]] = True
        out.append(T.Plan(fold, T.seed_of("bag", e, SEED), row_share, columns, 0, 1, 2, max_depth))
    return out


class Packed:
    """The rows of a frame as blocks of bins, and how many rows each fold leaves to learn from."""

    def __init__(self, df: DataFrame, columns: Sequence[str], y="y", fold=None, ids: bool = False, block_rows: int = T.BLOCK_ROWS):
        self.columns, self.p = list(columns), len(columns)
        self.spark = df.sparkSession
        learn = df if fold is None else df.filter(fold >= 0)
        self.edges = T.bin_edges(learn, columns)
        self.bins = 1 + max(map(len, self.edges), default=0)
        key = F.col("id") if "id" in df.columns else F.struct(*[F.col(c) for c in columns])
        self.blocks = T.pack(df, columns, self.edges, F.col(y), key, fold, F.col("id") if ids else None, block_rows)
        if fold is None:
            n = self.blocks.agg(F.sum(F.length("fold") / 4).cast("bigint")).first()[0]
            self.rows = {0: n} if n else {}
        else:
            self.rows = {r["fold"]: r["count"] for r in learn.groupBy(fold.alias("fold")).count().collect()}  # folds
        # A binary tree has fewer than two nodes a row.
        self.most_nodes = 2 * sum(self.rows.values())

    def expected(self, q: T.Plan) -> float:
        return sum(n for f, n in self.rows.items() if f != q.fold) * (q.mean or 1.0)

    def grow(self, plans: Sequence[T.Plan], kind: str, criterion: str, classes: int = 1) -> T.Forest:
        return T.grow(self.blocks, plans, kind, criterion, self.p, self.bins, classes, self.expected)

    def grow_parts(self, plans: Sequence[T.Plan], kind: str, criterion: str, classes: int = 1) -> Iterator[T.Forest]:
        """The trees of ``plans`` in their order, as many at a time as the driver and the tasks may hold."""
        return T.grow_parts(self.blocks, plans, kind, criterion, self.p, self.bins, classes, self.expected, most_nodes=NODES_AT_ONCE)

    def importance(self, plans: Sequence[T.Plan], kind: str, criterion: str, classes: int = 1) -> np.ndarray:
        return T.mean_importance([part.gain_shares(kind, criterion, self.p) for part in self.grow_parts(plans, kind, criterion, classes)])

    def scorer(self, plans: Sequence[T.Plan], criterion: str, classes: int) -> Scorer:
        """Class shares averaged over the trees. Trees of too many nodes are not held together: rows get the sums of
        the first ones, are written with them and read back for the next; a second use grows the trees again."""
        parts = self.grow_parts(plans, "class", criterion, classes)
        first = next(parts)
        if len(first.root) == len(plans):
            share = T.share_column(self.spark, first, self.edges, self.columns)
            return lambda df: df.withColumn("probability", share)
        begun = [itertools.chain([first], parts)]

        def score(df: DataFrame) -> DataFrame:
            out, spent = df.withColumn("_sums", F.array(*[F.lit(0.0)] * classes)), []
            for part in begun.pop() if begun else self.grow_parts(plans, "class", criterion, classes):
                out, path = keep_table(out.withColumn("_sums", T.share_sums(self.spark, part, self.edges, self.columns, F.col("_sums"))), "shares")
                remove_table(self.spark, spent)
                spent = [path]
            return out.withColumn("probability", F.transform("_sums", lambda v: v / len(plans))).drop("_sums")

        return score


def fit_tree(train, frame, impurity="gini", **params) -> Scorer:
    rows = Packed(train, frame.columns)
    return rows.scorer(tree_plans(rows.p, **params), impurity, len(frame.classes))


def fit_forest(train, frame, **params) -> Scorer:
    rows = Packed(train, frame.columns)
    return rows.scorer(forest_plans(rows.p, **params), "gini", len(frame.classes))


def fit_bagging(train, frame, **params) -> Scorer:
    rows = Packed(train, frame.columns)
    return rows.scorer(bagging_plans(rows.p, **params), "gini", len(frame.classes))


def search_trees(frame: ClassFrame, name: str, grid: Mapping[str, Sequence], plans: Callable, fit: Callable, size: str | None = None) -> ModelResult:
    """Cross-validated search where one growth serves many settings.

    Settings that differ only in depth, smallest split or number of trees are grown once, to the deepest and
    largest of them, for as many folds together as the driver can hold: cutting a tree from the top gives the shallower
    one, leading trees give the smaller ensemble. Accuracies of all these settings come from one pass over the rows.
    """
    k = len(frame.classes)
    rows = Packed(frame.train, frame.columns, fold=F.col("fold"))
    grid = {key: list(values) for key, values in grid.items()}
    shared = {key: v for key, v in grid.items() if key not in ("max_depth", "min_split", size)}
    depths, splits = grid.get("max_depth", [DEEPEST]), grid.get("min_split", [2])
    sizes = sorted(grid[size]) if size else [1]
    cuts = list(itertools.product(depths, splits))
    accuracy = {}
    for common in settings(shared):
        extra = {key: max(grid[key]) if key != "min_split" else min(grid[key]) for key in ("max_depth", "min_split", size) if key in grid}
        criterion = common.get("impurity", "gini")
        arguments = {key: v for key, v in common.items() if key != "impurity"}
        each = {f: plans(rows.p, fold=f, **arguments, **extra) for f in range(frame.folds)}
        share, waiting, most = 0.0, list(each), rows.most_nodes
        while waiting:
            some = max(1, int(NODES_AT_ONCE // max(most * len(each[0]), 1)))
            folds, waiting = waiting[:some], waiting[some:]
            members = [q for f in folds for q in each[f]]
            forest = rows.grow(members, "class", criterion, k)
            got = T.hits(rows.blocks, forest, [q.fold for q in members], sizes, cuts, rows.p)
            for f, part in zip(folds, got):
                share = share + part / max(rows.rows.get(f, 0), 1)
            most = len(forest.feature) / len(members)
            del forest
        share = share / frame.folds
        for c, (depth, split) in enumerate(cuts):
            for s, n in enumerate(sizes):
                accuracy[(*common.items(), ("max_depth", depth), ("min_split", split), (size, n))] = float(share[c, s])

    def score(point: dict) -> float:
        common = {key: point[key] for key in shared}
        return accuracy[(*common.items(), ("max_depth", point.get("max_depth", depths[0])), ("min_split", point.get("min_split", splits[0])),
                         (size, point[size] if size else 1))]

    table, best = cv_table(frame, name, [(point, score(point)) for point in settings(grid)])
    return result(frame, name, predicted(fit(frame.train, frame, **best), frame.data, frame.classes), best, table)


def decision_tree(frame: ClassFrame, grid: Mapping = TREE_GRID) -> ModelResult:
    return search_trees(frame, "decision tree", grid, tree_plans, fit_tree)


def random_forest(frame: ClassFrame, grid: Mapping = FOREST_GRID) -> ModelResult:
    return search_trees(frame.scaled(), "random forest", grid, forest_plans, fit_forest, "trees")


def bagging(frame: ClassFrame, grid: Mapping = BAGGING_GRID) -> ModelResult:
    return search_trees(frame.scaled(), "bagging", grid, bagging_plans, fit_bagging, "estimators")


# --- boosting ----------------------------------------------------------------------------------------------------


class Boosting:
    """Multi-class boosting of many models in step.

    Model m is a setting and the fold it leaves out. Every round grows one tree per line of models and class on the
    gradients of the softmax loss, for all of them in the same passes, and moves the margins written beside the
    blocks. A row's gradients follow from its margins, so no more state is kept, and margins after 50 or 100 rounds
    are what a fit of that many rounds gives.

    Models that differ in smallest leaf and split only run as one line as long as the tree of the loosest obeys the
    limits of all: it is then the best tree for each of them. The first tree that does not parts the line.
    """

    def __init__(self, rows: Packed, classes: int, models: Sequence[tuple[dict, int]]):
        self.rows, self.k, self.models = rows, classes, list(models)
        lines: dict[tuple, list[int]] = {}
        for m, (point, fold) in enumerate(self.models):
            lines.setdefault((point.get("rate", 0.1), point.get("max_depth", 3), fold), []).append(m)
        self.lines = list(lines.values())
        self.tables: list[str] = []

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.lines), self.k

    @property
    def place(self) -> dict[int, int]:
        """The line of each model."""
        return {m: i for i, line in enumerate(self.lines) for m in line}

    def limits(self, m: int) -> tuple[int, int]:
        """Smallest leaf and smallest split, which is at least two leaves."""
        point = self.models[m][0]
        return point.get("min_rows", 1), max(point.get("min_split", 2), 2 * point.get("min_rows", 1))

    def start(self) -> DataFrame:
        """Margins are the logarithms of the class shares among the rows a model learns from."""
        p, k = self.rows.p, self.k
        counts = np.zeros((max(self.rows.rows, default=0) + 1, k))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(counts)
            for block in T.blocks_of(batches, p):
                use = block.fold >= 0
                np.add.at(total, (block.fold[use], block.y[use].astype(int)), 1)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

        for row in self.rows.blocks.mapInArrow(count, "n binary").toLocalIterator():
            counts += np.frombuffer(row.n).reshape(counts.shape)
        folds = [self.models[line[0]][1] for line in self.lines]
        seen = np.stack([counts.sum(axis=0) - (counts[f] if 0 <= f < len(counts) else 0) for f in folds])
        prior = np.log(np.maximum(seen, 1e-10) / np.maximum(seen.sum(axis=1, keepdims=True), 1)).astype(np.float32)

        def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    one = batch.slice(at, 1)
                    n = len(one.column("y")[0].as_py()) // 8
                    yield with_margins(one, np.repeat(prior[None], n, axis=0))

        return self.keep(self.rows.blocks.mapInArrow(attach, self.form))

    @property
    def form(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.blocks.schema if f.name != "margins") + ", margins binary"

    def keep(self, df: DataFrame) -> DataFrame:
        kept, path = keep_table(df, "margins")
        self.tables.append(path)
        return kept

    def gradients(self) -> Callable:
        """Gradients of a tree's class, in whole steps; the shares of a model serve all its classes."""

        def of(block: T.Block, q: T.Plan) -> np.ndarray:
            if block._draws.get("model") != q.model:
                block._draws.update(model=q.model, shares=softmax(block.margins[:, q.model].astype(float)))
            return np.round(((block.y == q.target) - block._draws["shares"][:, q.target]) / T.GRADIENT_STEP)

        return of

    def grow(self, state: DataFrame) -> list[tuple[T.Forest, list[tuple[int, list[int]]]]]:
        """Trees of one round: (forest, its lines as (line before, models)), the k trees of a line one after another."""
        waiting, out = list(enumerate(self.lines)), []
        while waiting:
            tried, waiting, plans = waiting, [], []
            leaders = [min(models, key=self.limits) for _, models in tried]
            for (line, _), m in zip(tried, leaders):
                point, fold = self.models[m]
                leaf, split = self.limits(m)
                plans += [T.Plan(fold, 0, 0.0, None, 0, leaf, split, point.get("max_depth", 3), line, c) for c in range(self.k)]
            forest = T.grow(
                state, plans, "gradient", "variance", self.rows.p, self.rows.bins, expected=self.rows.expected, shape=self.shape,
                gradients=self.gradients())
            inner = np.flatnonzero(forest.feature >= 0)
            count, owner = forest.stats[:, 0], (np.searchsorted(forest.root, inner, "right") - 1) // self.k
            split = np.full(len(tried), np.inf)
            leaf = np.full(len(tried), np.inf)
            np.minimum.at(split, owner, count[inner])
            np.minimum.at(leaf, owner, np.minimum(count[forest.left[inner]], count[forest.right[inner]]))
            agreed = []
            for i, ((line, models), leader) in enumerate(zip(tried, leaders)):
                low = self.limits(leader)
                fits = [m for m in models if low[0] <= self.limits(m)[0] <= max(leaf[i], low[0]) and low[1] <= self.limits(m)[1] <= max(split[i], low[1])]
                agreed.append((line, fits))
                rest = [m for m in models if m not in fits]
                if rest:
                    waiting.append((line, rest))
            out.append((forest, agreed))
        return out

    def round(self, state: DataFrame) -> tuple[DataFrame, T.Forest, np.ndarray]:
        """Margins after one more tree per line and class; also the first forest and its leaf values."""
        rows, k, shape, p = self.rows, self.k, self.shape, self.rows.p
        grown = self.grow(state)
        moves, self.lines, before = [], [], []
        for forest, agreed in grown:
            rates = np.repeat([self.models[models[0]][0].get("rate", 0.1) for _, models in agreed], k)
            tree = np.searchsorted(forest.root, np.arange(len(forest.feature)), "right") - 1
            g, h = forest.stats[:, 1], forest.stats[:, 2]
            value = np.divide(g, h, out=np.zeros_like(g), where=h > 1e-150) * (k - 1) / k * rates[tree]
            moves.append((forest, value))
            self.lines += [models for _, models in agreed]
            before += [line for line, _ in agreed]
        held = rows.spark.sparkContext.broadcast((moves, before))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves, before = held.value
            for batch in batches:
                for at in range(batch.num_rows):
                    one = batch.slice(at, 1)
                    block = next(T.blocks_of(iter([one]), p, shape))
                    margins = block.margins[:, before].reshape(len(block.y), -1)
                    start = 0
                    for forest, value in moves:
                        for low in range(0, len(forest.root), 128):
                            some = np.arange(low, min(low + 128, len(forest.root)))
                            margins[:, start + some] += value[forest.leaves(block.x, some)].astype(np.float32)
                        start += len(forest.root)
                    yield with_margins(one, margins)

        return self.keep(state.mapInArrow(move, self.form)), *moves[0]

    def run(self, stages: Sequence[int], at_stage: Callable[[int, DataFrame], None], seen: Callable | None = None) -> None:
        """Rounds up to the last of ``stages``; ``at_stage`` gets the margins at each. Spent margins are deleted."""
        state = self.start()
        wanted: set[str] = set()
        for r in range(1, max(stages) + 1):
            state, forest, value = self.round(state)
            if seen:
                seen(forest, value)
            remove_table(self.rows.spark, [t for t in self.tables[:-1] if t not in wanted])
            self.tables = [t for t in self.tables if t in wanted] + self.tables[-1:]
            if r in stages:
                wanted.add(self.tables[-1])
                at_stage(r, state)

    def hits(self, state: DataFrame) -> np.ndarray:
        """Right guesses of each line on the fold it left out."""
        p, shape, folds = self.rows.p, self.shape, np.asarray([self.models[line[0]][1] for line in self.lines])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(folds), np.int64)
            for block in T.blocks_of(batches, p, shape):
                right = np.argmax(block.margins, axis=2) == block.y[:, None]
                total += (right & (block.fold[:, None] == folds[None])).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

        out = np.zeros(len(folds), np.int64)
        for row in state.mapInArrow(run, "n binary").toLocalIterator():
            out += np.frombuffer(row.n, np.int64)
        return out


def line_probabilities(state: DataFrame, p: int, shape: tuple[int, int], line: int, id_type: str) -> DataFrame:
    """(id, probability) of one line of models from written margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                block = next(T.blocks_of(iter([one]), p, shape))
                shares = softmax(block.margins[:, line].astype(float))
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(list(shares), pa.list_(pa.float64()))], ["id", "probability"])

    return state.mapInArrow(run, f"id {id_type}, probability array<double>")


def softmax(margins: np.ndarray) -> np.ndarray:
    raw = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raw / raw.sum(axis=1, keepdims=True)


def with_margins(one: pa.RecordBatch, margins: np.ndarray) -> pa.RecordBatch:
    names = [n for n in one.schema.names if n != "margins"]
    return pa.RecordBatch.from_arrays(
        [*(one.column(n) for n in names), pa.array([np.ascontiguousarray(margins, np.float32).tobytes()], pa.binary())], [*names, "margins"])


def fit_boosting(train, frame, rounds=100, **point) -> Scorer:
    """One boosted model; the scorer adds ``probability`` and the margins as ``score``."""
    rows = Packed(train, frame.columns)
    k = len(frame.classes)
    model = Boosting(rows, k, [(point, -2)])
    forests, values = [], []

    def keep(forest, value):
        forests.append(forest)
        values.append(value)

    model.run([rounds], lambda r, state: None, keep)
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes
    n = sum(counts.values())
    prior = np.log([max(counts.get(float(i), 0), 1e-10) / max(n, 1) for i in range(k)])
    held = rows.spark.sparkContext.broadcast((forests, values, rows.edges))

    @F.pandas_udf("array<double>")
    def margins(points: pd.DataFrame) -> pd.Series:
        forests, values, edges = held.value
        if not len(points):
            return pd.Series([], dtype=object)
        x = T.binned(points.to_numpy(float), edges)
        out = np.repeat(prior[None].astype(np.float32), len(x), axis=0)
        for forest, value in zip(forests, values):
            out += value[forest.leaves(x, np.arange(k))].astype(np.float32)
        return pd.Series(list(out.astype(float)))

    columns = F.struct(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(frame.columns)])
    top = F.array_max("score")
    raw = F.transform("score", lambda v: F.exp(v - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return lambda df: df.withColumn("score", margins(columns)).withColumn("probability", F.transform(raw, lambda v: v / total))


def same_trees(point: Mapping) -> tuple:
    """Settings with equal values here grow equal trees: a leaf size of n already asks for 2 n rows in a split."""
    return point.get("rate", 0.1), point.get("max_depth", 3), point.get("min_rows", 1), max(point.get("min_split", 2), 2 * point.get("min_rows", 1))


def boosting(frame: ClassFrame, grid: Mapping = BOOSTING_GRID) -> ModelResult:
    """Search over all settings, folds and stages in one run of rounds; the models on all training rows run along."""
    frame = frame.scaled()
    k = len(frame.classes)
    grid = {key: list(values) for key, values in grid.items()}
    stages = sorted(grid.get("rounds", [100]))
    rows = Packed(frame.data, frame.columns, fold=F.when(F.col("split") == "train", F.col("fold")).otherwise(-1), ids=True, block_rows=MARGIN_ROWS)
    points: dict[tuple, dict] = {}
    for point in settings({key: v for key, v in grid.items() if key != "rounds"}):
        points.setdefault(same_trees(point), point)
    frames = [*range(frame.folds), -2]
    at_once = max(1, MODELS_AT_ONCE // len(frames))
    names = list(points)
    accuracy, kept = {}, {}
    for low in range(0, len(names), at_once):
        some = names[low : low + at_once]
        models = [(points[name], f) for name in some for f in frames]
        run = Boosting(rows, k, models)

        def at_stage(r, state, run=run, some=some):
            got, place, shape = run.hits(state), run.place, run.shape
            for i, name in enumerate(some):
                lines = [place[i * len(frames) + f] for f in range(len(frames))]
                share = sum(got[lines[f]] / max(rows.rows.get(f, 0), 1) for f in range(frame.folds)) / frame.folds
                accuracy[name, r] = float(share)
                kept[name, r] = (state, shape, lines[-1])

        run.run(stages, at_stage)
    scores = [(point, accuracy[same_trees(point), point.get("rounds", stages[-1])]) for point in settings(grid)]
    table, best = cv_table(frame, "boosting", scores)
    state, shape, line = kept[same_trees(best), best.get("rounds", stages[-1])]
    shares = line_probabilities(state, rows.p, shape, line, frame.data.schema["id"].dataType.simpleString())
    out = frame.data.select("id", "label", "split", "fold").join(shares, "id")
    return result(frame, "boosting", out.withColumn("prediction", first_largest(F.col("probability"), frame.classes)), best, table)


# --- importance --------------------------------------------------------------------------------------------------


def _importance_table(spark, columns: Sequence[str], weights, threshold: float) -> DataFrame:
    order = sorted(range(len(columns)), key=lambda i: (-float(weights[i]), i))
    rows = [(columns[i], float(weights[i]), r + 1, bool(weights[i] > threshold)) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int, selected boolean")


def regression_importance(df: DataFrame, target: str, columns: Sequence[str], trees: int = 100, max_depth: int = DEEPEST, threshold: float = 0.01) -> DataFrame:
    """Importance of each feature in a forest that regresses the ordinal class code; equal rows are drawn alike."""
    ids = ["id"] if "id" in df.columns else []
    rows = Packed(df.select(*ids, *columns, F.col(target).cast("double").alias("y")).na.drop("any"), columns)
    weights = rows.importance(forest_plans(rows.p, trees=trees, max_depth=max_depth, feature_subset="all"), "real", "variance")
    return _importance_table(df.sparkSession, list(columns), weights, threshold)


def classification_importance(frame: ClassFrame, trees: int = 100, max_depth: int = DEEPEST, threshold: float = 0.01) -> DataFrame:
    rows = Packed(frame.train, frame.columns)
    weights = rows.importance(forest_plans(rows.p, trees=trees, max_depth=max_depth), "class", "gini", len(frame.classes))
    return _importance_table(frame.data.sparkSession, frame.columns, weights, threshold)

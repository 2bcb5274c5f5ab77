"""Classifiers fitted from aggregates or joins: Gaussian naive Bayes, nearest neighbours, pruned tree."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.models.ensembles import DEEPEST
from colonnade.models.frame import ClassFrame, ModelResult, assembled, cv_table, first_largest, result
from colonnade.operators.neighbors import feature_array, knn_classify, knn_cv
from colonnade.operators.sampling import SEED
from colonnade.session import broadcast_if_small, scratch_path

# Default search grids.
SMOOTHING = (1e-9, 1e-8, 1e-7, 1e-6, 1e-5)
KNN_GRID = {"k": [3, 5, 7, 10, 15], "weights": ["uniform", "distance"], "p": [1, 2]}


class GaussianStats:
    """Count, mean and sum of squared deviations per class and column; parts can be added up."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray):
        self.n, self.mean, self.m2 = n, mean, m2

    def __add__(self, other: "GaussianStats") -> "GaussianStats":
        n = self.n + other.n
        safe = np.maximum(n, 1)[:, None]
        gap = other.mean - self.mean
        mean = self.mean + gap * other.n[:, None] / safe
        return GaussianStats(n, mean, self.m2 + other.m2 + gap * gap * (self.n * other.n)[:, None] / safe)

    def log_scores(self, columns: Sequence[str], smoothing: float) -> list[Column]:
        """Joint log likelihood per class; variances grow by smoothing times the largest variance."""
        total = self.n.sum()
        grand = (self.n[:, None] * self.mean).sum(0) / total
        overall = (self.m2.sum(0) + (self.n[:, None] * (self.mean - grand) ** 2).sum(0)) / total
        out = []
        for i in range(len(self.n)):
            if self.n[i] == 0:
                out.append(F.lit(-math.inf))
                continue
            var = self.m2[i] / self.n[i] + smoothing * overall.max()
            score = F.lit(float(math.log(self.n[i] / total) - 0.5 * np.log(2.0 * math.pi * var).sum()))
            for c, mean, v in zip(columns, self.mean[i], var):
                gap = F.col(c) - F.lit(float(mean))
                score = score - gap * gap / F.lit(float(2.0 * v))
            out.append(score)
        return out


def gaussian_stats(rows: DataFrame, frame: ClassFrame) -> dict[int, GaussianStats]:
    """Statistics per fold from one pass."""
    got = rows.groupBy("fold", "y").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{j}") for j, c in enumerate(frame.columns)],
        *[F.var_pop(c).alias(f"v{j}") for j, c in enumerate(frame.columns)],
    ).collect()  # folds x classes
    k, p = len(frame.classes), len(frame.columns)
    out: dict[int, GaussianStats] = {}
    for r in got:
        s = out.setdefault(r["fold"], GaussianStats(np.zeros(k), np.zeros((k, p)), np.zeros((k, p))))
        i = int(r["y"])
        s.n[i] = r["n"]
        s.mean[i] = [r[f"m{j}"] for j in range(p)]
        s.m2[i] = [r[f"v{j}"] * r["n"] for j in range(p)]
    return out


def _posterior(scores: Column) -> Column:
    top = F.array_max(scores)
    raw = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / total)


def naive_bayes(frame: ClassFrame, smoothing: Sequence[float] = SMOOTHING) -> ModelResult:
    """Whole search in two passes: fold statistics, then every row scored by the models without its fold."""
    parts = gaussian_stats(frame.train, frame)
    folds = sorted(parts)

    def without(f: int) -> GaussianStats:
        rest = [parts[g] for g in folds if g != f]
        total = rest[0]
        for s in rest[1:]:
            total = total + s
        return total

    hits = []
    for i, e in enumerate(smoothing):
        hit = F.lit(None).cast("double")
        for f in folds:
            if len(folds) > 1:
                guess = first_largest(F.array(*without(f).log_scores(frame.columns, e)), frame.classes)
                hit = F.when(F.col("fold") == f, (guess == F.col("label")).cast("double")).otherwise(hit)
        hits.append(hit.alias(f"h{i}"))
    per_fold = frame.train.select("fold", *hits).groupBy("fold").agg(*[F.avg(f"h{i}").alias(f"h{i}") for i in range(len(smoothing))])
    row = per_fold.agg(*[F.avg(f"h{i}").alias(f"h{i}") for i in range(len(smoothing))]).first()
    table, best = cv_table(frame, "naive bayes", [({"smoothing": e}, row[f"h{i}"] or 0.0) for i, e in enumerate(smoothing)])
    total = without(-99)
    scored = frame.data.withColumn("score", F.array(*total.log_scores(frame.columns, best["smoothing"])))
    rows = scored.withColumn("probability", _posterior(F.col("score"))).withColumn(
        "prediction", first_largest(F.col("score"), frame.classes)
    )
    return result(frame, "naive bayes", rows, best, table)


def nearest_neighbors(frame: ClassFrame, grid: Mapping = KNN_GRID) -> ModelResult:
    rows = frame.data.select("id", "label", "split", "fold", feature_array(frame.columns).alias("features"))
    train = rows.filter("split = 'train'")
    scores = []
    for p in grid["p"]:
        found = knn_cv(train, "label", grid["k"], frame.folds, weights=grid["weights"], p=p).collect()
        accuracy = {(r["k"], r["weights"]): r["accuracy"] for r in found}
        scores += [({"k": k, "weights": w, "p": p}, accuracy.get((k, w), 0.0)) for k in grid["k"] for w in grid["weights"]]
    table, best = cv_table(frame, "nearest neighbours", scores)
    voted = knn_classify(rows, train, "label", [best["k"]], weights=[best["weights"]], p=best["p"])
    total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
    out = rows.join(
        voted.select("id", "prediction", F.transform("votes", lambda v: v / total).alias("probability")), "id"
    )
    return result(frame, "nearest neighbours", out, best, table)


class TreeNodes:
    """The node table of one fitted tree with class counts filled in from leaf counts."""

    def __init__(self, nodes: list, counts: Mapping[int, np.ndarray], k: int):
        self.left = {r["id"]: r["leftChild"] for r in nodes if r["leftChild"] >= 0}
        self.right = {r["id"]: r["rightChild"] for r in nodes if r["rightChild"] >= 0}
        self.parent = {c: p for side in (self.left, self.right) for p, c in side.items()}
        self.order: list[int] = []  # preorder
        stack = [0]
        while stack:
            node = stack.pop()
            self.order.append(node)
            if node in self.left:
                stack += [self.right[node], self.left[node]]
        leaves = [n for n in self.order if n not in self.left]
        self.leaf_of = dict(enumerate(leaves))  # MLlib numbers leaves in preorder
        self.number = {n: i for i, n in self.leaf_of.items()}
        self.counts = {n: np.zeros(k) for n in self.order}
        for i, n in self.leaf_of.items():
            self.counts[n] = counts.get(i, np.zeros(k)).astype(float)
        for n in reversed(self.order):
            if n in self.left:
                self.counts[n] = self.counts[self.left[n]] + self.counts[self.right[n]]

    def cost(self, node: int) -> float:
        """Gini impurity weighted by the share of rows in the node."""
        c, total = self.counts[node], self.counts[0].sum()
        n = c.sum()
        return float(n / total * (1.0 - ((c / n) ** 2).sum())) if n else 0.0

    def leaves_under(self, node: int) -> list[int]:
        found, stack = [], [node]
        while stack:
            at = stack.pop()
            if at in self.left:
                stack += [self.left[at], self.right[at]]
            else:
                found.append(self.number[at])
        return found

    def path(self) -> list[tuple[float, list[int]]]:
        """(alpha, nodes that become leaves at this step) from the full tree to the root.

        A node's strength is what its subtree saves per leaf. The weakest nodes wait in a heap; cutting one
        changes only the nodes above it, whose entries are renewed, so a step costs the height of the tree.
        """
        own = {n: self.cost(n) for n in self.order}
        below, leaves = dict(own), dict.fromkeys(self.order, 1)
        for n in reversed(self.order):
            if n in self.left:
                below[n] = below[self.left[n]] + below[self.right[n]]
                leaves[n] = leaves[self.left[n]] + leaves[self.right[n]]
        strength = {n: (own[n] - below[n]) / (leaves[n] - 1) for n in self.left}
        heap = [(g, n) for n, g in strength.items()]
        heapq.heapify(heap)
        gone: set[int] = set()
        out, alpha = [(0.0, [])], 0.0
        while heap:
            low = heap[0][0]
            if strength.get(heap[0][1]) != low:
                heapq.heappop(heap)
                continue
            # All nodes that are as weak before anything is cut; one below another goes with it.
            batch = []
            while heap and heap[0][0] <= low + 1e-15:
                g, n = heapq.heappop(heap)
                if strength.get(n) == g and n not in batch:
                    batch.append(n)
            weak, top = set(batch), []
            for n in batch:
                up = self.parent.get(n)
                while up is not None and up not in weak:
                    up = self.parent.get(up)
                if up is None:
                    top.append(n)
            for n in top:
                stack = [n]
                while stack:
                    at = stack.pop()
                    if at in self.left and at not in gone:
                        strength.pop(at, None)
                        stack += [self.left[at], self.right[at]]
                    if at != n:
                        gone.add(at)
                saved, fewer = below[n] - own[n], leaves[n] - 1
                below[n], leaves[n] = own[n], 1
                gone.add(n)
                up = self.parent.get(n)
                while up is not None:
                    below[up] -= saved
                    leaves[up] -= fewer
                    if up in strength and up not in weak:
                        strength[up] = (own[up] - below[up]) / (leaves[up] - 1) if leaves[up] > 1 else 0.0
                        heapq.heappush(heap, (strength[up], up))
                    up = self.parent.get(up)
            alpha = max(alpha, low)
            out.append((alpha, top))
        return out

    def ends(self, cut: Sequence[int], now: dict[int, int]) -> list[int]:
        """Leaves that end at one of the ``cut`` nodes from now on; ``now`` (leaf -> end node) is brought up to date."""
        moved = []
        for n in cut:
            stack = [n]
            while stack:
                at = stack.pop()
                if at in self.left:
                    stack += [self.left[at], self.right[at]]
                else:
                    now[self.number[at]] = n
                    moved.append(self.number[at])
        return moved


def _grown(frame: ClassFrame, rows: DataFrame, grow: Column, max_depth: int) -> tuple[DataFrame, list]:
    """Every row with its leaf in a tree grown on the ``grow`` rows, and the node table (bounded by the tree)."""
    tree = DecisionTreeClassifier(labelCol="y", featuresCol="_f", maxDepth=max_depth, leafCol="leaf", seed=SEED)
    model = tree.fit(rows.filter(grow))
    spark = frame.data.sparkSession
    path = scratch_path(spark, "tree")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("id", "leftChild", "rightChild").collect()
    leaves = model.transform(rows).select("id", "label", "split", "fold", "y", F.col("leaf").cast("int").alias("leaf"))
    return leaves, nodes


def _leaf_counts(leaves: DataFrame, k: int, **parts: Column) -> dict[str, dict[int, np.ndarray]]:
    """Rows per leaf and class for each part (leaves x classes rows reach the driver)."""
    cells = leaves.groupBy("leaf", "y").agg(*[F.count_if(c).alias(n) for n, c in parts.items()]).collect()
    out: dict[str, dict[int, np.ndarray]] = {name: {} for name in parts}
    for r in cells:
        for name, table in out.items():
            table.setdefault(r["leaf"], np.zeros(k))[int(r["y"])] += r[name]
    return out


def pruned_tree(frame: ClassFrame, max_depth: int = DEEPEST, select_on: str = "fold") -> tuple[ModelResult, DataFrame]:
    """Cost-complexity pruning: (result, path table).

    Class counts per leaf give the accuracy of every alpha without another scan. Alpha is chosen with fold 0
    held back from growing, or on the test rows when ``select_on='test'``. The delivered tree is then grown on
    all training rows and pruned with that alpha.
    """
    spark, k = frame.data.sparkSession, len(frame.classes)
    train = F.col("split") == "train"
    grow = train & (F.col("fold") != 0) if select_on == "fold" else train
    choose = train & (F.col("fold") == 0) if select_on == "fold" else F.col("split") == "test"
    rows = assembled(frame.data, frame.columns, "_f")
    leaves, nodes = _grown(frame, rows, grow, max_depth)
    part = _leaf_counts(leaves, k, grown=grow, chosen=choose, test=F.col("split") == "test")
    shape = TreeNodes(nodes, part["grown"], k)
    report, best = [], None
    now, guess = dict(shape.leaf_of), {}
    right = dict.fromkeys(part, 0.0)
    rows_in = {name: max(sum(t.sum() for t in table.values()), 1) for name, table in part.items()}

    def hits(leaf: int) -> dict[str, float]:
        return {name: table[leaf][guess[leaf]] if leaf in table else 0.0 for name, table in part.items()}

    for leaf, node in now.items():
        guess[leaf] = int(np.argmax(shape.counts[node]))
        right = {name: right[name] + h for name, h in hits(leaf).items()}
    ends = len(now)
    for alpha, cut in shape.path():
        before = len({now[leaf] for n in cut for leaf in shape.leaves_under(n)})
        for leaf in shape.ends(cut, now):
            right = {name: right[name] - h for name, h in hits(leaf).items()}
            guess[leaf] = int(np.argmax(shape.counts[now[leaf]]))
            right = {name: right[name] + h for name, h in hits(leaf).items()}
        ends += len(cut) - before
        hit = {name: right[name] / rows_in[name] for name in part}
        report.append((float(alpha), ends, float(hit["grown"]), float(hit["chosen"]), float(hit["test"])))
        if best is None or hit["chosen"] > best[0]:
            best = (hit["chosen"], alpha)
    _, alpha = best
    if select_on == "fold":
        leaves, nodes = _grown(frame, rows, train, max_depth)
        shape = TreeNodes(nodes, _leaf_counts(leaves, k, grown=train)["grown"], k)
    now = dict(shape.leaf_of)
    for step, cut in shape.path():
        if step <= alpha:
            shape.ends(cut, now)
    share = lambda n: (shape.counts[n] / max(shape.counts[n].sum(), 1)).tolist()
    lookup = spark.createDataFrame(
        [(leaf, frame.classes[int(np.argmax(shape.counts[n]))], share(n)) for leaf, n in now.items()],
        "leaf int, prediction string, probability array<double>",
    )
    out = leaves.join(broadcast_if_small(lookup), "leaf")
    table = spark.createDataFrame(report, "alpha double, leaves int, train_accuracy double, choose_accuracy double, test_accuracy double")
    cv, _ = cv_table(frame, "pruned tree", [({"alpha": float(alpha)}, float(best[0]))])
    return result(frame, "pruned tree", out, {"alpha": float(alpha)}, cv), table

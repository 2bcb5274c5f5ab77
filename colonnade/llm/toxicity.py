"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.ngrams import code_points, gram_slots, slices
from colonnade.llm.storage import Scratch, bounded_rows, dense_counts

ORDERS = (5, 6, 7)
SLOTS = 1 << 20  # for all orders together
SMOOTHING = 1.0
ROUNDS = 40
PENALTY = 3e-3

# A slot must occur in so many labelled documents to count.
LEAST_DOCUMENTS = 8

# A slot whose log-count ratio is nearer to 0 says too little to be kept.
LEAST_RATIO = 0.3

# Tasks over which the bounded training sample is spread, each of which returns one gradient.
FIT_TASKS = 8

# Most labelled documents that the gradient steps read; beyond it a hash of the id chooses about so many. The counts
# are those of all labelled documents.
TRAIN_ROWS = 20_000

THRESHOLD = 0.3


@dataclass
class ToxicModel:
    """``weight``: per slot, log-count ratio times learned coefficient; a text scores sigmoid(bias + sum over its slots)."""

    weight: np.ndarray
    bias: float
    orders: tuple[int, ...]


def present_slots(points: np.ndarray, starts: np.ndarray, orders, slots: int) -> Iterator[np.ndarray]:
    """The distinct slots of each text, ascending."""
    grams = gram_slots(points, starts, orders, slots)
    for a, b in zip(starts[:-1], starts[1:]):
        found = np.concatenate([slot[a : max(a, b - order + 1)] for order, slot in zip(orders, grams)])
        found.sort()
        keep = np.ones(len(found), bool)
        keep[1:] = found[1:] != found[:-1]
        yield found[keep]


class _Descent:
    """Limited-memory quasi-Newton steps (two-loop recursion) with a backtracking line search."""

    def __init__(self, memory: int = 8):
        self.memory, self.steps, self.turns = memory, [], []

    def direction(self, grad: np.ndarray) -> np.ndarray:
        q, kept = grad.copy(), []
        for s, y in zip(reversed(self.steps), reversed(self.turns)):
            rho = 1 / (y @ s)
            a = rho * (s @ q)
            q -= a * y
            kept.append((rho, a))
        if self.steps:
            q *= (self.steps[-1] @ self.turns[-1]) / (self.turns[-1] @ self.turns[-1])
        for (s, y), (rho, a) in zip(zip(self.steps, self.turns), reversed(kept)):
            q += s * (a - rho * (y @ q))
        return -q

    def learn(self, step: np.ndarray, turn: np.ndarray) -> None:
        if step @ turn > 1e-12:
            self.steps, self.turns = (self.steps + [step])[-self.memory :], (self.turns + [turn])[-self.memory :]


def fit_toxicity(
    labelled: DataFrame, orders=ORDERS, slots: int = SLOTS, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS,
    penalty: float = PENALTY,
) -> ToxicModel:
    """Learn from ``labelled`` (doc_id, text, label 0/1); rows without a label teach nothing.

    Documents per class and slot, over all rows, give the log-count ratio of each slot. Then logistic regression on the
    scaled features that say something, over about ``train_rows`` rows; each step is one Spark job that adds up the
    gradient over the written features. A slot that none of these rows has takes the mean coefficient of the others.
    With one class only, every text scores that class's share.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labelled.filter(F.col("label").isin(0, 1)).select("doc_id", "text", F.col("label").cast("int"))

    def class_counts(batch: pa.RecordBatch) -> np.ndarray:
        """Documents per class and slot, then documents per class."""
        total = np.zeros(2 * slots + 2, np.int64)
        for part in slices(batch, "text", 1 << 19):
            points, starts = code_points(part.column("text"))
            for label, found in zip(part.column("label").to_pylist(), present_slots(points, starts, orders, slots)):
                total[label * slots + found] += 1
                total[2 * slots + label] += 1
        return total

    # Every task hands on one array: their number follows the cores, not the rows.
    counts = dense_counts(known.coalesce(4 * spark.sparkContext.defaultParallelism), 2 * slots + 2, class_counts)
    n = counts[2 * slots :]
    if not n.all():
        share = float((n[1] + 0.5) / (n.sum() + 1))
        return ToxicModel(np.zeros(slots, np.float32), float(np.log(share / (1 - share))), tuple(orders))
    p, q = counts[slots : 2 * slots] + SMOOTHING, counts[:slots] + SMOOTHING
    every = np.log(p / (n[1] + 2 * SMOOTHING)) - np.log(q / (n[0] + 2 * SMOOTHING))
    seen = counts[:slots] + counts[slots : 2 * slots]
    used = np.flatnonzero((seen >= min(LEAST_DOCUMENTS, n.min())) & (np.abs(every) >= LEAST_RATIO))
    ratio = every[used]
    place = np.full(slots, -1, np.int32)
    place[used] = np.arange(len(used))
    places = spark.sparkContext.broadcast(place)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                points, starts = code_points(part.column("text"))
                found = [known[f] for f in present_slots(points, starts, orders, slots)]
                found = [f[f >= 0].astype("<u4").tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(found, pa.binary())], ["label", "found"])

    texts = scratch.keep(bounded_rows(known, "doc_id", train_rows).select("text", "label"), "texts")
    sample = scratch.keep(texts.coalesce(FIT_TASKS).mapInArrow(describe, "label int, found binary"), "features")
    features = sample.coalesce(FIT_TASKS)

    def sample_counts(batch: pa.RecordBatch) -> np.ndarray:
        """Rows per used slot, then rows per class."""
        found = np.frombuffer(b"".join(batch.column("found").to_pylist()), "<u4")
        classes = np.bincount(np.asarray(batch.column("label")), minlength=2)
        return np.concatenate([np.bincount(found, minlength=len(used)), classes])

    held = dense_counts(features, len(used) + 2, sample_counts)
    sampled, n = held[:-2] > 0, np.maximum(held[-2:], 1)
    # Rare toxic documents weigh more, by the root of the ratio of the classes.
    rare = float(np.sqrt(n[0] / n[1]))
    scale = 1 / (n[0] + rare * n[1])

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(((ratio * theta[:-1]).astype(np.float32), float(theta[-1])))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, bias = held.value
            grad, loss = np.zeros(len(weight) + 1, np.float32), 0.0
            for batch in batches:
                for label, raw in zip(batch.column("label").to_pylist(), batch.column("found").to_pylist()):
                    found = np.frombuffer(raw, "<u4")
                    z = float(weight[found].sum()) + bias
                    loss += (rare if label else 1.0) * np.logaddexp(0, -z if label else z)
                    error = (rare if label else 1.0) * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
                    grad[found] += error
                    grad[-1] += error
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["loss", "grad"])

        parts = features.mapInArrow(step, "loss double, grad binary").collect()
        held.destroy()
        grad = np.sum([np.frombuffer(r.grad, np.float32) for r in parts], axis=0, dtype=np.float64)
        grad[:-1] *= ratio
        value = scale * sum(r.loss for r in parts) + penalty / 2 * float(theta[:-1] @ theta[:-1])
        grad *= scale
        grad[:-1] += penalty * theta[:-1]
        return value, grad

    theta = np.zeros(len(used) + 1)
    theta[-1] = np.log(rare * n[1] / n[0])
    value, grad = objective(theta)
    descent = _Descent()
    for _ in range(rounds):
        move = descent.direction(grad)
        rate = 1.0 if descent.steps else min(1.0, 1.0 / max(1e-12, np.abs(grad).sum()))
        slope = float(grad @ move)
        for _ in range(12):
            tried = theta + rate * move
            new_value, new_grad = objective(tried)
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        descent.learn(tried - theta, new_grad - grad)
        done = value - new_value < 1e-4 * value
        theta, value, grad = tried, new_value, new_grad
        if done:
            break
    scratch.drop(texts, sample)
    if sampled.any():
        theta[:-1][~sampled] = theta[:-1][sampled].mean()
    weight = np.zeros(slots, np.float32)
    weight[used] = ratio * theta[:-1]
    return ToxicModel(weight, float(theta[-1]), tuple(orders))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of all labelled documents.

    ``labels`` (doc_id, label) are written first; while they are small no text is shuffled. Of several labels of an
    id the largest counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    scratch = Scratch(docs.sparkSession, "labels")
    return docs.select("doc_id", "text").join(scratch.small(scratch.keep(known, "labels")), "doc_id")


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text), 0 to 1, higher for toxic texts.

    An empty or null text scores by the bias alone. Rows are independent: no shuffle; the model is a fixed
    number of slots.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                points, starts = code_points(part.column("text"))
                found = present_slots(points, starts, known.orders, len(known.weight))
                z = np.array([known.weight[f].sum(dtype=np.float64) for f in found]) + known.bias
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")

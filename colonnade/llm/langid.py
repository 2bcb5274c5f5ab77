"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.ngrams import code_points, gram_slots, slices
from colonnade.llm.storage import bounded_rows, dense_counts

ORDERS = (1, 2, 3)
SLOTS = 1 << 15  # per order
SMOOTHING = 0.5

# Most labelled documents that the model is fitted on; beyond it a hash of the id chooses about so many.
TRAIN_ROWS = 60_000

UNKNOWN = "und"

# Least posterior probability at which a filter accepts a language.
LEAST_SCORE = 0.5


@dataclass
class LanguageModel:
    """``log_prob``: a row per slot of every order and a column per language; ``prior``: log share of documents."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    slots: int


def gram_counts(texts: pa.Array, classes: np.ndarray, n_classes: int, orders, slots: int) -> np.ndarray:
    """N-grams per (class, order, slot) as one flat array; ``classes`` holds a class number per text."""
    points, starts = code_points(texts)
    owner = np.repeat(classes, np.diff(starts))
    width = len(orders) * slots
    total = np.zeros(n_classes * width, np.int64)
    for k, slot in enumerate(gram_slots(points, starts, orders, slots)):
        inside = slot >= 0
        place = owner[inside]
        place *= width
        place += slot[inside]
        place += k * slots
        total += np.bincount(place, minlength=len(total))
    return total


def fit_languages(labelled: DataFrame, orders=ORDERS, slots: int = SLOTS, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing.

    Counts per language and slot are added up by Spark; their number is languages x slots whatever the input.
    """
    known = bounded_rows(
        labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"),
        "doc_id", train_rows,
    )
    shares = {row.lang: row.n for row in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(shares)
    width = len(orders) * slots
    if not languages:
        return LanguageModel([], np.zeros((width, 0), np.float32), np.zeros(0), tuple(orders), slots)
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(len(languages) * width, np.int64)
        for part in slices(batch, "text", 1 << 19):
            classes = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
            total += gram_counts(part.column("text"), classes, len(languages), orders, slots)
        return total

    counts = dense_counts(known.select("text", "lang"), len(languages) * width, count)
    counts = counts.reshape(len(languages), len(orders), slots) + SMOOTHING
    log_prob = np.log(counts / counts.sum(axis=2, keepdims=True)).reshape(len(languages), width).T
    documents = np.array([shares[x] for x in languages], float)
    return LanguageModel(languages, np.ascontiguousarray(log_prob, np.float32), np.log(documents / documents.sum()), tuple(orders), slots)


def score_texts(model: LanguageModel, texts: pa.Array) -> np.ndarray:
    """Posterior probabilities, a row per text and a column per language."""
    points, starts = code_points(texts)
    total = np.tile(model.prior, (len(texts), 1))
    for k, slot in enumerate(gram_slots(points, starts, model.orders, model.slots)):
        values = model.log_prob[np.where(slot >= 0, slot + np.int32(k * model.slots), 0)]
        values[slot < 0] = 0
        total += np.add.reduceat(values, starts[:-1], axis=0, dtype=np.float64)
    total -= total.max(axis=1, keepdims=True)
    odds = np.exp(total)
    return odds / odds.sum(axis=1, keepdims=True)


def _judged(model: LanguageModel, texts: pa.Array, letter) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language (-1: unknown) and its posterior probability for each text."""
    usable = np.array([bool(model.languages) and t is not None and letter(t) is not None for t in texts.to_pylist()], bool)
    if not usable.any():
        return np.full(len(usable), -1), np.zeros(len(usable))
    odds = score_texts(model, texts)
    best = odds.argmax(axis=1)
    return np.where(usable, best, -1), np.where(usable, odds[np.arange(len(odds)), best], 0.0)


def _slice_bytes(model: LanguageModel) -> int:
    """Text per step, so that the gathered probabilities stay within some tens of MB."""
    return max(1 << 16, (2 << 20) // max(4, len(model.languages)))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text).

    ``score`` is the posterior probability of the predicted language; equal scores go to the first name. A
    text that is null or has no letter gets ``und`` and 0, as does every text if no language was learned.
    Rows are independent: no shuffle; the model is broadcast and its size is slots x languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        known = shared.value
        names = [*known.languages, UNKNOWN]
        for batch in batches:
            for part in slices(batch, "text", _slice_bytes(known)):
                best, score = _judged(known, part.column("text"), letter)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([names[b] for b in best], pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: LanguageModel, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text has a known language with at least ``least_score``.

    Null texts and texts without a letter go; if no language was learned, every row goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text", _slice_bytes(known)):
                best, score = _judged(known, part.column("text"), letter)
                yield part.filter(pa.array((best >= 0) & (score >= least_score), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.links import components
from colonnade.llm.storage import Scratch, bounded_rows

COSINE = 0.98

# Vectors that the rotation is learned from.
FIT_ROWS = 20_000
FIT_ROUNDS = 30

# Tables of the index, bits of a code per table, and bits that a probe may differ by (0 or 1).
TABLES = 4
TABLE_BITS = 16


@dataclass
class Rotation:
    centre: np.ndarray
    turn: np.ndarray  # dimension x bits


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = FIT_ROUNDS, seed: int = 5) -> Rotation:
    """Centre, project on random orthonormal axes, then alternate codes = signs and rotation = best fit to the codes."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    blocks = []
    while sum(b.shape[1] for b in blocks) < bits:
        # More bits than dimensions: further rotations of the same space, each fitted on its own.
        axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        flat = (sample - centre) @ axes
        turn = np.eye(dim)
        for _ in range(rounds if len(sample) else 0):
            codes = np.where(flat @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ flat)
            turn = (u @ vt).T
        blocks.append(axes @ turn)
    return Rotation(centre, np.concatenate(blocks, axis=1)[:, :bits])


def unit_rows(vectors: pa.Array) -> list[np.ndarray]:
    """Each vector in double precision, scaled to length 1."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(vectors)))])
    values = np.asarray(vectors.flatten(), np.float64)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        row = values[a:b] / np.abs(values[a:b]).max()
        out.append(row / np.sqrt(row @ row))
    return out


def _matrix(rows: list[list[float]], dim: int) -> np.ndarray:
    flat = np.array(rows, np.float64).reshape(-1, dim)
    flat /= np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows that can link: no null label, null or empty vector, null or non-finite component or zero vector."""
    parts = F.col("embedding")
    good = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    filled = embeddings.filter(F.col("label").isNotNull() & parts.isNotNull()).filter((F.size(parts) > 0) & good)
    return filled.filter(F.exists(parts, lambda x: x != 0)).select("vec_id", "label", "embedding")


def similar_pairs(scratch: Scratch, vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, bits: int = TABLE_BITS) -> DataFrame:
    """(a, b), a < b: pairs of ``vectors`` (node, label, embedding) of one label whose cosine reaches ``cosine``.

    A code has tables x bits signs. Vectors meet if the codes agree, up to one sign, in the part of one
    table. At cosine 0.98 a sign differs with probability 0.064, so a pair is missed with probability
    (1 - 0.728) ** 4 = 0.006. Buckets have no cap; the bits of a part should follow the logarithm of the rows.
    """
    spark = vectors.sparkSession
    dims = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0].d if dims else 1
    rows = bounded_rows(vectors.filter(F.size("embedding") == dim), "node", FIT_ROWS).select("embedding").collect()
    rotation = learn_rotation(_matrix([r.embedding for r in rows], dim), tables * bits)
    shared = spark.sparkContext.broadcast(rotation)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        places = 1 << np.arange(bits, dtype=np.int64)
        flips = np.concatenate([[0], places])
        for batch in batches:
            units = unit_rows(batch.column("embedding"))
            flat = np.zeros((len(units), len(known.centre)))
            for row, u in zip(flat, units):
                row[: min(len(u), len(row))] = u[: len(row)]
            signs = ((flat - known.centre) @ known.turn >= 0).reshape(len(flat), tables, bits)
            part = signs @ places + (np.arange(tables, dtype=np.int64) << (bits + 1))
            probes = part[:, :, None] ^ flips
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), pa.array(list(part), pa.list_(pa.int64())),
                 pa.array(list(probes.reshape(len(flat), -1)), pa.list_(pa.int64()))],
                ["node", "label", "parts", "probes"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    coded = scratch.keep(
        vectors.select("node", "label", "embedding").mapInArrow(keys, f"node long, label {kind}, parts array<long>, probes array<long>"),
        "codes",
    )
    index = coded.select(F.col("node").alias("a"), "label", F.explode("parts").alias("key"))
    probe = coded.select(F.col("node").alias("b"), "label", F.explode("probes").alias("key"))
    # A probe that differs by one sign finds the pair from both ends; a < b keeps one of them.
    found = scratch.keep(
        index.join(probe, ["label", "key"]).filter("a < b").select("a", "b").distinct(), "candidates"
    )
    left = vectors.select(F.col("node").alias("a"), F.col("embedding").alias("u"))
    right = vectors.select(F.col("node").alias("b"), F.col("embedding").alias("v"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = unit_rows(batch.column("u")), unit_rows(batch.column("v"))
            near = [len(x) == len(y) and float(x @ y) >= cosine for x, y in zip(u, v)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    pairs = found.join(left, "a").join(right, "b").select("a", "b", "u", "v").mapInArrow(rerank, "a long, b long")
    out = scratch.keep(pairs, "pairs")
    scratch.drop(coded, found)
    return out


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, bits: int = TABLE_BITS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors of a label form one class before anything is compared; a class counts its members as links
    of one another. Vectors without a usable label or embedding link with nothing, like vectors of different
    length. Rows that repeat a vec_id are vectors of their own and are named by that id; a null vec_id takes
    part and stays null.
    """
    scratch = Scratch(embeddings.sparkSession, "vectors")
    usable = usable_vectors(embeddings)
    classes = scratch.keep(
        usable.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    pairs = similar_pairs(scratch, classes, cosine, tables, bits)
    sizes = classes.select("node", "members", "low")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes.select(F.col("node").alias("b"), "members"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("members").alias("others"))
    labels = components(scratch, pairs)
    named = sizes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = scratch.keep(
        classes.select("node", "label", "embedding", "members").join(linked, "node", "left")
        .join(named.select("node", "root"), "node").join(lowest, "root")
        .select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "component_id",
                (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")),
        "facts",
    )
    scratch.drop(classes, pairs)
    out = embeddings.select("vec_id", "label", "embedding").join(
        scratch.small(facts), (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left"
    )
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

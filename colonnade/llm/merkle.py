"""Merkle manifest of a table: leaf digests, subtrees per language, proofs by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.storage import Scratch
from colonnade.operators.ordering import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Levels of a tree that one task builds at once; a group has at most 2 ** LEVELS nodes of 32 bytes.
LEVELS = 10

# Before each sibling in a proof segment: none, to the right, to the left.
NONE, RIGHT, LEFT = b"\x00", b"\x01", b"\x02"


def parent_digest(left: bytes, right: bytes | None) -> bytes:
    """sha256 of the digests' hex texts, one after the other."""
    return hashlib.sha256((left.hex() + (right.hex() if right else "")).encode()).digest()


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]), 256))


def _climb(levels: int):
    """Nodes of a block in order (tree, level, at, width, digest) -> the block's inner nodes on ``levels`` levels.

    Rows come sorted by tree and position, so a block is done when the next one begins. ``width`` is the number of
    nodes on the level in the whole tree, which says when the root is reached.
    """
    columns = ("tree", "level", "at", "width", "digest", "left", "right")

    def inner(tree: int, level: int, at: int, width: int, nodes: list[bytes]) -> Iterator[tuple]:
        for _ in range(levels):
            if width <= 1:
                return
            level, at, width = level + 1, at >> 1, (width + 1) >> 1
            pairs = [(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
            nodes = [parent_digest(*p) for p in pairs]
            for i, (node, (left, right)) in enumerate(zip(nodes, pairs)):
                yield tree, level, at + i, width, node, left, right

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, start, nodes = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "at", "width", "digest"))):
                tree, level, at, width, digest = row
                if (tree, at >> levels) != name:
                    if nodes:
                        yield from inner(*start, nodes)
                    name, start, nodes = (tree, at >> levels), (tree, level, at, width), []
                nodes.append(digest)
        if nodes:
            yield from inner(*start, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for row in blocks(batches):
            found.append(row)
            if len(found) == 4096:
                yield _inner_batch(found, columns)
                found = []
        yield _inner_batch(found, columns)

    return run


def _inner_batch(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def inner_nodes(scratch: Scratch, leaves: DataFrame, largest: int) -> DataFrame:
    """All inner nodes (tree, level, at, width, digest, left, right) above ``leaves`` (tree, at, width, digest).

    Each round deals blocks of 2 ** LEVELS neighbours out and climbs LEVELS levels; ``largest`` is the width of the
    widest tree.
    """
    form = "tree bigint, level int, at bigint, width bigint, digest binary, left binary, right binary"
    step = leaves.select("tree", F.lit(0).alias("level"), "at", "width", "digest")
    parts, level = [], 0
    while True:
        block = F.shiftright("at", LEVELS)
        dealt = step.repartition("tree", block).sortWithinPartitions("tree", "at")
        parts.append(scratch.keep(dealt.mapInArrow(_climb(LEVELS), form), "nodes"))
        level, largest = level + LEVELS, -(-largest >> LEVELS)  # rounded up
        if largest <= 1:
            break
        step = parts[-1].filter(F.col("level") == level).select("tree", "level", "at", "width", "digest")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def height(width: int) -> int:
    return max(0, (width - 1).bit_length())


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root that a leaf and its segments lead to, and the digest of the siblings."""
    for batch in batches:
        roots, proofs = [], []
        for node, path in zip(batch.column("start").to_pylist(), batch.column("path").to_pylist()):
            at, siblings, path = 0, [], path or b""
            while at < len(path):
                side = path[at : at + 1]
                if side == NONE:
                    node, at = parent_digest(node, None), at + 1
                    continue
                other = path[at + 1 : at + 33]
                node = parent_digest(node, other) if side == RIGHT else parent_digest(other, node)
                siblings.append(other.hex())
                at += 33
            roots.append(node.hex())
            proofs.append(hashlib.sha256("".join(siblings).encode()).hexdigest())
        keep = [c for c in batch.schema.names if c not in ("start", "path")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(proofs, pa.string()), pa.array(roots, pa.string())], [*keep, "proof_sha256", "folded_root"])


def proof_paths(scratch: Scratch, inner: DataFrame, top: DataFrame, heights: int) -> DataFrame:
    """(tree, at, path) per leaf: the siblings up to the root, by pointer jumping.

    Every node starts with a pointer to its parent and the one sibling below it. A round joins each node with the
    node its pointer names, appends that node's segment and takes over its pointer, which doubles the distance;
    after round r only nodes on every 2 ** (r + 1)-th level of a subtree are still asked for. Nodes above the
    subroots (tree -1) belong to subtrees of many heights and all stay.
    """

    def children(nodes: DataFrame) -> DataFrame:
        up = F.struct("tree", "level", "at")
        left = F.struct(
            (F.col("at") * 2).alias("at"),
            F.when(F.col("right").isNull(), F.lit(bytearray(NONE))).otherwise(F.concat(F.lit(bytearray(RIGHT)), F.col("right"))).alias("path"))
        right = F.struct(
            (F.col("at") * 2 + 1).alias("at"),
            F.when(F.col("right").isNotNull(), F.concat(F.lit(bytearray(LEFT)), F.col("left"))).alias("path"))
        each = F.explode(F.filter(F.array(left, right), lambda c: c["path"].isNotNull())).alias("child")
        return nodes.select("tree", (F.col("level") - 1).alias("level"), up.alias("up"), each).select("tree", "level", "child.at", "up", "child.path")

    own, above = children(inner), children(top)
    # A subroot (the node of its subtree that is nobody's child) goes on as a leaf of the top tree.
    roots = inner.filter("width = 1").select(F.col("tree").alias("at"), F.col("level").alias("root_level"))
    joined = above.filter("level = 0").join(roots, "at", "left").select(
        F.col("at").alias("tree"), F.coalesce("root_level", F.lit(0)).alias("level"), F.lit(0).cast("bigint").alias("at"), "up", "path")
    nodes = scratch.keep(own.unionByName(joined).unionByName(above.filter("level > 0")), "segments")
    distance = 1
    while distance < heights:
        left = nodes.filter((F.col("tree") < 0) | (F.pmod("level", F.lit(2 * distance)) == 0))
        right = nodes.filter((F.col("tree") < 0) | (F.pmod("level", F.lit(2 * distance)) == distance)).select(
            F.struct("tree", "level", "at").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        right = scratch.small(scratch.keep(right, "targets"))
        hop = left.join(right, "up", "left")
        before, nodes = nodes, scratch.keep(hop.select(
            "tree", "level", "at", F.col("next").alias("up"), F.concat("path", F.coalesce("more", F.lit(bytearray()))).alias("path")), "segments")
        scratch.drop(before)
        distance *= 2
    return nodes.filter("level = 0 and tree >= 0").select("tree", "at", "path")


def manifest(docs: DataFrame, tamper_modulus: int = 7) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every row of doc_id, source, lang, n_chars, text becomes a leaf digest; null and empty values differ. Leaves of
    a lang stand in the order of doc_id (null first, repeated ids by their digest) and make a subtree, subroots in
    the order of lang (null first, by bytes) the top tree. Each proof is checked against its leaf, which is
    recomputed with one more in n_chars where ``tamper_modulus`` divides the crc32 of the id (a null id counts as
    ''), so those do not verify unless n_chars is null. A long text only costs its own hash, an empty table gives
    no rows, other columns are not read. Past the leaves no text is moved: all steps work on 32-byte digests.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    fields = [F.col(c) for c in FIELDS]
    tampered = [(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS]
    chosen = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(tamper_modulus)) == 0
    leaves = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest(fields).alias("leaf"),
        F.when(chosen & F.col("n_chars").isNotNull(), leaf_digest(tampered)).alias("forged"))
    placed = scratch.keep(ranked(scratch.keep(leaves, "leaves"), [("doc_id", True), ("leaf", True)], "at", ["lang"]), "placed")
    widths = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("width"))
    trees = scratch.keep(ranked(widths, [("lang", True)], "tree").withColumnRenamed("lang", "own"), "trees")
    most, count = trees.agg(F.max("width"), F.count(F.lit(1))).first()
    most, count = most or 0, count or 0
    rows = scratch.keep(
        placed.join(scratch.small(trees), F.col("lang").eqNullSafe(F.col("own")))
        .select("doc_id", "leaf", "forged", (F.col("tree") - 1).alias("tree"), (F.col("at") - 1).alias("at"), "width"), "rows")
    inner = inner_nodes(scratch, rows.withColumnRenamed("leaf", "digest"), most)
    lone = rows.filter("width = 1").select("tree", F.col("leaf").alias("subroot"))
    subroots = scratch.keep(inner.filter("width = 1").select("tree", F.col("digest").alias("subroot")).unionByName(lone), "subroots")
    tops = subroots.select(F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(count).cast("bigint").alias("width"), F.col("subroot").alias("digest"))
    top = inner_nodes(scratch, tops, count)
    last = (top.filter("width = 1").select("digest") if count > 1 else subroots.select("subroot")).first()
    root = last[0].hex() if last else None
    paths = proof_paths(scratch, inner, top, height(most) + height(count))
    out = (
        rows.join(paths, ["tree", "at"], "left").join(scratch.small(subroots), "tree")
        .select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lit(root).alias("root"),
                F.coalesce("forged", "leaf").alias("start"), "path")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return out.mapInArrow(_folded, form).withColumn("verified", F.col("folded_root") == F.col("root"))

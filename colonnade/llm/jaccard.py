"""N-gram Jaccard join: shingle counts as points of a tree of boxes, bounded by summed minima, then verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.links import components
from colonnade.llm.storage import Scratch, member_mask, rough_counts, text_batches
from colonnade.llm.wordhash import run_hashes, word_hashes

# Bits of the slots that count documents per shingle, to try rare shingles first: 8 MB whatever the input. The order
# affects the cost only; the fuller the slots are, the more sets share one of their rarest shingles by chance.
ORDER_BITS = 23

# Shingles that two linked sets share among their rarest ones (fewer only if a set is smaller than that). Each
# makes the list of rarest shingles one longer and leaves out most pairs that have a shingle in common by chance.
LEAST_COMMON = 3

# Shingles per group of a count vector at most, and the least and most groups.
GROUP_SHINGLES, LEAST_GROUPS, MOST_GROUPS = 2, 8, 1 << 20

# A cell of up to so many nodes is joined with itself; a larger one is searched through a tree of boxes.
SMALL_CELL = 32

# Nodes of a large cell that are searched together (its parts meet pairwise), and points per leaf of their tree.
PART_NODES, LEAF_POINTS = 2048, 256

# Counts of a vector are 16-bit: a group of at most GROUP_SHINGLES expected shingles stays far below.
COUNT = "<u2"


def row_name(doc_id: Column, text: Column) -> Column:
    """A 64-bit name of a row by its id and text."""
    return F.xxhash64(doc_id, text)


def shingle_sets(texts: pa.Array, length: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a short text has its whole sequence as one."""
    hashes, bounds = run_hashes(*word_hashes(texts), length)
    for a, b in zip(bounds[:-1], bounds[1:]):
        part = hashes[a:b]
        part.sort()
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part


def least_shared(n: np.ndarray | int, percent: int):
    """Shingles that a set of size n shares at least with any set it links to."""
    return -(-percent * n // 100)


def least_common(n: Column, percent: int) -> Column:
    return F.least(F.lit(LEAST_COMMON), F.ceil(n * percent / 100))


def group_count(n: int) -> int:
    """Groups of the count vector of a set: a power of two that follows the size."""
    return int(min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, int(n // GROUP_SHINGLES).bit_length()))))


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int64)


def may_link(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, percent: int) -> bool:
    """False only if no two sets of at least these sizes under these count bounds can link.

    Sets share at most the sum over all groups of the smaller count.
    """
    groups = min(len(a), len(b))
    overlap = int(np.minimum(folded(a, groups), folded(b, groups)).sum())
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _points(docs: DataFrame, length: int, percent: int, rank: np.ndarray) -> DataFrame:
    """(row, doc_id, name, n, common, digest, counts, keys) per row: ``keys`` are the rarest shingles, of which any two
    linked sets share some, and ``common`` tells how frequent a set's shingles are on average."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(64 - ORDER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for _, part in text_batches(batch, "text"):
                n, common, digest, counts, keys = [], [], [], [], []
                for s in shingle_sets(part.column("text"), length):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    groups = group_count(len(s))
                    counts.append(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(COUNT).tobytes())
                    ranks, need = order[s >> shift], least_shared(len(s), percent)
                    common.append(int(ranks.mean() * 1e6) if len(s) else 0)
                    first = np.argsort(ranks, kind="stable")[: len(s) - need + min(LEAST_COMMON, need)]
                    keys.append(s[first].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("name"), pa.array(n, pa.int64()),
                     pa.array(common, pa.int64()), pa.array(digest, pa.binary()), pa.array(counts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["row", "doc_id", "name", "n", "common", "digest", "counts", "keys"],
                )

    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", row_name(F.col("doc_id"), F.col("text")).alias("name"), "text"
    ).mapInArrow(run, f"row long, doc_id {kind}, name long, n long, common long, digest binary, counts binary, keys array<long>")


def _shingle_ranks(docs: DataFrame, length: int) -> np.ndarray:
    """Per slot, a rough logarithm of the number of documents with a shingle in it."""

    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, part in text_batches(batch, "text"):
            found = [s >> np.uint64(64 - ORDER_BITS) for s in shingle_sets(part.column("text"), length)]
            yield np.concatenate(found).astype(np.int64)

    counts = rough_counts(docs.select("text"), 1 << ORDER_BITS, slots)
    return (np.log2(counts.astype(np.float32) + 1) * 15).astype(np.uint8)


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, rep) of the keys that two nodes at least have. Most keys have one node and meet no other, so only key and node
    travel, once: the counts and the rows are read from the same exchange."""
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select(F.explode("keys").alias("key"), "rep").repartition(tasks, "key")
    # Both ends of the nodes are asked for, so that the two sides of the join read the same columns.
    ends = dealt.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    # An inner join stays above the exchange, a semi join would be moved below it and deal the keys again.
    return dealt.join(ends.select("key"), "key")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, counts_a, n_b, counts_b) that the summed minima do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "counts_a", "n_b", "counts_b")))
            open_ = [may_link(i, np.frombuffer(a, COUNT), j, np.frombuffer(b, COUNT), percent) for i, a, j, b in rows]
            yield batch.filter(pa.array(open_, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "n_a", "counts_a", "n_b", "counts_b").mapInArrow(run, "a long, b long")


def _with_points(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left = nodes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("counts_a"))
    right = nodes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("counts_b"))
    return pairs.join(left, "a").join(right, "b")


def _verified(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets link. Only documents of some pair are taken apart again."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    named = scratch.keep(nodes.join(ends, "rep").select("rep", "name", "digest"), "named")
    mask = member_mask(named, "name")
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(known.has(np.asarray(batch.column("name")))))
            for _, part in text_batches(batch, "text"):
                found = [s.tobytes() for s in shingle_sets(part.column("text"), length)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("name"), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], ["name", "digest", "members"]
                )

    opened = scratch.keep(
        docs.select(row_name(F.col("doc_id"), F.col("text")).alias("name"), "text").mapInArrow(sets, "name long, digest binary, members binary")
        .join(named, ["name", "digest"]).groupBy("rep").agg(F.first("members").alias("members")),
        "sets",
    )

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    tested = pairs.join(opened.select(F.col("rep").alias("a"), F.col("members").alias("x")), "a").join(
        opened.select(F.col("rep").alias("b"), F.col("members").alias("y")), "b"
    )
    out = scratch.keep(tested.select("a", "b", "x", "y").mapInArrow(shares, "a long, b long"), "verified")
    scratch.drop(named, opened)
    return out


class Leaf:
    """Points of a cell with vectors of one length, and their box: least and most size, largest count per group."""

    def __init__(self, reps: np.ndarray, boxes: np.ndarray, sizes: np.ndarray, vectors: np.ndarray):
        self.reps, self.boxes, self.sizes, self.vectors = reps, boxes, sizes, vectors
        self.low, self.high, self.most = sizes.min(), sizes.max(), vectors.max(axis=0)
        self.only = boxes[0] if (boxes == boxes[0]).all() else None

    def folded(self, groups: int) -> np.ndarray:
        n = len(self.vectors)
        return self.vectors if self.vectors.shape[1] == groups else self.vectors.reshape(n, -1, groups).sum(axis=1, dtype=self.vectors.dtype)


def leaves_of(rows: list[tuple[int, int, int, bytes]]) -> list[Leaf]:
    """Leaves over (rep, box, n, counts), packed in the order of vector length, component and size."""
    rows = sorted(rows, key=lambda r: (len(r[3]), r[1], r[2]))
    out, at = [], 0
    while at < len(rows):
        stop = at
        while stop < len(rows) and stop - at < LEAF_POINTS and len(rows[stop][3]) == len(rows[at][3]):
            stop += 1
        part = rows[at:stop]
        vectors = np.frombuffer(b"".join(r[3] for r in part), COUNT).reshape(len(part), -1).astype(np.int32)
        out.append(Leaf(*(np.array([r[k] for r in part], np.int64) for k in range(3)), vectors))
        at = stop
    return out


def leaf_links(p: Leaf, q: Leaf, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between two leaves, of different components, that sizes and summed minima do not rule out."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if 100 * q.high < percent * p.low or 100 * p.high < percent * q.low or (p.only is not None and p.only == q.only):
        return none
    groups = min(p.vectors.shape[1], q.vectors.shape[1])
    most = int(np.minimum(folded(p.most, groups), folded(q.most, groups)).sum())
    if (100 + percent) * most < percent * (p.low + q.low):
        return none
    left, right = p.folded(groups), q.folded(groups)
    firsts, seconds = [], []
    for rep, box, size, vector in zip(p.reps, p.boxes, p.sizes, left):
        near = (q.boxes != box) & (100 * q.sizes >= percent * size) & (100 * size >= percent * q.sizes)
        at = np.flatnonzero(near)
        if len(at):
            overlap = np.minimum(vector, right[at]).sum(axis=1)
            at = at[(100 + percent) * overlap >= percent * (size + q.sizes[at])]
            firsts.append(np.full(len(at), rep))
            seconds.append(q.reps[at])
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else none


def _large_cells(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in large cells that the trees of their parts do not rule out.

    A cell is dealt into parts of about PART_NODES by a hash of the node; every two parts of a cell meet in one
    group of rows, so no task holds a whole cell.
    """
    parts = F.ceil(F.col("size") / PART_NODES).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    rows = placed.filter(F.col("size") > SMALL_CELL).join(nodes.select("rep", "counts"), "rep")
    rows = rows.select("key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("met"), "rep", "box", "n", "counts")
    rows = rows.select("key", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "rep", "box", "n", "counts")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(group, sides):
            firsts, seconds = [], []
            left = leaves_of(sides[0])
            pairs = [(left[x], left[y]) for x in range(len(left)) for y in range(x, len(left))]
            if group[1] != group[2]:
                right = leaves_of(sides[1])
                pairs = [(p, q) for p in left for q in right]
            for p, q in pairs:
                a, b = leaf_links(p, q, percent)
                firsts.append(a), seconds.append(b)
            a = np.concatenate([*firsts, np.zeros(0, np.int64)])
            b = np.concatenate([*seconds, np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        group, sides = None, ([], [])
        for batch in batches:
            for key, i, j, own_, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "own", "rep", "box", "n", "counts"))):
                if group != (key, i, j):
                    if group:
                        yield closed(group, sides)
                    group, sides = (key, i, j), ([], [])
                sides[own_ != i].append(tuple(row))
        if group:
            yield closed(group, sides)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, row_name, and
    first_name, the name of the one row that stands for the component: of its smallest doc_id, null only if all are.

    Two documents link if their sets of ``length``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more; every link counts, and a component takes its smallest doc_id.

    Equal sets become one node. Shingles are hashed into groups and a node's counts per group are its point.
    Nodes that share one of their rarest shingles meet in a cell. First every node is compared with two centres
    of its cells: the one with the most common shingles, which is the original of a family of edited copies, and
    another. This gathers families of any size with two tests per member. Then only nodes of different components
    are compared: those of a small cell by a join, where they must share as many rare shingles as linked sets do,
    and those of a large cell by a tree whose leaves hold points with a box (largest count per group, least size)
    around them. Leaves and then points are ruled out if the summed minima allow no link; what is left is verified
    on the sets. So a family is not expanded into its pairs, and no cell, family or candidate list is cut.

    Null or wordless texts have n_shingles 0 and are components of their own. Rows that repeat a doc_id are
    nodes by their text; a null doc_id takes part in links but names no component unless all are null.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    points = scratch.keep(_points(docs, length, percent, _shingle_ranks(docs, length)), "points")
    filled = points.filter("n > 0")
    classes = scratch.keep(filled.groupBy("n", "digest").agg(F.min("row").alias("rep")), "classes")
    first = filled.join(classes.select("rep"), F.col("row") == F.col("rep"))
    keyed = scratch.keep(first.select("rep", "name", "n", "common", "digest", "counts", "keys"), "nodes")
    # Vectors and keys are read from the nodes from here on; the rows need neither.
    rows = scratch.keep(points.select("doc_id", "name", "n", "digest"), "slim")
    scratch.drop(points)
    nodes = keyed.drop("keys", "common")
    shared_keys = scratch.keep(_shared_keys(keyed), "shared")
    keys = shared_keys.join(keyed.select("rep", "n", "common"), "rep")
    # A few fixed masks turn "smallest" into a different choice of centre for different shingles.
    masks = F.array(*[F.lit(m) for m in (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x5BD1E9955BD1E995)])
    mask = F.element_at(masks, (F.pmod(F.col("key"), F.lit(4)) + 1).cast("int"))
    centres = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.max_by("rep", "common").alias("first"), F.min(F.col("rep").bitwiseXOR(mask)).alias("code")
    )
    centres = centres.select("key", "size", "first", F.col("code").bitwiseXOR(mask).alias("second"))
    cells = scratch.keep(keys.drop("common").join(centres, "key"), "cells")
    scratch.drop(shared_keys)

    def most_shared(centre: str) -> DataFrame:
        pairs = cells.filter(F.col("rep") != F.col(centre)).groupBy("rep", centre).agg(F.count(F.lit(1)).alias("shared"))
        return pairs.groupBy(F.col("rep").alias("a")).agg(F.max_by(centre, "shared").alias("b"))

    star = most_shared("first").unionByName(most_shared("second"))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = scratch.keep(_bounded(_with_points(star, nodes), percent), "star")
    edges = _verified(scratch, docs, nodes, near, length, percent)
    labels = components(scratch, edges)
    # What the components so far leave open: pairs of different components that share rare shingles.
    placed = cells.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "size", "rep", "n", F.coalesce("root", "rep").alias("box")
    )
    mixed = placed.groupBy("key").agg(F.min("box").alias("least"), F.max("box").alias("most")).filter("least < most").select("key")
    placed = scratch.keep(placed.join(mixed, "key"), "placed")
    small = placed.filter(F.col("size") <= SMALL_CELL)
    meet = (
        small.alias("p").join(small.alias("q"), "key").filter("p.rep < q.rep and p.box <> q.box")
        .filter(f"100 * q.n >= {percent} * p.n and 100 * p.n >= {percent} * q.n")
        .groupBy(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("p.n", "q.n")).alias("low"))
        .filter(F.col("shared") >= least_common(F.col("low"), percent)).select("a", "b")
    )
    rest = _bounded(_with_points(meet, nodes), percent).unionByName(_large_cells(placed, nodes, percent))
    rest = scratch.keep(rest.distinct(), "rest")
    more = _verified(scratch, docs, nodes, rest, length, percent)
    # Links between components so far, by their roots.
    roots = labels.withColumnRenamed("node", "rep")
    lifted = (
        more.join(roots.select(F.col("rep").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("rep").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    upper = components(scratch, lifted).select(F.col("node").alias("box"), F.col("root").alias("top"))
    final = (
        classes.join(roots, "rep", "left").withColumn("box", F.coalesce("root", "rep")).drop("root")
        .join(upper, "box", "left").select("n", "digest", F.coalesce("top", "box").alias("component"))
    )
    placed_rows = scratch.keep(
        rows.filter("n > 0").join(final, ["n", "digest"]).select("doc_id", "name", "n", "component"), "rows"
    )
    names = placed_rows.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).getField("name").alias("first_name")
    )
    named = placed_rows.join(names, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("name").alias("row_name"), "first_name"
    )
    empty = rows.filter("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("name").alias("row_name"),
        F.col("name").alias("first_name"),
    )
    scratch.drop(keyed, cells, placed, near, edges, rest, more)
    return named.unionByName(empty)

"""Scratch tables in the shared folder, dense counters and size-checked broadcasts for the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.session import scratch_path

# A table is broadcast only if its files in the shared folder are at most this large.
BROADCAST_BYTES = 32 << 20

# Parquet looks at a page's size after 100 rows only: with rows of a megabyte, a task would hold, compress and read a
# table's whole part at once.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

# Rows of a dense counter that travel together.
COUNTER_BLOCK = 1 << 14


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class Scratch:
    """Named tables below ``spark.checkpoint.dir``: written once, read many times, deleted when spent.

    A written table is the only form in which an operator hands work from one job to the next, so a lost
    executor costs a re-read and never a stale copy.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
        path = self.path(name)
        df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def bytes_of(self, df: DataFrame) -> int:
        fs, target = _folder(self.spark, df._scratch)
        return fs.getContentSummary(target).getLength()

    def small(self, df: DataFrame) -> DataFrame:
        """``df``, to be broadcast if its files are small, else left to the join Spark picks."""
        return F.broadcast(df) if self.bytes_of(df) <= BROADCAST_BYTES else df

    def drop(self, *frames: DataFrame) -> None:
        """Delete spent tables."""
        for df in frames:
            fs, target = _folder(self.spark, df._scratch)
            fs.delete(target, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch with about ``limit`` bytes of text each (one row at least), and where they start."""
    sizes = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(sizes), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        base = ends[start] - lengths[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, batch.slice(start, stop - start)
        start = stop


def dense_counts(df: DataFrame, slots: int, count: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all batches of ``count(batch)``, an array of ``slots`` numbers.

    The array has the same size for any input. Each task adds up its own batches, blocks of the arrays are
    added by Spark, and only the one sum reaches the driver.
    """
    width = min(slots, COUNTER_BLOCK)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = count(batch)
            total = part.astype(np.int64) if total is None else total + part
        if total is not None:
            blocks = [(k, total[k * width : (k + 1) * width]) for k in range(-(-slots // width))]
            blocks = [(k, b) for k, b in blocks if b.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in blocks], pa.int32()), pa.array([b.tobytes() for _, b in blocks], pa.binary())],
                ["block", "counts"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([b.tobytes() for b in sums.values()], pa.binary())],
            ["block", "counts"],
        )

    form = "block int, counts binary"
    parts = df.mapInArrow(local, form).repartition("block").mapInArrow(added, form).collect()
    out = np.zeros(slots, np.int64)
    for row in parts:
        out[row.block * width : (row.block + 1) * width] += np.frombuffer(row.counts, np.int64)
    return out


def rough_counts(df: DataFrame, slots: int, found: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often ``found`` names each slot, as 16-bit numbers that stop at their largest.

    A task counts in 8 bits, so its array takes a byte per slot; sums over tasks stop at 65535. Meant for orders,
    where only the difference between rare and frequent matters.
    """
    width = min(slots, COUNTER_BLOCK)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint8)
        for batch in batches:
            for named in found(batch):
                at, n = np.unique(named, return_counts=True)
                total[at] = np.minimum(total[at].astype(np.int64) + n, 255)
        blocks = [k for k in range(-(-slots // width)) if total[k * width : (k + 1) * width].any()]
        for at in range(0, len(blocks), 64):
            yield _block_batch({k: total[k * width : (k + 1) * width] for k in blocks[at : at + 64]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.uint8).astype(np.uint32)
                sums[block] = np.minimum(sums[block] + part, 65535) if block in sums else part
        yield _block_batch({k: v.astype(np.uint16) for k, v in sums.items()})

    form = "block int, bits binary"
    parts = df.mapInArrow(local, form).repartition("block").mapInArrow(added, form).collect()
    out = np.zeros(slots, np.uint16)
    for row in parts:
        out[row.block * width : (row.block + 1) * width] = np.frombuffer(row.bits, np.uint16)
    return out


def held_out(doc_id) -> F.Column:
    """True for rows kept out of training: crc32 of the id as text leaves 2 modulo 4 (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def bounded_rows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """All rows if there are at most ``limit``, else about ``limit`` of them chosen by a hash of ``key``."""
    rows = df.count()
    if rows <= limit:
        return df
    share = int(limit / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)


class Mask:
    """A set of 64-bit names as bits: may hold a name it was not given, never lacks one it was given."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def has(self, names: np.ndarray) -> np.ndarray:
        slots = (names.astype(np.int64).view(np.uint64) >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def member_mask(names: DataFrame, column: str, most_bits: int = 27) -> Mask:
    """A mask of the hashed ``column``, of about 16 bits per row and at most 2 ** most_bits bits (16 MB).

    It spares work on rows that cannot matter; a full mask lets more rows through and changes no result.
    """
    rows = names.count()
    size = int(min(most_bits, max(10, (16 * max(rows, 1)).bit_length())))
    block_bits = min(size, 17)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = (np.asarray(batch.column(0)).astype(np.int64).view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)
            for block in np.unique(slots >> block_bits):
                own = slots[slots >> block_bits == block] & ((1 << block_bits) - 1)
                have = blocks.setdefault(int(block), np.zeros(1 << (block_bits - 3), np.uint8))
                np.bitwise_or.at(have, own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield _block_batch(blocks)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.uint8)
                blocks[block] = blocks[block] | part if block in blocks else part
        yield _block_batch(blocks)

    form = "block int, bits binary"
    parts = names.select(column).mapInArrow(local, form).repartition("block").mapInArrow(merged, form).collect()
    bits = np.zeros(1 << (size - 3), np.uint8)
    width = 1 << (block_bits - 3)
    for row in parts:
        bits[row.block * width : (row.block + 1) * width] |= np.frombuffer(row.bits, np.uint8)
    return Mask(bits, size)


def _block_batch(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"]
    )

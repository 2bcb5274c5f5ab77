"""Web archives with revisit records, and a capture index of two levels."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.storage import Scratch, _folder

# Payloads shorter than this are always written in full.
LEAST_SHARED = 1000

# Bytes of records that one archive file aims at, and captures per block of the index.
FILE_BYTES = 16 << 20
BLOCK_CAPTURES = 256

# A larger directory is not sent to every task; it is cut into leaves of so many rows.
DIRECTORY_BYTES = 32 << 20
LEAF_ROWS = 1024

# Two line ends close a record.
RECORD_END = "\r\n\r\n"

# A gzip member ends with the size of what it holds, whose last byte is 0 below 16 MB. Spark's text writer puts a
# separator after every value, so the values go without that byte and the separator supplies it.
MEMBER_END = "\x00"
GZIP_LEVEL = 5
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host parts reversed and joined by commas, then ``)`` and the path, all in lower case.

    Scheme, ``www.``, port and fragment do not count. A null URL has an empty key.
    """
    plain = F.lower(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(plain, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r":[0-9]+$", ""), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(plain == "", "").otherwise(key)


def _header_safe(text: Column) -> Column:
    """Line ends and other control characters would break a header; they are escaped by percent codes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F]", "")


def capture_types(scratch: Scratch, pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html, payload_bytes, sha1, refers_to): refers_to is null for records written in full.

    Of pages with equal payloads of ``least_shared`` bytes or more the largest page_id keeps the payload. Equal
    means equal in length, SHA-1 and SHA-256. Rows that tie on the largest id are all written in full, as are
    rows of a group in which every id is null.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"))
    rows = rows.withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "sha1": F.sha1("html"), "sha256": F.sha2("html", 256),
    })
    holders = (
        rows.filter(F.col("payload_bytes") >= least_shared)
        .groupBy(F.col("payload_bytes").alias("b"), F.col("sha1").alias("s"), F.col("sha256").alias("t"))
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    # A small table of holders spares the payloads a shuffle.
    kept = scratch.small(scratch.keep(holders, "holders"))
    same = (F.col("payload_bytes") == F.col("b")) & (F.col("sha1") == F.col("s")) & (F.col("sha256") == F.col("t"))
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    return rows.join(kept, same, "left").select(
        "page_id", "url", "html", "payload_bytes", "sha1", F.when(revisit, F.col("holder")).alias("refers_to")
    )


def record_text(page_id: Column, url: Column, html: Column, size: Column, sha1: Column, refers_to: Column) -> Column:
    """A whole record."""
    line = "\r\n"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), size.cast("string"), F.lit(line * 2)
    )
    revisit = refers_to.isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    ident = lambda page: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Date: {DATE}{line}WARC-Record-ID: "), ident(F.coalesce(page_id.cast("string"), F.lit("none"))),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), _header_safe(url)), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), sha1,
        F.when(
            revisit,
            F.concat(
                F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "),
                ident(refers_to),
            ),
        ).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(line * 2),
    )
    return F.concat(header, block, F.lit(RECORD_END))


def packed_record(record: bytes) -> bytes:
    """A record as a gzip member of its own, without the last byte. One of 16 MB or more is followed by an empty member."""
    out = gzip.compress(record, GZIP_LEVEL, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", GZIP_LEVEL, mtime=0)
    return out[:-1]


def pack_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [packed_record(r) for r in batch.column("value").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])


def index_key(url: Column) -> Column:
    """The URL key as the index has it: of the URL that the record's header shows, without separators of lines."""
    return F.regexp_replace(url_key(_header_safe(url)), r"[\t\n\r]", "")


def index_page(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit(""))


def write_archives(scratch: Scratch, pages: DataFrame, file_bytes: int = FILE_BYTES) -> str:
    """Write one record per page, sorted by URL key and id across and inside the files; the folder of the files.

    Every record is a gzip member, so that a range read opens it alone. Ranges of the key, the id as text and the
    digest deal the records out, so a host or a URL with a third of all pages fills as many files as it needs.
    """
    total = pages.agg(F.sum(F.octet_length("html") + 600).alias("b")).first().b or 0
    rows = capture_types(scratch, pages).select(
        index_key(F.col("url")).alias("key"), index_page(F.col("page_id")).alias("page"),
        record_text(*(F.col(c) for c in ("page_id", "url", "html", "payload_bytes", "sha1", "refers_to"))).alias("value"),
    )
    order = ["key", "page", F.xxhash64("value")]
    path = scratch.path("archives")
    (
        rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order).select("value")
        .mapInArrow(pack_records, "value binary").select(F.col("value").cast("string"))
        .write.option("lineSep", MEMBER_END).text(path)
    )
    return path


HEADER_LINE = re.compile(rb"([A-Za-z-]+): ?(.*)")


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of every gzip member that is not empty; an empty one belongs to the member before."""
    at, begin, held = 0, 0, b""
    while at < len(content):
        inflate, pieces, start = zlib.decompressobj(wbits=31), [], at
        while not inflate.eof:
            if at >= len(content):
                raise ValueError(f"record at {start} is cut off")
            pieces.append(inflate.decompress(content[at : at + step]))
            at += step
        at = min(at, len(content)) - len(inflate.unused_data)
        found = b"".join(pieces)
        if found:
            if held:
                yield begin, start - begin, held
            begin, held = start, found
    if held:
        yield begin, len(content) - begin, held


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of every record of an archive."""
    for at, size, record in members(content):
        end = record.index(b"\r\n\r\n")
        first, *lines = record[:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {m[1].decode().lower(): m[2].decode() for m in map(HEADER_LINE.match, lines) if m}
        stop = end + 4 + int(headers["content-length"])
        if record[stop:] != RECORD_END.encode():
            raise ValueError(f"record at {at} is not closed")
        yield at, size, headers, record[end + 4 : stop]


def parse_capture(headers: dict[str, str], block: bytes) -> tuple:
    """(page id, payload bytes, payload digest, type, refers to) with digest and size of the payload that is there.

    A revisit holds no payload; its size and digest are those it states.
    """
    page = lambda value: None if value in (None, "<urn:page:none>") else value[len("<urn:page:") : -1]
    raw = block
    cut = raw.index(b"\r\n\r\n") + 4
    kind = headers["warc-type"]
    stated = int(re.search(rb"Content-Length: ([0-9]+)", raw[:cut])[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        found = hashlib.sha1(raw[cut:]).hexdigest()
        if len(raw) - cut != stated or found != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    return page(headers["warc-record-id"]), stated, digest, kind, page(headers.get("warc-refers-to"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives: file, at, bytes, url, page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows = [
                    (file.as_py(), at, size, headers.get("warc-target-uri"), *parse_capture(headers, block))
                    for at, size, headers, block in records(content.as_py())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, _CAPTURE_TYPES)], _CAPTURE_NAMES
                )

    return read_files(spark, path).mapInArrow(run, _CAPTURE_FORM)


_CAPTURE_FORM = "file string, at long, bytes long, url string, page string, payload_bytes long, payload_digest string, record_type string, refers string"
_CAPTURE_NAMES = ["file", "at", "bytes", "url", "page", "payload_bytes", "payload_digest", "record_type", "refers"]
_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def pack_block(captures: list[tuple[str, str, int, int]]) -> bytes:
    """Sorted captures (key, page, offset, length) as compressed lines."""
    lines = (f"{key}\t{page}\t{at}\t{size}" for key, page, at, size in captures)
    return zlib.compress("\n".join(lines).encode(), 6)


def open_block(packed: bytes) -> list[tuple[str, str, int, int]]:
    rows = (line.split("\t") for line in zlib.decompress(packed).decode().split("\n"))
    return [(key, page, int(at), int(size)) for key, page, at, size in rows]


def build_index(scratch: Scratch, path: str, captures: int = BLOCK_CAPTURES) -> tuple[DataFrame, DataFrame]:
    """The two levels: blocks (block, file, packed) of sorted captures and their directory (first, first_page, last, last_page, block).

    Archives are sorted by key and page, so a file's captures are read in order and cut into blocks; a block belongs to
    one file. The directory has one row per ``captures`` captures. Only captures equal in key and page can lie in
    more than one block.
    """
    spark = scratch.spark
    found = read_captures(spark, path).select(
        "file", "at", "bytes", F.coalesce("page", F.lit("")).alias("page"), index_key(F.col("url")).alias("key")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int, int]] = []
        file = None

        def closed() -> pa.RecordBatch:
            ordered = sorted(held)
            ends = [*ordered[0][:2], *ordered[-1][:2]]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([e]) for e in ends), pa.array([file]), pa.array([pack_block(ordered)], pa.binary())],
                ["first", "first_page", "last", "last_page", "file", "packed"],
            )

        for batch in batches:
            for row_file, at, size, page, key in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row_file != file or len(held) >= captures):
                    yield closed()
                    held.clear()
                file = row_file
                held.append((key, page, at, size))
        if held:
            yield closed()

    blocks = scratch.keep(
        found.mapInArrow(cut, "first string, first_page string, last string, last_page string, file string, packed binary")
        .withColumn("block", F.monotonically_increasing_id()),
        "blocks",
    )
    directory = scratch.keep(blocks.select("first", "first_page", "last", "last_page", "block"), "directory")
    return blocks, directory


class Ranges:
    """Sorted (first, last, number), searched by halving for the ranges that may hold a place."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.firsts, self.lasts, self.numbers = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.reach = []  # the largest last place so far: where a search to the left may stop
        for last in self.lasts:
            self.reach.append(max(last, self.reach[-1]) if self.reach else last)

    def holding(self, place: tuple[str, str]) -> list[int]:
        span = range(bisect_left(self.reach, place), bisect_right(self.firsts, place))
        return [self.numbers[k] for k in span if self.lasts[k] >= place]


_ROUTED = "key string, page string, block long"


def _routed_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, types)], ["key", "page", "block"])


def route(scratch: Scratch, directory: DataFrame, wanted: DataFrame, most_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """(key, page, block) of the blocks that may hold what ``wanted`` (key, page) names.

    A directory too large to send to every task is sorted and cut into leaves, which have a directory of their own.
    """
    if scratch.bytes_of(directory) <= most_bytes or directory.count() <= LEAF_ROWS:
        ranges = Ranges([((r.first, r.first_page), (r.last, r.last_page), r.block) for r in directory.collect()])
        shared = scratch.spark.sparkContext.broadcast(ranges)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = zip(batch.column("key").to_pylist(), batch.column("page").to_pylist())
                yield _routed_batch([(*place, n) for place in places for n in shared.value.holding(place)])

        return wanted.select("key", "page").mapInArrow(search, _ROUTED)
    parts = max(1, scratch.bytes_of(directory) // max(1, most_bytes))
    order = ["first", "first_page", "last", "last_page", "block"]
    # Row numbers of a partition start at a multiple of 2 ** 33.
    leaves = scratch.keep(
        directory.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("leaf", F.floor(F.monotonically_increasing_id() / LEAF_ROWS)),
        "leaves",
    )
    ends = leaves.groupBy("leaf").agg(F.min(F.struct("first", "first_page")).alias("a"), F.max(F.struct("last", "last_page")).alias("b"))
    top = scratch.keep(ends.select("a.first", "a.first_page", "b.last", "b.last_page", F.col("leaf").alias("block")), "top")
    asked = route(scratch, top, wanted, most_bytes).select(
        F.col("block").alias("leaf"), F.lit(1).alias("kind"), F.col("key").alias("first"), F.col("page").alias("first_page"),
        F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("last_page"), F.lit(None).cast("long").alias("block"),
    )
    both = leaves.select("leaf", F.lit(0).alias("kind"), *order).unionByName(asked)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, ranges = None, [], None
        for batch in batches:
            out = []
            for at, kind, first, first_page, last, last_page, block in zip(*(c.to_pylist() for c in batch.columns)):
                if at != leaf:
                    leaf, held, ranges = at, [], None
                if not kind:
                    held.append(((first, first_page), (last, last_page), block))
                    continue
                ranges = ranges or Ranges(held)
                out.extend((first, first_page, n) for n in ranges.holding((first, first_page)))
            yield _routed_batch(out)

    return both.repartition("leaf").sortWithinPartitions("leaf", "kind").mapInArrow(inside, _ROUTED)


def locate(scratch: Scratch, blocks: DataFrame, directory: DataFrame, wanted: DataFrame, most_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """(key, page, file, at, bytes) of the captures that ``wanted`` (key, page) names, through both levels.

    The directory is searched by halving for the blocks that may hold a key and page; a block is opened once,
    and what is asked of it passes by, so no task holds more than a block.
    """
    asked = route(scratch, directory, wanted, most_bytes).distinct().select(
        "block", F.lit(1).alias("kind"), "key", "page", F.lit(None).cast("string").alias("file"), F.lit(None).cast("binary").alias("packed")
    )
    none = F.lit(None).cast("string")
    both = blocks.select("block", F.lit(0).alias("kind"), none.alias("key"), none.alias("page"), "file", "packed").unionByName(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = opened = captures = None
        for batch in batches:
            out = []
            for block, kind, key, page, file, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if not kind:
                    held, opened, captures = block, (file, packed), None
                    continue
                if block != held:
                    continue
                captures = captures or open_block(opened[1])
                at = bisect_left(captures, (key, page))
                while at < len(captures) and captures[at][:2] == (key, page):
                    out.append((key, page, opened[0], captures[at][2], captures[at][3]))
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, [pa.string()] * 3 + [pa.int64()] * 2)],
                ["key", "page", "file", "at", "bytes"],
            )

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        search, "key string, page string, file string, at long, bytes long"
    )


# Ranges of one file at most this far apart are read together, in pieces of about RUN_BYTES.
GAP_BYTES, RUN_BYTES = 1 << 14, 4 << 20


def open_archive(file: str):
    """The file as the task's own file system opens it (local or mounted paths, and what pyarrow knows by scheme)."""
    from pyarrow import fs

    if file.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", file))
    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def read_ranges(file: str, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(at, size, bytes) of ``ranges`` of one file, sorted by their place; neighbours share a read."""
    runs: list[list[tuple[int, int]]] = []
    for at, size in ranges:
        if runs and at <= sum(runs[-1][-1]) + GAP_BYTES and at + size - runs[-1][0][0] <= RUN_BYTES:
            runs[-1].append((at, size))
        else:
            runs.append([(at, size)])
    with open_archive(file) as source:
        for run in runs:
            start = run[0][0]
            raw = source.read_at(max(at + size for at, size in run) - start, start)
            for at, size in run:
                yield at, size, raw[at - start : at - start + size]


def fetch_captures(places: DataFrame) -> DataFrame:
    """One row per place (file, at, bytes): the capture a range read of the archive finds there.

    Places are dealt out by file and stretch of the file, so each task opens a file once and reads only what is asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, table = [], list(zip(*(batch.column(c).to_pylist() for c in ("file", "at", "bytes"))))
            for file, group in itertools.groupby(table, key=lambda r: r[0]):
                for at, size, raw in read_ranges(file, [(at, size) for _, at, size in group]):
                    _, _, headers, block = next(records(raw))
                    rows.append((file, at, size, headers.get("warc-target-uri"), *parse_capture(headers, block)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, _CAPTURE_TYPES)], _CAPTURE_NAMES)

    dealt = places.select("file", "at", "bytes").repartition("file", F.shiftright("at", 22)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, _CAPTURE_FORM)


def archive_round_trip(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, index them, and read every capture back through the index.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, and where the record lies:
    file, at, bytes. A null html is an empty payload; a null url has no target header and an empty key; a null
    page_id comes back null. Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    kind = pages.schema["page_id"].dataType
    path = write_archives(scratch, pages, file_bytes)
    blocks, directory = build_index(scratch, path)
    wanted = pages.select(index_key(F.col("url")).alias("key"), index_page(F.col("page_id")).alias("page")).distinct()
    return fetch_captures(locate(scratch, blocks, directory, wanted)).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast(kind).alias("refers_to"), F.element_at(F.split("file", "/"), -1).alias("file"), "at", "bytes",
    )

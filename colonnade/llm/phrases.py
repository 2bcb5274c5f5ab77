"""Phrase collocations: tries of Apriori-safe candidates walked over all text positions at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.storage import Scratch, dense_counts, text_batches
from colonnade.llm.trie import build
from colonnade.operators.ordering import ranked

LEAST, LONGEST, TOP = 100, 5, 2000

# Bytes of text that become one coded row.
SLICE = 1 << 20

# Words of one broadcast dictionary (bytes) and candidates of one trie: memory bounds, the result does not depend on them.
LEXICON_BYTES, TRIE_ROWS, PROPOSALS = 16 << 20, 1 << 19, 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, A-Z in lower case, and whether each opens a piece (and so follows no other word).

    All separators are ASCII, so UTF-8 bytes are enough. A null text is empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or ends[-1] == ends[0]:
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    raw = _LOWER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    edge = ends[1:-1] - ends[0]
    edge = edge[(edge > 0) & (edge < len(raw))]
    kind = _KIND[raw]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    cut = kind == 2
    cut[edge] = True  # a word never follows one of another text
    pieces = np.cumsum(cut)[starts] if len(starts) else np.zeros(0, np.int64)
    opens = np.ones(len(starts), bool)
    opens[1:] = pieces[1:] != pieces[:-1]
    where = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(raw[inside])))
    return words, opens


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, words, codes): codes are numbers from 1 into ``words``, 0 parts the pieces."""
    for batch in batches:
        for _, part in text_batches(batch, "text", SLICE):
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = part.column("text").filter(pc.equal(langs, lang))
                words, opens = split_words(texts)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                codes = np.zeros(len(words) + int(opens.sum()), np.int32)
                codes[np.arange(len(words)) + np.cumsum(opens)] = np.asarray(coded.indices).astype(np.int32) + 1
                names = coded.dictionary.cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                     pa.array([codes.tobytes()], pa.binary())], ["lang", "words", "codes"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, words, raw in zip(batch.column(0), batch.column(1), batch.column(2)):
            counts = np.bincount(np.frombuffer(raw.as_buffer(), np.int32), minlength=len(words.values) + 1)[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py()] * len(counts), pa.string()), words.values, pa.array(counts)], ["lang", "word", "n"])


def _resolved(known, last: bool):
    """Fill in the numbers of the words that the broadcast part of the dictionary knows.

    After the last part, codes become numbers (0 for words that are not frequent) and runs of 0 shrink to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                own = numbers.get(one.column("lang")[0].as_py(), {})
                words = one.column("words")[0].values
                got = np.fromiter((own.get(w, 0) for w in words.to_pylist()), np.int32, len(words))
                have = one.column("ids")[0].as_buffer()
                have = np.frombuffer(have, np.int32).copy() if have is not None else np.zeros(len(words) + 1, np.int32)
                have[1:] = np.where(got > 0, got, have[1:])
                if not last:
                    yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([have.tobytes()], pa.binary())], one.schema.names)
                    continue
                line = have[np.frombuffer(one.column("codes")[0].as_buffer(), np.int32)]
                keep = line > 0
                keep[1:] |= line[:-1] > 0
                line = line[keep].tobytes()
                if line:
                    yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())] * 2, ["ids", "ranks"])

    return run


def _number_words(scratch: Scratch, coded: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lines of word numbers (ids) for every coded row; ranks start as the numbers of one-word phrases."""
    spark = coded.sparkSession
    size = lexicon.agg(F.sum(F.octet_length("word") + 16).alias("bytes")).first()
    parts = max(1, -(-(size.bytes or 0) // LEXICON_BYTES))
    rows = coded.withColumn("ids", F.lit(None).cast("binary"))
    for part in range(parts):
        known: dict[str, dict[str, int]] = {}
        for r in lexicon.filter(F.pmod("id", F.lit(parts)) == part).toLocalIterator():
            known.setdefault(r.lang, {})[r.word] = r.id
        held, last = spark.sparkContext.broadcast(known), part + 1 == parts
        rows = scratch.keep(rows.mapInArrow(_resolved(held, last), "ids binary, ranks binary" if last else rows.schema), "lines", large_rows=True)
    return rows


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, ranks in zip(batch.column("ids"), batch.column("ranks")):
        ids, ranks = np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(ranks.as_buffer(), np.uint8)
        yield ids, ranks.view(np.int32 if len(ranks) == 4 * len(ids) else np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 64 bits byte plane by byte plane, compressed: planes of small numbers are mostly zeros."""
    return zlib.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their counts."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


_KEY = 31  # bits of a word's number in a key


def _proposed(length: int, parts: int):
    """Phrases of ``length`` words whose first and last ``length`` - 1 words are frequent, counted piece by piece of a task.

    A key is the rank of the beginning and the last word; sorted keys travel as their differences, by parts of the ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            part = (key >> _KEY) % parts
            order = np.argsort(part, kind="stable")
            key, count = key[order], count[order]
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(k, _packed(np.diff(key[a:b], prepend=0)), _packed(count[a:b])) for k, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["part", "keys", "counts"])

        for batch in batches:
            for ids, ranks in _lines(batch):
                m = len(ids) - length + 1
                if m <= 0:
                    continue
                at = np.flatnonzero((ranks[:m] > 0) & (ranks[1 : m + 1] > 0) & (ids[length - 1 :] > 0))
                held.append((ranks[at].astype(np.int64) << _KEY) | ids[at + length - 1])
                size += len(at)
                if size >= PROPOSALS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _possible(least: int):
    """Keys of a part whose counts add up to ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, size = None, [], [], 0

        def out() -> pa.RecordBatch:
            key, count = _added(keys, counts)
            key = key[count >= least]
            return pa.RecordBatch.from_arrays([pa.array(key >> _KEY), pa.array((key & ((1 << _KEY) - 1)).astype(np.int32))], ["head", "tail"])

        for batch in batches:
            for name, raw_keys, raw_counts in zip(*(c.to_pylist() for c in batch.columns)):
                if name != part:
                    if keys:
                        yield out()
                    part, keys, counts, size = name, [], [], 0
                keys.append(np.cumsum(_unpacked(raw_keys)))
                counts.append(_unpacked(raw_counts))
                size += len(keys[-1])
                if size >= 2 * PROPOSALS:
                    key, count = _added(keys, counts)
                    keys, counts, size = [key], [count], 0
        if keys:
            yield out()

    return run


def _counted(trie, rows: int):
    """How often each sequence of the trie occurs in a batch: walks from all positions, ends counted by bincount."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        held, total = trie.value, np.zeros(rows, np.int64)
        for ids, _ in _lines(batch):
            found = held.find(ids)
            total += np.bincount(found[found >= 0], minlength=rows)
        return total

    return count


def _marked(trie, ranks_of, fresh: bool):
    """Ranks of the frequent phrases that start at each position; unless ``fresh``, those of earlier tries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ranks in _lines(batch):
                found = trie.value.find(ids)
                ranks = np.where(found >= 0, ranks_of.value[found], 0 if fresh else ranks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([ranks.astype(np.int64).tobytes()], pa.binary())], ["ids", "ranks"])

    return run


def _shards(table: DataFrame, rank: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, ranks) of at most TRIE_ROWS phrases at a time, sorted by their words."""
    last = table.agg(F.max(rank)).first()[0] or 0
    for low in range(0, last, TRIE_ROWS):
        part = table.filter((F.col(rank) > low) & (F.col(rank) <= low + TRIE_ROWS)).select("words", rank).toArrow()
        words = part.column(0).combine_chunks()
        rows = np.asarray(words.flatten()).reshape(len(words), -1)
        order = np.lexsort(rows.T[::-1])
        yield rows[order], np.asarray(part.column(1))[order].astype(np.int64)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, sizes, lexicon): phrases (lang, words, f) of 1 to ``longest`` words that occur ``least`` times or more,
    sizes (lang, n) with all word occurrences, lexicon (id, lang, word, f).

    Texts are split once and written as word numbers. For every length, phrases whose beginning and end are
    frequent are proposed from the lines, and of these, by sums over all tasks, only those that can be frequent; their double-array trie is broadcast and walked over all lines, and the
    counts of all tasks and tries are added up. Dictionaries and tries are cut into parts of bounded size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    coded = scratch.keep(source.mapInArrow(_coded, "lang string, words array<string>, codes binary"), "coded", large_rows=True)
    counts = scratch.keep(
        coded.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    lexicon = scratch.keep(ranked(counts.filter(F.col("f") >= least), [("lang", True), ("word", True)], "id"), "lexicon")
    lines = _number_words(scratch, coded, lexicon)
    scratch.drop(coded)
    # About one part per million words, so that no task of the proposals holds many more keys.
    words = counts.agg(F.sum("f")).first()[0] or 0
    parts = max(8, -(-words // (1 << 20)))
    level = scratch.keep(lexicon.select("lang", F.array(F.col("id").cast("int")).alias("words"), "f", F.col("id").alias("rank")), "phrases1")
    levels = [level]
    for length in range(2, longest + 1):
        form = "part int, keys binary, counts binary"
        proposed = (
            lines.mapInArrow(_proposed(length, parts), form).repartition("part").sortWithinPartitions("part")
            .mapInArrow(_possible(least), "head bigint, tail int")
        )
        grown = scratch.keep(
            proposed.join(level.select("lang", "words", F.col("rank").alias("head")), "head")
            .select("lang", F.concat("words", F.array("tail")).alias("words")), "proposed")
        candidates = scratch.keep(ranked(grown, [("words", True)], "rank"), "candidates")
        found = []
        for rows, ranks in _shards(candidates, "rank"):
            held = spark.sparkContext.broadcast(build(rows))
            total = dense_counts(lines, len(rows), _counted(held, len(rows)))
            often = total >= least
            found.append(scratch.keep(spark.createDataFrame(pa.table({"rank": ranks[often], "f": total[often]})), "found"))
        if not found:
            break
        total = found[0]
        for more in found[1:]:
            total = total.unionByName(more)
        level = scratch.keep(candidates.join(total, "rank").select("lang", "words", "f", "rank"), f"phrases{length}")
        levels.append(level)
        if length < longest:
            fresh = True
            for rows, ranks in _shards(level, "rank"):
                mark = _marked(spark.sparkContext.broadcast(build(rows)), spark.sparkContext.broadcast(ranks), fresh)
                old, lines, fresh = lines, scratch.keep(lines.mapInArrow(mark, "ids binary, ranks binary"), f"lines{length}", large_rows=True), False
                scratch.drop(old)
            if fresh:
                break
    phrases = levels[0].drop("rank")
    for more in levels[1:]:
        phrases = phrases.unionByName(more.drop("rank"))
    return phrases, sizes, lexicon


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score of each cut in whole numbers of any size."""
    for batch in batches:
        a, n, left, right = (batch.column(c).to_pylist() for c in ("a", "n", "l", "r"))
        score = pa.array([1000 * w * x // (y * z) for w, x, y, z in zip(a, n, left, right)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's best collocations: lang, rank, phrase, a, l, r, n, score.

    Reads lang and text. Words are counted per lang (null: 'und') within pieces; a candidate has 2 to ``longest``
    words and ``least`` occurrences. Its score is that of its weakest cut (the first of equals); one that lies in a
    longer candidate as frequent as itself is dropped, for which the candidates one word longer suffice, since
    frequency never grows with length. Ties in score and frequency are ordered by the phrase's bytes. Null and
    empty texts have no words, repeated rows count again, a very long text is coded like any other, an empty
    table gives no rows; other columns are not read.
    """
    phrases, sizes, lexicon = frequent_phrases(docs, least, longest)
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    longer = phrases.filter(F.size("words") >= 2)
    known = phrases.select("words", "f")
    inner = longer.filter(F.size("words") > 2).select(
        "f", F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words")
    ).groupBy("words").agg(F.max("f").alias("around"))
    kept = longer.join(inner, "words", "left").filter(F.col("around").isNull() | (100 * F.col("around") < 100 * F.col("f")))
    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({
        "head": F.slice("words", F.lit(1), F.col("k")), "tail": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cuts = (
        cuts.join(known.select(F.col("words").alias("head"), F.col("f").alias("l")), "head")
        .join(known.select(F.col("words").alias("tail"), F.col("f").alias("r")), "tail").drop("head", "tail")
        .join(F.broadcast(scratch.keep(sizes, "sizes")) if sizes.count() < 10_000 else sizes, "lang")
    )
    form = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cuts.schema)}, score bigint"
    weakest = scratch.keep(
        cuts.mapInArrow(_scored, form).groupBy("words").agg(F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("cut"))
        .select("words", "cut.*"), "weakest")
    spelled = (
        weakest.select("words", F.posexplode("words").alias("at", "id")).join(lexicon.select("id", "word"), "id")
        .groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
        .select("words", F.concat_ws(" ", F.transform("spelled", lambda s: s["word"])).alias("phrase"))
    )
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # The first of every part, then the first of these: no task sorts all candidates of a language.
    part = Window.partitionBy("lang", "part").orderBy(*best)
    whole = Window.partitionBy("lang").orderBy(*best)
    return (
        weakest.join(spelled, "words").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        .withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(whole).cast("bigint")).filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )

"""BPE with word ends: a memory-mapped transducer knows frequent words, all others are merged exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.storage import text_batches

# Words of the lexicon and merged words a task remembers: bounds on memory only, the result does not depend on them.
LEXICON_WORDS, CACHE = 100_000, 200_000

# The longest word of the lexicon in bytes.
LONGEST = 48

SLICE = 1 << 20

# Bytes of a word up to which merging goes without a heap, and the rank of a pair that never merges.
SHORT, NEVER = 40, (1 << 60, -1)

# What follows an apostrophe to make a piece of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# Characters below this one, less the exception, keep their form under NFC and lower-case one by one.
PLAIN = 0x180
_ODD = 0x130


def byte_letters() -> list[str]:
    """The printable letter of every byte: itself where printable in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per plain character its kind (0 space, 1 letter, 2 digit, 3 other) and its lower case."""
    import regex

    kind = np.full(PLAIN, 3, np.uint8)
    low = np.arange(PLAIN, dtype=np.uint32)
    for point in range(PLAIN):
        c = chr(point)
        kind[point] = 0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3
        if len(c.lower()) == 1:
            low[point] = ord(c.lower())
    return kind, low


class Merges:
    """The vocabulary and merge ranks of a tokenizer file, and exact merging of one word."""

    def __init__(self, raw: str):
        model = json.loads(raw)["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.last = [self.ids[x + self.suffix] for x in letters]

    def encode(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left; linked symbols and a heap."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        n = len(symbols)
        if n <= SHORT:  # looking at every pair again is quicker than a heap
            look = self.rank.get
            ranks = [look(p, NEVER) for p in zip(symbols, symbols[1:])]
            while ranks:
                best = min(ranks)
                if best is NEVER:
                    break
                i = ranks.index(best)
                symbols[i : i + 2] = [best[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = look((symbols[i - 1], symbols[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = look((symbols[i], symbols[i + 1]), NEVER)
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else -1
            if j < 0 or self.rank.get((symbols[i], symbols[j])) != (rank, made):
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    pair = self.rank.get((symbols[k], symbols[after[k]]))
                    if pair:
                        heapq.heappush(heap, (pair[0], k, pair[1]))
        return [s for s in symbols if s >= 0]


def compile_lexicon(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of ``words`` (sorted, all different) as sorted transition arrays.

    States with equal ends are one. Each transition carries how many words precede those behind it, so the sum along
    a word is its rank in sorted order, which names its output. ``key`` is state * 256 + byte.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    moves: list[tuple] = []

    def settled(node: list) -> int:
        """Number of the state equal to ``node`` [final, edges], whose targets are settled."""
        shape = (node[0], tuple(node[1].items()))
        if shape not in register:
            register[shape] = len(finals)
            finals.append(node[0])
            moves.append(shape[1])
        return register[shape]

    path, last = [[False, {}]], b""
    for word in words:
        common = len(os.path.commonprefix([word, last]))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = settled(node)
        for byte in word[common:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = settled(node)
    root = settled(path[0])
    reach = np.zeros(len(finals), np.int64)
    keys, targets, outputs = [], [], []
    for state, edges in enumerate(moves):  # targets have smaller numbers
        total = int(finals[state])
        for byte, target in edges:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(total)
            total += reach[target]
        reach[state] = total
    order = np.argsort(np.asarray(keys, np.int64), kind="stable")
    return {
        "key": np.asarray(keys, np.int64)[order], "target": np.asarray(targets, np.int32)[order],
        "output": np.asarray(outputs, np.int64)[order], "final": np.asarray(finals, bool), "root": np.asarray([root], np.int64),
    }


class Lexicon:
    """Looks many words up at once in an automaton that lies in memory-mapped files."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def mapped(cls, path: str) -> "Lexicon":
        """Arrays of one file: a JSON line with name, kind, offset and length of each, then their bytes."""
        with open(path, "rb") as f:
            head = json.loads(f.readline())
            start = f.tell()
        return cls({name: np.memmap(path, kind, "r", start + at, (n,)) if n else np.zeros(0, kind) for name, kind, at, n in head})

    @staticmethod
    def write(arrays: dict[str, np.ndarray], path: str) -> None:
        head, at = [], 0
        for name, values in arrays.items():
            head.append((name, values.dtype.str, at, len(values)))
            at += values.nbytes
        with open(path, "wb") as f:
            line = json.dumps(head).encode()
            f.write(line + b" " * (-(len(line) + 1) % 8) + b"\n")
            for values in arrays.values():
                f.write(values.tobytes())

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Rank of every word in the lexicon, -1 for others; all words advance together, byte by byte."""
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = np.full(len(words), -1, np.int64)
        length = np.diff(ends)
        at = np.flatnonzero((length > 0) & (length <= LONGEST))
        state = np.full(len(at), self.a["root"][0], np.int64)
        total = np.zeros(len(at), np.int64)
        keys = self.a["key"]
        if not len(keys):
            return out
        step = 0
        while len(at):
            done = length[at] == step
            if done.any():
                hit = done & self.a["final"][state]
                out[at[hit]] = total[hit]
                at, state, total = at[~done], state[~done], total[~done]
            key = state * 256 + raw[ends[at] + step]
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[slot] == key
            slot, at = slot[known], at[known]
            state, total = self.a["target"][slot].astype(np.int64), total[known] + self.a["output"][slot]
            step += 1
        return out


class WordBpe:
    """Encoder and decoder of one task."""

    def __init__(self, raw: str, lexicon: Lexicon | None, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        self.merges, self.lexicon, self.limit = Merges(raw), lexicon, cache
        self.whole = Tokenizer.from_str(raw)
        self.specials = {t["content"]: t["id"] for t in json.loads(raw)["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.names = {i: t for t, i in [*self.merges.ids.items(), *self.specials.items()]}
        self.kind, self.low = _classes()
        self.space = regex.compile(r"\s+")
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.byte_of = {letter: b for b, letter in enumerate(byte_letters())}

    def _shown(self, ids: Sequence[int]) -> tuple[bytes, str]:
        """Ids as bytes, and a space with the token's name for each."""
        return np.asarray(ids, "<u4").tobytes(), "".join(" " + self.names[i] for i in ids)

    def _outputs(self, words: pa.Array) -> tuple[list[bytes], list[str]]:
        """Ids and names of different words: from the transducer's outputs, else from merging."""
        ranks = self.lexicon.ranks(words) if self.lexicon else np.full(len(words), -1, np.int64)
        ids: list = [b""] * len(words)
        names: list = [""] * len(words)
        hit = np.flatnonzero(ranks >= 0)
        if len(hit):
            first, flat = self.lexicon.a["first"], self.lexicon.a["ids"]
            for k, low, high in zip(hit.tolist(), first[ranks[hit]].tolist(), first[ranks[hit] + 1].tolist()):
                own = flat[low:high]
                ids[k] = own.tobytes()
                names[k] = "".join([" " + self.names[i] for i in own.tolist()])
        miss = np.flatnonzero(ranks < 0)
        if len(self.known) + len(miss) > self.limit:
            self.known = {}
        for k, word in zip(miss.tolist(), words.take(pa.array(miss)).cast(pa.large_binary()).to_pylist()):
            got = self.known.get(word)
            if got is None:
                got = self._shown(self.merges.encode(word))
                if len(word) <= 1000:
                    self.known[word] = got
            ids[k], names[k] = got
        return ids, names

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Lower-case pieces of texts of plain characters, and how many each text has."""
        kind_of, low = self.kind, self.low
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        kind = kind_of[points]
        points = low[points]
        n = len(points)
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # An apostrophe alone between a non-"other" and a letter takes an ending with it, which ends a piece there.
        quote = np.flatnonzero((points == 39) & start)
        quote = quote[quote + 1 < n]
        quote = quote[kind[quote + 1] == 1]
        if len(quote):
            padded = np.concatenate([points, np.zeros(2, np.uint32)])
            second, third = padded[quote + 1], padded[quote + 2]
            size = np.zeros(len(quote), np.int64)
            for ending in ENDINGS:
                fits = second == ord(ending[0])
                if len(ending) == 2:
                    fits &= third == ord(ending[1])
                size[fits & (size == 0)] = len(ending)
            taken, size = quote[size > 0], size[size > 0]
            start[taken + 1] = False
            behind = taken + 1 + size
            behind_in = behind < n
            # What follows the ending begins a piece, also within the same word.
            two = taken[size == 2] + 2
            start[two] = False
            start[behind[behind_in]] = True
        inside = kind != 0
        begins = np.flatnonzero(start & inside)
        chars = points[inside]
        encoded = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
        width = 1 + (chars >= 0x80).astype(np.int64)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        order = np.cumsum(inside) - 1
        where = np.append(byte_at[order[begins]], len(encoded)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(where), pa.py_buffer(encoded))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return pieces, np.diff(np.concatenate([[0], np.searchsorted(begins, ends)]))

    def _other_pieces(self, text: str) -> list[str]:
        """Pieces of any text without special tokens, split and normalised by the library, as UTF-8 strings or bytes."""
        normal = self.whole.normalizer.normalize_str(text)
        return [bytes(self.byte_of[c] for c in piece) for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Per text its ids as little-endian 32-bit numbers and the decoded text."""
        plain = np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            plain[k] = t.isascii() or (max(t) < chr(PLAIN) and chr(_ODD) not in t)
            if plain[k] and "<|" in t and self.special.search(t):
                plain[k] = False
        out_ids: list = [b""] * len(texts)
        out_text: list = [""] * len(texts)
        at = np.flatnonzero(plain)
        if len(at):
            pieces, counts = self._pieces([texts[k] for k in at])
            coded = pieces.dictionary_encode()
            ids, names = self._outputs(coded.dictionary)
            index = coded.indices
            flat_ids = pa.array(ids, pa.large_binary()).take(index)
            flat_names = pa.array(names, pa.large_string()).take(index)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for flat, out in ((flat_ids, out_ids), (flat_names, out_text)):
                _, offsets, data = flat.buffers()
                edge = np.frombuffer(offsets, np.int64)[flat.offset + bounds]
                body = memoryview(data) if data is not None else memoryview(b"")
                for k, low, high in zip(at.tolist(), edge.tolist(), edge[1:].tolist()):
                    out[k] = bytes(body[low:high])
            for k in at.tolist():
                out_text[k] = out_text[k][1:]
        for k in np.flatnonzero(~plain).tolist():
            pieces, marks, start = [], {}, 0
            text = texts[k]
            for found in self.special.finditer(text):
                pieces += self._other_pieces(text[start : found.start()])
                marks[len(pieces)] = self.specials[found.group()]
                pieces.append(b"")
                start = found.end()
            pieces += self._other_pieces(text[start:])
            words = pa.array(pieces, pa.large_binary())
            coded = words.dictionary_encode()
            ids, names = self._outputs_of_bytes(coded.dictionary)
            order = np.asarray(coded.indices).tolist()
            parts = [self._shown([marks[j]]) if j in marks else (ids[c], names[c]) for j, c in enumerate(order)]
            out_ids[k] = b"".join(p[0] for p in parts)
            out_text[k] = "".join(p[1] for p in parts)[1:].encode()
        return out_ids, out_text

    def _outputs_of_bytes(self, words: pa.Array) -> tuple[list[bytes], list[str]]:
        full = np.flatnonzero(np.asarray(pc.binary_length(words)) > 0)
        ids: list = [b""] * len(words)
        names: list = [""] * len(words)
        for k, a, b in zip(full.tolist(), *self._outputs(words.take(pa.array(full)))):
            ids[k], names[k] = a, b
        return ids, names


def _rough_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of letters (ASCII letters and every byte of other characters) in lower case, counted per slice."""
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    for batch in batches:
        for _, part in text_batches(batch, "text", 4 * SLICE):
            raw = np.frombuffer(pc.utf8_lower(pc.binary_join(pa.array([pc.fill_null(part.column("text"), "").to_pylist()]), " "))[0].as_py().encode(), np.uint8)
            inside = letter[raw]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            where = np.append((np.cumsum(inside) - 1)[starts], int(inside.sum())).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
            counts = words.filter(pc.less_equal(pc.binary_length(words), LONGEST)).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.binary()), counts.field(1)], ["word", "n"])


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """The ``most`` most frequent words of all texts (ties by bytes), for the lexicon; at most LONGEST bytes each."""
    counts = docs.select("text").mapInArrow(_rough_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counts.filter("n > 1").orderBy(F.col("n").desc(), "word").limit(most).collect()]


def ship_lexicon(spark: SparkSession, raw: str, words: Sequence[bytes]) -> str:
    """Compile words that are pieces of their own with their ids, and have Spark's file server deliver the file."""
    coder = WordBpe(raw, None)
    valid = set()
    for word in words:
        try:
            text = word.decode()
        except UnicodeDecodeError:
            continue
        if all(ord(c) < PLAIN and ord(c) != _ODD for c in text) and coder._pieces([text])[0].to_pylist() == [text]:
            valid.add(word)
    ordered = sorted(valid)
    ids = [coder.merges.encode(w) for w in ordered]
    arrays = compile_lexicon(ordered)
    arrays["first"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    arrays["ids"] = np.asarray([x for i in ids for x in i], "<u4")
    mark = hashlib.sha256(b"".join(a.tobytes() for a in arrays.values())).hexdigest()[:20]
    name = f"lexicon-{mark}.bin"
    context = spark.sparkContext
    shipped = context.__dict__.setdefault("_colonnade_files", set())
    if name in shipped:
        return name
    path = os.path.join(tempfile.mkdtemp(prefix="colonnade-lexicon-"), name)
    Lexicon.write(arrays, path)
    context.addFile(path)
    shipped.add(name)
    return name


_CODERS: dict[str, WordBpe] = {}


def encode_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids on request.

    Texts are normalised, split and merged as the tokenizer file ``path`` says, without adding special tokens; the
    names of special tokens in a text become their ids. Texts of Latin characters are split as arrays, others by
    the library's own normaliser and splitter. Words of the lexicon get their ids from the transducer, all others
    by merging, so the lexicon (at most ``most`` words, from a count over all texts) only spares time. A null text
    is empty: no ids, an empty decoded text. Rows are independent: a null or repeated doc_id stays as it is, a very
    long text is one slice, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    name = ship_lexicon(spark, raw, frequent_words(docs, most))
    held = spark.sparkContext.broadcast(raw)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CODERS:
            _CODERS.clear()
            _CODERS[name] = WordBpe(held.value, Lexicon.mapped(SparkFiles.get(name)))
        coder = _CODERS[name]
        for batch in batches:
            for _, part in text_batches(batch, "text", SLICE):
                ids, shown = coder.encode([t or "" for t in part.column("text").to_pylist()])
                columns = [
                    part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in shown], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    form = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, form)

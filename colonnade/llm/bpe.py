"""Byte-level BPE through a sentencepiece model that is serialised from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pre-tokens whose ids a task remembers; a memory bound only, the result does not depend on it.
CACHE = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, space, rank per line), local to the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_letters() -> str:
    """One printable letter per byte value, none of which sentencepiece treats specially."""
    return "".join(chr(0x0100 + value) for value in range(256))


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i is the token of rank i as byte letters, with score -i.

    Field numbers are those of sentencepiece's published message format. The normaliser is the identity and
    adds nothing; the one piece beyond the ranks stands for unknown symbols and is never produced.
    """
    letters = byte_letters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without a gap")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank))
    trainer += _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = ranks
        self.bytes_of = sorted(ranks, key=ranks.__getitem__)
        self.letters = dict(enumerate(byte_letters()))
        self.limit = cache
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pre-tokens as little-endian 32-bit numbers; a pre-token that is itself a token has one id."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.known = {}
            fresh = list(pieces)
        raw = [p.encode() for p in fresh]
        rest = [k for k, r in enumerate(raw) if r not in self.whole]
        coded = self.processor.encode([raw[k].decode("latin-1").translate(self.letters) for k in rest], num_threads=1)
        for k, ids in zip(rest, coded):
            self.known[fresh[k]] = np.asarray(ids, "<u4").tobytes()
        for piece, r in zip(fresh, raw):
            if r in self.whole:
                self.known[piece] = struct.pack("<I", self.whole[r])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        parts = [self.split(t) for t in texts]
        self._learn({p for pieces in parts for p in pieces})
        look = self.known.__getitem__
        return [b"".join(map(look, pieces)) for pieces in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[str, ByteBpe] = {}


def _coder(token: str, load) -> ByteBpe:
    """The coder of this worker process, built once."""
    if token not in _CODERS:
        _CODERS.clear()
        _CODERS[token] = ByteBpe(*load.value)
    return _CODERS[token]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids on request.

    Every match of ``pattern`` is encoded on its own; special tokens do not exist. The ids are decoded again
    and the hash of the resulting bytes is returned. The model (a few MB, fixed by the vocabulary) is
    broadcast; rows are independent, so there is no shuffle. A null text counts as empty: no ids. A null
    doc_id stays null.
    """
    spark = docs.sparkSession
    load = spark.sparkContext.broadcast((ranks, serialise_model(ranks), pattern))
    kind = docs.schema["doc_id"].dataType.simpleString()
    token = hashlib.sha256(load.value[1]).hexdigest() + pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from colonnade.llm.storage import text_batches

        coder = _coder(token, load)
        for batch in batches:
            for _, part in text_batches(batch, "text", 1 << 19):
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                columns = [
                    part.column("doc_id"),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        coder.known = {}  # the worker goes on to other work

    form = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text")).mapInArrow(run, form)

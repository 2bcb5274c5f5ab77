"""Small tables with the awkward rows that every operator has to take, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use for columns of their own.
    T.StructField("size", T.StringType()), T.StructField("keep_id", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("component", T.StringType()), T.StructField("row", T.StringType()), T.StructField("hash", T.StringType()),
])

VOCABULARY = [a + b for a in "ka lo mi nu pe ro sa ti".split() for b in "den fal gor hum jin kor lun mas".split()]


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(VOCABULARY) for _ in range(words))


def edited(text: str, seed: int, edits: int) -> str:
    pick, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"neu{pick.randrange(10_000)}"
    return " ".join(words)


def document_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    texts = [
        None, "", " \t\n\x0b ", "one", "One", "two words", "three little words", "four words make one", "!!! ... ???", "12345 67890",
        prose(2, 400), prose(2, 400), prose(2, 400).upper(), edited(prose(2, 400), 3, 4), edited(prose(2, 400), 4, 5),
        prose(5, 120), prose(6, 120), edited(prose(5, 120), 7, 40), long_text, edited(long_text, 8, 20),
        "Größe straße naïve ÉCOLE niño   tab\tx\r\nline", "Ünï" * 50, "x" * 5000, " " * 3000, "a@b.co +49 30 1234567 10.0.0.1", "ÄÖÜ äöü",
    ]
    sources = ["web", None, "books", "web", "web", "a", "B", ""]
    rows = [(i, t, "en" if i % 3 else None, sources[i % len(sources)]) for i, t in enumerate(texts)]
    # A null id, rows that repeat an id with the same and with another text.
    rows += [(None, "one", "en", "web"), (None, prose(9, 80), "en", "web"), (10, texts[10], "en", "books"), (15, "other text for this id", None, None)]
    return [(i, t, lang, s, None if t is None else len(t), "1", "x", "y", "z", "r", "h") for i, t, lang, s in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(document_rows() if rows is None else rows, DOCUMENTS).repartition(3)


def plain(spark, texts: list[str | None]):
    return documents(spark, [(i, t, "en", "s", None, *"abcdef") for i, t in enumerate(texts)])


def no_documents(spark):
    return documents(spark, [])


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text: str | None, length: int) -> set:
    words = WORD.findall(lowered(text))
    if len(words) < length:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def smallest_reachable(n: int, links) -> list[int]:
    """Component of each of n nodes, named by its first member."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def bucket(name: str):
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(4))

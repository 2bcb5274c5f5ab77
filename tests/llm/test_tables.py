"""Operators over the whole table: phrases, Merkle manifest, word BPE."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import document_rows, documents, lowered, no_documents, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import merkle, phrases
from colonnade.llm.merkle import manifest
from colonnade.llm.phrases import mine_phrases, split_words
from colonnade.llm.queries import word_file
from colonnade.llm.storage import Scratch
from colonnade.llm.trie import build
from colonnade.llm.wordbpe import Lexicon, Merges, WordBpe, compile_lexicon, encode_words

PIECE, PIECE_WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def pieces(text):
    return [PIECE_WORD.findall(p) for p in PIECE.split(lowered(text))]


def brute_phrases(rows, least, longest, top):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for words in pieces(text):
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and f[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates)
            if not inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least,top,small", [(3, 2000, False), (4, 7, True)])
def test_phrases_match_brute_force(spark, monkeypatch, least, top, small):
    if small:  # many tries and dictionaries instead of one
        monkeypatch.setattr(phrases, "TRIE_ROWS", 40)
        monkeypatch.setattr(phrases, "LEXICON_BYTES", 600)
    rows = [r for r in document_rows() if not r[1] or len(r[1]) < 9000]
    rows += [(100 + i, "New York, new york! The new york of A\x01b a b new york.\nnew york the new york the new york", "en", *rows[0][3:]) for i in range(4)]
    got = rows_of(mine_phrases(documents(spark, rows), least, 5, top), *PHRASE_COLUMNS)
    assert got == brute_phrases(rows, least, 5, top)
    assert got


def test_large_rows_are_written_in_bounded_pieces(spark):
    """A task holds a few rows of a megabyte at a time, however many its part of the table has."""
    import glob

    import pyarrow.parquet as pq

    def rows(batches):
        for _ in batches:
            pass
        pick = np.random.default_rng(1)
        for _ in range(60):
            yield pa.RecordBatch.from_arrays([pa.array([pick.bytes(1 << 20)], pa.binary())], ["ids"])

    kept = Scratch(spark, "large").keep(spark.range(1).coalesce(1).mapInArrow(rows, "ids binary"), "rows", large_rows=True)
    groups = [g for f in glob.glob(f"{kept._scratch}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == 60 and max(g.total_byte_size for g in groups) <= 24 << 20
    assert kept.count() == 60


def test_no_phrases(spark):
    assert mine_phrases(no_documents(spark)).collect() == []
    assert mine_phrases(documents(spark, [(1, None, None, *[None] * 8), (2, " .,\t", "en", *[None] * 8)])).collect() == []


@given(st.lists(st.text(alphabet="aB \t.,\né\x0b", max_size=12) | st.none(), max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_and_pieces(texts):
    words, opens = split_words(pa.array(texts, pa.string()))
    expected = [w for t in texts for w in pieces(t) if w]
    assert words.to_pylist() == [w for p in expected for w in p]
    # Opening words part at least what the pieces part.
    assert opens.tolist() == [k == 0 for p in expected for k in range(len(p))]


@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.tuples(*[st.sampled_from([1, 2, 3, 255, 256, 257, 70_000, 2**24])] * k), max_size=40)), st.randoms())
@settings(max_examples=150, deadline=None)
def test_trie_finds_its_rows(rows, pick):
    rows = sorted(set(rows))
    if not rows:
        return
    line = [x for r in pick.sample(rows, len(rows)) for x in r] + [0, 1, 2, 3]
    trie = build(np.asarray(rows, np.int32))
    look = {r: i for i, r in enumerate(rows)}
    k = len(rows[0])
    assert trie.find(np.asarray(line, np.int32)).tolist() == [look.get(tuple(line[i : i + k]), -1) for i in range(len(line))]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    doc_id, text, lang, source, n_chars = row[:5]
    for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(out)


def tree(nodes):
    """Root and per leaf its list of (side, sibling or None)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        made, joined = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for own, at in enumerate(range(i, i + len(pair))):
                for k in groups[at]:
                    paths[k].append((own, pair[1 - own] if len(pair) == 2 else None))
            made.append(digest(*pair))
            joined.append([k for g in groups[i : i + 2] for k in g])
        nodes, groups = made, joined
    return (nodes[0] if nodes else None), paths


def fold(node, path):
    for side, other in path:
        node = digest(node) if other is None else digest(other, node) if side else digest(node, other)
    return node


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    sub = {g: tree([leaf(r) for r in own[g]]) for g in langs}
    root, top = tree([sub[g][0] for g in langs])
    out = []
    for g, up in zip(langs, top):
        for r, path in zip(own[g], sub[g][1]):
            path = path + up
            bad = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            folded = fold(leaf(r, int(bad)), path)
            out.append((r[0], leaf(r), sub[g][0], root, digest(*[s for _, s in path if s]), folded, folded == root))
    return sorted(out, key=repr)


MANIFEST_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_matches_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = document_rows()
    rows = [(i, t, lang if k % 5 else ["de", "", "ß", "z"][k % 4], *rest) for k, (i, t, lang, *rest) in enumerate(rows)]
    got = rows_of(manifest(documents(spark, rows)), *MANIFEST_COLUMNS)
    assert got == brute_manifest(rows)
    assert {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_manifest_of_few_rows(spark, n):
    rows = document_rows()[5 : 5 + n]
    assert rows_of(manifest(documents(spark, rows)), *MANIFEST_COLUMNS) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest(no_documents(spark)).collect() == []


@pytest.fixture(scope="module")
def raw():
    with open(word_file(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw)


@pytest.fixture(scope="module")
def coder(raw, tmp_path_factory):
    merges = Merges(raw)
    words = sorted(w.encode() for w in "the and of straße den den1 kaden kafel lo don t s re".split())
    arrays = compile_lexicon(words)
    ids = [merges.encode(w) for w in words]
    arrays["first"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    arrays["ids"] = np.asarray([x for i in ids for x in i], "<u4")
    path = str(tmp_path_factory.mktemp("lexicon") / "words.bin")
    Lexicon.write(arrays, path)
    return WordBpe(raw, Lexicon.mapped(path))


def agrees(coder, library, texts):
    ids, shown = coder.encode(texts)
    for text, i, s in zip(texts, ids, shown):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == expected, text
        assert s.decode() == library.decode(expected, skip_special_tokens=False), text


@given(st.lists(st.text(alphabet="abstrevmld'  \n.,09ÉßİıΣς中é́🙂<|>\x85\x00", max_size=40), max_size=4))
@settings(max_examples=300, deadline=None)
def test_word_bpe_equals_the_library(coder, library, texts):
    agrees(coder, library, texts)


def test_word_bpe_of_odd_texts(coder, library):
    agrees(coder, library, [
        "", "'", "''s", "don't'sam I'Re 'll ''s a's'tb", "<|startoftext|>Hi<|endoftext|>  there<|endoftext|>", "x" * 5000, "é" * 3000, "STRASSE straße"])


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=150, deadline=None)
def test_automaton_ranks_its_words(words, others):
    ordered = sorted(words)
    lexicon = Lexicon(compile_lexicon(ordered))
    asked = ordered + others
    expected = [ordered.index(w) if w in words else -1 for w in asked]
    assert lexicon.ranks(pa.array(asked, pa.large_binary())).tolist() == expected


def test_automaton_shares_ends():
    arrays = compile_lexicon([b"cats", b"dogs", b"hogs"])
    assert len(arrays["key"]) == 8  # c-a-t-s; d, h to one -o-g into the same s


def test_word_bpe_over_a_table(spark, library):
    rows = document_rows()
    got = rows_of(encode_words(documents(spark, rows), word_file(), most=50, with_ids=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        expected.append((
            doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), ids))
    assert got == sorted(expected, key=repr)
    assert encode_words(no_documents(spark), word_file()).count() == 0

"""Operators that compare documents, pages or vectors, and the pipeline, against brute force."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from cases import document_rows, documents, edited, lowered, no_documents, plain, prose, rows_of, shingles, smallest_reachable
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import jaccard, warc
from colonnade.llm.jaccard import folded, group_count, jaccard_groups, may_link
from colonnade.llm.links import components
from colonnade.llm import passages as passage_module
from colonnade.llm.passages import aligned, chains, common_words, shared_passages
from colonnade.llm.queries import SQL
from colonnade.llm.storage import Scratch, member_mask
from colonnade.llm.vectors import near_vectors
from colonnade.llm.wordhash import run_hashes, word_hashes
from colonnade.session import cut_lineage


def brute_components(rows, length, percent):
    """(doc_id, n_shingles, component_id) per row of (doc_id, text, ...)."""
    sets = [shingles(r[1], length) for r in rows]
    links = [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = smallest_reachable(len(rows), links)
    out = []
    for k, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        out.append((row[0], len(sets[k]), min(ids) if ids and sets[k] else row[0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("length, percent", [(4, 85), (5, 80)])
def test_jaccard_groups_match_brute_force_on_edge_rows(spark, length, percent):
    assert rows_of(jaccard_groups(documents(spark), length, percent), *COLUMNS) == brute_components(document_rows(), length, percent)


def test_jaccard_groups_match_brute_force_on_families(spark):
    """Chains of edits, families around the threshold, and a passage that many documents share."""
    pick, texts = random.Random(11), []
    for family in range(12):
        base = prose(100 + family, pick.choice([12, 40, 90, 200]))
        for member in range(12):
            base_or_last = texts[-1] if member and pick.random() < 0.5 else base
            texts.append(edited(base_or_last, 1000 * family + member, pick.choice([0, 1, 1, 2, 3])))
    passage = prose(999, 25)
    texts += [f"{prose(2000 + i, 30)} {passage} {prose(3000 + i, 30)}" for i in range(40)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for percent in (85, 60, 100):
        assert rows_of(jaccard_groups(df, 4, percent), *COLUMNS) == brute_components(rows, 4, percent)


def test_jaccard_groups_without_rows_or_links(spark):
    assert jaccard_groups(no_documents(spark)).count() == 0
    alone = plain(spark, [prose(i, 30) for i in range(5)] + [None, ""])
    assert all(r.doc_id == r.component_id for r in jaccard_groups(alone).collect())


@given(st.lists(st.integers(0, 60), max_size=40, unique=True), st.lists(st.integers(0, 60), max_size=40, unique=True), st.sampled_from([60, 80, 85, 100]))
@settings(max_examples=200, deadline=None)
def test_bound_never_rules_out_a_link(a, b, percent):
    if not a or not b:
        return
    vectors = [np.bincount(np.array(s) % group_count(len(s)), minlength=group_count(len(s))) for s in (a, b)]
    union = len({*a, *b})
    if 100 * len({*a} & {*b}) >= percent * union:
        assert may_link(len(a), vectors[0], len(b), vectors[1], percent)
    assert folded(vectors[0], 8).sum() == len(a)


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = [r[1] for r in document_rows()]
    words, bounds = word_hashes(pa.array(texts))
    seen = {}
    for k, text in enumerate(texts):
        from cases import WORD

        own = WORD.findall(lowered(text))
        assert bounds[k + 1] - bounds[k] == len(own)
        for word, value in zip(own, words[bounds[k] : bounds[k + 1]]):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    sliced = word_hashes(pa.array(texts).slice(10, 5))
    assert (sliced[0] == words[bounds[10] : bounds[15]]).all()
    runs, starts = run_hashes(words, bounds, 5)
    assert [len(set(runs[a:b])) for a, b in zip(starts[:-1], starts[1:])] == [len(shingles(t, 5)) for t in texts]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 9), (2001, 2000)]
    df = spark.createDataFrame(links, "a long, b long")
    out = {r.node: r.root for r in components(Scratch(spark, "test"), df).collect()}
    assert {out[i] for i in range(301)} == {0} and {out[1000 + i] for i in range(200)} == {1000}
    assert out[2001] == out[2000] == 2000
    assert components(Scratch(spark, "test"), df.limit(0)).count() == 0


def test_mask_never_lacks_a_name(spark):
    names = spark.range(5000).select(F.xxhash64("id").alias("name"))
    mask = member_mask(names, "name")
    values = np.array([r.name for r in names.collect()])
    assert mask.has(values).all()
    others = np.array([r.name for r in spark.range(10_000, 20_000).select(F.xxhash64("id").alias("name")).collect()])
    assert mask.has(others).mean() < 0.2
    assert not member_mask(names.limit(0), "name").has(values).any()


def brute_links(rows, cosine=0.98):
    good = {}
    for k, (_, vector, label) in enumerate(rows):
        if label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            v = np.array(vector, float)
            good[k] = v / np.abs(v).max()
            good[k] /= np.linalg.norm(good[k])
    return [
        (i, j) for i, j in combinations(good, 2)
        if rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine
    ]


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for base in rng.standard_normal((120, 32)):
        for _ in range(int(rng.integers(1, 5))):
            noise = rng.standard_normal(32) * rng.choice([0.0, 0.02, 0.1, 0.14])
            rows.append(((base + noise) * rng.choice([1.0, 3.0])).astype(np.float32).astype(float).tolist())
    rows = [(2 * i, v, i % 3) for i, v in enumerate(rows)]
    odd = [None, [], [None] * 32, [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], rows[0][1]]
    rows += [(5001 + 2 * i, v, 0) for i, v in enumerate(odd)] + [(6001, rows[0][1], None), (rows[1][0], rows[1][1], rows[1][2]), (None, rows[0][1], 0)]
    return rows


def test_near_vectors_match_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(4)
    links = brute_links(rows)
    root = smallest_reachable(len(rows), links)
    count = [sum(k in pair for pair in links) for k in range(len(rows))]
    expected = []
    for k, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        name = min(ids) if ids else None
        expected.append((row[0], count[k], name, row[0] == name))
    got = rows_of(near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    found = sum(r[1] for r in got) / max(1, sum(r[1] for r in expected))
    assert len(got) == len(rows) and 0.97 <= found <= 1.0
    same = np.mean([g == e for g, e in zip(got, sorted(expected, key=repr))])
    assert same > 0.95
    odd = {r[0]: r[1:] for r in got if r[0] in (5001, 5003, 5005, 5007, 5009, 5011, 6001)}
    assert all(value == (0, key, True) for key, value in odd.items())
    assert near_vectors(df.limit(0)).count() == 0


def page_rows():
    body = "<p>" + prose(1, 300) + "</p>"
    return [
        (1, "http://www.Example.com:80/a?b=1#top", body), (2, "https://blog.example.com/", body), (3, None, body), (4, "http://x.org", "short"),
        (5, "http://x.org", "short"), (6, "http://x.org/é", "Größe\r\n\r\nWARC/1.1\r\n\r\n" * 60), (7, "", None), (8, "a\r\nb\tc", ""),
        (None, "http://n.org/", body), (9, "http://x.org/long", "y" * 400_000), (6, "http://x.org/é", "Größe\r\n\r\nWARC/1.1\r\n\r\n" * 60),
    ] + [(100 + i, f"http://host.example.net/{i % 7}", body + str(i % 5)) for i in range(300)]


def test_archives_match_brute_force(spark):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, value string").repartition(3)
    expected = []
    for page, _, html in rows:
        payload = (html or "").encode()
        holder = max((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
        revisit = len(payload) >= 1000 and holder is not None and holder != page
        expected.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.archive_round_trip(df, file_bytes=100_000)
    assert rows_of(got, *columns) == sorted(expected, key=repr)
    assert got.select("file").distinct().count() > 3
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_index_finds_records_by_range_reads(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    scratch = Scratch(spark, "warc-test")
    path = warc.write_archives(scratch, df, 60_000)
    blocks, directory = warc.build_index(scratch, path, captures=16)
    assert blocks.count() == directory.count() > 10
    wanted = spark.createDataFrame([("net,example,host)/3", "103"), ("com,example)/a?b=1", "1"), ("net,example,host)/3", "absent")], "key string, page string")
    hits = warc.locate(scratch, blocks, directory, wanted)
    assert {(h.key, h.page) for h in hits.collect()} == {("net,example,host)/3", "103"), ("com,example)/a?b=1", "1")}
    found = warc.fetch_captures(hits).collect()
    assert {r.page for r in found} == {"103", "1"} and all(r.payload_bytes > 1000 for r in found)


def test_ranges_read_together_or_apart(tmp_path, monkeypatch):
    body = bytes(range(256)) * 40
    (tmp_path / "a").write_bytes(body)
    monkeypatch.setattr(warc, "GAP_BYTES", 100)
    monkeypatch.setattr(warc, "RUN_BYTES", 700)
    ranges = [(0, 10), (50, 300), (360, 5), (500, 900), (3000, 1), (10_000, 240)]
    for name in (str(tmp_path / "a"), f"file:{tmp_path}/a", f"file://{tmp_path}/a"):
        assert list(warc.read_ranges(name, ranges)) == [(at, n, body[at : at + n]) for at, n in ranges]


def test_a_url_with_many_captures_is_searched_in_one_block_each(spark, monkeypatch):
    rows = [(i, None if i % 3 else "http://hot.org/", f"<p>{i}</p>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch = Scratch(spark, "warc-hot")
    blocks, directory = warc.build_index(scratch, warc.write_archives(scratch, df, 20_000), captures=8)
    wanted = spark.createDataFrame([("org,hot)/" if i % 3 == 0 else "", str(i)) for i in range(300)], "key string, page string")
    monkeypatch.setattr(warc, "LEAF_ROWS", 4)
    for most_bytes in (warc.DIRECTORY_BYTES, 2000):
        routed = warc.route(scratch, directory, wanted, most_bytes).collect()
        assert len(routed) == len({(r.key, r.page) for r in routed}) == 300
        hits = warc.locate(scratch, blocks, directory, wanted, most_bytes).collect()
        assert sorted(int(h.page) for h in hits) == list(range(300))


def test_records_of_any_size_are_members():
    bodies = [b"x" * n for n in (1, 70_000, 1 << 24, (1 << 24) + 5)]
    whole = b"".join(warc.packed_record(b) + warc.MEMBER_END.encode() for b in bodies)
    found = list(warc.members(whole))
    assert [c for _, _, c in found] == bodies
    for at, size, content in found:
        assert [c for _, _, c in warc.members(whole[at : at + size])] == [content]
    with pytest.raises(ValueError):
        list(warc.members(whole[:-30]))


def test_url_keys(spark):
    urls = ["http://www.Example.com:80/A?b=1#top", "https://blog.example.com", "x", None, "ftp://a.b/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    keys = [r.k for r in df.select(warc.url_key(F.col("url")).alias("k")).collect()]
    assert keys == ["com,example)/a?b=1", "com,example,blog)/", "x)/", "", "b,a)/"]


def test_passages_are_found_and_others_left_alone(spark):
    passage = prose(500, 70)
    fuzzy = edited(passage, 1, 5)
    texts = [f"{prose(600 + i, 150)} {passage if i % 2 else fuzzy} {prose(700 + i, 150)}" for i in range(12)]
    texts += [prose(800 + i, 300) for i in range(20)] + [f"{prose(900 + i, 100)} {prose(501, 30)} {prose(950 + i, 100)}" for i in range(5)]
    texts += [None, "", "short text", prose(990, 6000) + " " + passage.upper()]
    out = shared_passages(plain(spark, texts)).collect()
    last = len(texts) - 1
    touched = {r.doc_id for r in out} | {r.other_id for r in out}
    assert touched == {*range(12), last}
    for row in out:
        a, b = texts[row.doc_id].lower().split()[row.start_word : row.end_word], texts[row.other_id].lower().split()[row.other_start : row.other_end]
        inside = set(passage.split()) | set(fuzzy.split())
        assert sum(w in inside for w in a) >= 0.95 * len(a)
        assert 60 <= len(a) <= 80 and row.equal_words == common_words(np.array(a), np.array(b)) and row.identity >= 0.8


def test_passages_of_many_chains_grow_at_once_as_each_by_itself():
    def slow(a, b):
        total = best = size = equal = same = 0
        top = 0
        for n, (x, y) in enumerate(zip(a, b), 1):
            total, same = total + (1 if x == y else -passage_module.MISMATCH), same + (x == y)
            top = max(top, total)
            if top - total > passage_module.DROP:
                break
            if total > best:
                best, size, equal = total, n, same
        return size, equal

    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, 150) for _ in range(40)]
    others = [np.where(rng.random(150) < 0.1 * (i % 5), 7, t) for i, t in enumerate(texts)]
    a, b = np.concatenate(texts), np.concatenate(others)
    starts, offsets = 150 * np.arange(40), rng.integers(0, 150, 40)
    for step, n in ((1, 150 - offsets), (-1, offsets + 1)):
        size, equal = passage_module.grown(a, starts + offsets, b, starts + offsets, n, step)
        expected = [slow(t[o:][:m] if step > 0 else t[o::-1], u[o:][:m] if step > 0 else u[o::-1]) for t, u, o, m in zip(texts, others, offsets, n)]
        assert list(zip(size.tolist(), equal.tolist())) == [(int(s), int(e)) for s, e in expected]
    least, place = passage_module.window_least(a, 14)
    views = np.lib.stride_tricks.sliding_window_view(a, 14)
    assert (least == views.min(axis=1)).all() and (place == views.argmin(axis=1) + np.arange(len(views))).all()


def test_passages_take_edge_rows(spark):
    out = shared_passages(documents(spark)).collect()
    touched = {r.doc_id for r in out} | {r.other_id for r in out}
    assert {10, 11, 12, 13, 14, 18, 19} <= touched and not touched & {0, 1, 2, 3, 16, 20}
    assert shared_passages(no_documents(spark)).count() == 0


def test_passages_of_pieces_that_other_documents_hold_first(spark):
    """Each piece of 20 words stands in many documents, all 60 in two; the first holders of the pieces differ."""
    pieces = [prose(20_000 + i, 20) for i in range(3)]
    texts = [f"{prose(21_000 + i, 60)} {pieces[i % 3]} {prose(22_000 + i, 60)}" for i in range(60)]
    texts += [f"{prose(23_000 + i, 80)} {' '.join(pieces)} {prose(24_000 + i, 80)}" for i in range(2)]
    out = shared_passages(plain(spark, texts)).collect()
    assert {r.doc_id for r in out} | {r.other_id for r in out} == {60, 61}
    assert all((r.equal_words, r.start_word, r.end_word) == (60, 80, 140) for r in out)


def test_passages_in_a_family_of_edited_copies(spark):
    """Every exact 50 words that two documents share lie in a passage of either, whatever other copies hold."""
    base = prose(25_000, 90)
    texts = [f"{prose(26_000 + i, 70)} {edited(base, i, 3)} {prose(27_000 + i, 70)}" for i in range(40)]
    out = shared_passages(plain(spark, texts)).collect()
    covered = [(r.doc_id, r.start_word, r.end_word) for r in out] + [(r.other_id, r.other_start, r.other_end) for r in out]
    split = [t.split() for t in texts]
    holders = {}
    for d, words in enumerate(split):
        for at in range(len(words) - 49):
            holders.setdefault(tuple(words[at : at + 50]), []).append((d, at))
    shared = [p for found in holders.values() if len({d for d, _ in found}) > 1 for p in found]
    assert shared
    for d, at in shared:
        assert any(d == x and a <= at and at + 50 <= b for x, a, b in covered)
    for r in out:
        a, b = split[r.doc_id][r.start_word : r.end_word], split[r.other_id][r.other_start : r.other_end]
        assert max(len(a), len(b)) >= 50 and common_words(np.array(a), np.array(b)) >= r.equal_words >= 0.8 * max(len(a), len(b))


def changed_passage(pick, base, share):
    """``base`` with so large a share of its words equal, the rest exchanged; the first and the last stay."""
    words = list(base)
    for at in pick.sample(range(1, len(words) - 1), int(len(words) * (1 - share) + 1e-9)):
        words[at] = f"new{pick.randrange(10**9)}"
    return words


@pytest.mark.parametrize("share", [0.8, 0.82, 0.85, 0.9])
def test_passages_with_exchanged_words_are_found_at_their_identity(spark, share):
    pick, texts = random.Random(int(100 * share)), []
    for i in range(30):
        base = prose(30_000 + i, pick.choice([50, 55, 60, 100])).split()
        texts += [" ".join([prose(31_000 + i, 40), *words, prose(32_000 + 2 * i + side, 40)]) for side, words in enumerate((base, changed_passage(pick, base, share)))]
    out = shared_passages(plain(spark, texts)).collect()
    assert {frozenset((r.doc_id // 2, r.other_id // 2)) for r in out} == {frozenset((i,)) for i in range(30)}
    for r in out:
        a, b = texts[r.doc_id].split()[r.start_word : r.end_word], texts[r.other_id].split()[r.other_start : r.other_end]
        assert max(len(a), len(b)) >= 50 and common_words(np.array(a), np.array(b)) >= r.equal_words >= 0.8 * max(len(a), len(b))


def test_passages_grow_to_their_ends_wherever_their_seeds_lead(spark):
    """All but the middle of 400 shared words stands in earlier documents piece by piece, so seeds of the pair meet in the middle only."""
    base = prose(33_000, 400).split()
    pieces = [base[at : at + 45] for at in [*range(0, 170, 10), *range(215, 356, 10)]]
    holders = [(i, " ".join([prose(34_000 + i, 30), *piece, prose(35_000 + i, 30)])) for i, piece in enumerate(pieces)]
    rows = holders + [(100 + i, " ".join([prose(36_000 + i, 60), *base, prose(37_000 + i, 60)])) for i in range(2)]
    names = passage_module.row_name
    try:
        # Documents stand for seeds in the order of their ids.
        passage_module.row_name = lambda doc_id, text: doc_id
        out = shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        passage_module.row_name = names
    assert [(r.doc_id, r.start_word, r.end_word, r.other_id) for r in out if {r.doc_id, r.other_id} == {100, 101}] == [(101, 60, 460, 100)]


def test_chains_follow_the_best_order():
    assert chains([0, 10, 20, 30], [100, 110, 120, 130]) == [[0, 1, 2, 3]]
    # An anchor out of order stays out; a far one starts anew.
    assert chains([0, 10, 20, 500, 510], [100, 400, 120, 900, 910]) == [[3, 4], [0, 2]]
    a, b = np.arange(100), np.concatenate([np.arange(50), [777], np.arange(51, 100)])
    assert aligned(a, b, [10, 70], [10, 70], k=6) == (0, 100, 0, 100, 99)


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_words_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_words(np.array(a, int), np.array(b, int)) == table[-1][-1]


@pytest.mark.parametrize("name, tables", [("op2_source_mix", ["documents", "labels"]), ("op9_exact_copies", ["documents"]), ("op4_web_archive", ["pages"])])
def test_queries_match_their_sql(spark, name, tables):
    import duckdb

    from colonnade.llm.queries import QUERIES

    base = duckdb.connect()
    for table in tables:
        base.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    result = base.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert rows_of(QUERIES[name](spark, "/root/testdata/sf0.001"), *columns) == sorted(map(tuple, result.fetchall()), key=repr)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = [(i, prose(i, 60), "xx", "a" if i % 2 else "b", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper(), "xx", "b", 1) for i in range(5)]
    rows += [(200 + i, edited(rows[10 + i][1], i, 1), "xx", "a", 1) for i in range(5)]
    rows += [(300, None, "xx", "a", None), (301, "12 34 !!", "xx", "a", 1), (302, "", "xx", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    scratch = Scratch(spark, "pipeline-test")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert ids("language") == sorted(r[0] for r in rows if r[0] < 300)
    # Copies: the larger id stays. Near copies: the smaller one.
    exact = sorted(set(ids("language")) - set(range(5)))
    assert ids("exact_copies") == exact
    assert ids("near_copies") == sorted(set(exact) - {200 + i for i in range(5)})
    words = sum(len(r.text.split()) for r in seen["mixed_sources"].collect())
    before = sum(len(r.text.split()) for r in seen["near_copies"].collect())
    assert words == round(1.5 * before)
    out = seen["tokens"].collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in seen["mixed_sources"].collect()) == sorted(r.decoded_sha256 for r in out)
    assert all(len(r.ids) == r.n_tokens for r in out)
    # run() is the same chain.
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_pipeline_keeps_one_row_of_each_group(spark):
    near = prose(30_000, 80)
    rows = [(1, prose(30_001, 80), "a")] * 50 + [(None, prose(30_002, 80), "a"), (None, prose(30_002, 80).upper(), "b")]
    rows += [(None, near, "a"), (None, near + " end", "a"), (5, prose(30_003, 80), "a"), (5, prose(30_003, 80) + " end", "a")]
    rows += [(None, "few words", "a"), (9, None, "a"), (9, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    near_only = corpus_pipeline.near_copies(spark, docs, "")
    assert Counter(r.doc_id for r in near_only.collect()) == {1: 1, None: 3, 5: 1, 9: 1}
    both = corpus_pipeline.near_copies(spark, Scratch(spark, "once").keep(corpus_pipeline.exact_copies(spark, docs, ""), "exact"), "")
    exact = Counter(r.doc_id for r in corpus_pipeline.exact_copies(spark, docs, "").collect())
    assert exact == {1: 1, None: 4, 5: 2, 9: 1}
    assert both.columns == docs.columns and Counter(r.doc_id for r in both.collect()) == {1: 1, None: 3, 5: 1, 9: 1}


def test_pipeline_takes_edge_rows(spark):
    for docs in (documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "edge").keep(stage(spark, docs, ""), "stage")
        docs.count()


def test_pipeline_keeps_columns_of_any_name_and_type(spark):
    """Names that the stages use themselves, and a map, which cannot be ordered."""
    own = ["_again", "_id", "_sha", "_key", "_name", "_digest", "_kept", "_row", "_facts", "_source", "_plan", "_text", "_words"]
    texts = [prose(7000 + i, 70) for i in range(6)]
    texts += [texts[0].upper(), texts[1] + " end", texts[2], texts[2]]
    rows = [(i if i < 8 else 2, t, "a", *(f"{c}{t[:9]}" for c in own), {"k": i}) for i, t in enumerate(texts)]
    form = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in own) + ", more map<string,int>"
    docs = spark.createDataFrame(rows, form).repartition(3)
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.mixed_sources):
        docs = Scratch(spark, "names").keep(stage(spark, docs, ""), "stage")
        assert docs.columns == ["doc_id", "text", "source", *own, "more"]
        if stage is corpus_pipeline.near_copies:
            assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3, 4, 5, 6]
    for r in docs.collect():
        first = next(t for i, t, *_ in rows if i == r.doc_id)
        assert all(r[c] == f"{c}{first[:9]}" for c in own) and len(r.more) == 1


def test_jaccard_keys_of_one_node_travel_once(spark):
    rows = [(i, [i, 5000, 6000 + i // 2]) for i in range(300)] + [(900, [])]
    keyed = cut_lineage(spark.createDataFrame(rows, "rep long, keys array<long>"))
    found = jaccard._shared_keys(keyed)
    assert sorted(map(tuple, found.collect())) == sorted([(5000, i) for i in range(300)] + [(6000 + i // 2, i) for i in range(300)])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(key") == 2 and plan.count("ReusedExchange") == 1

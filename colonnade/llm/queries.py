"""Registered queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.bpe import encode_documents, read_ranks
from colonnade.llm.exact import exact_groups
from colonnade.llm.jaccard import jaccard_groups
from colonnade.llm.langid import fit_languages, predict_languages
from colonnade.llm.merkle import manifest
from colonnade.llm.mixing import mix, weighted_documents
from colonnade.llm.passages import shared_passages
from colonnade.llm.phrases import mine_phrases
from colonnade.llm.pii import find_personal_data
from colonnade.llm.storage import held_out
from colonnade.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity, with_labels
from colonnade.llm.vectors import near_vectors
from colonnade.llm.warc import archive_round_trip
from colonnade.llm.wordbpe import encode_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_ngram_jaccard(spark, folder):
    return jaccard_groups(table(spark, folder, "documents"), length=4, percent=85).drop("first_name")


@query
def op2_source_mix(spark, folder):
    return mix(weighted_documents(table(spark, folder, "documents"), table(spark, folder, "labels")))


SQL["op2_source_mix"] = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), known as (
  select doc_id as label_id, max(quality) as quality from labels group by 1
), keyed as (
  select doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':17'), 1, 13))::ubigint::double + 0.5) / 4503599627370496.0)
      / (case when quality >= 1 then 2.0::double when quality <= 0 then 0.5::double else 1.0::double end) as key
  from sized left join known on doc_id = label_id
), sources as (
  select source, sum(size)::bigint as source_size, (2 * sum(size))::double as most,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from sized group by source
), level(round, level, n) as (
  select 0, 1.5::double * sum(source_size) / sum(w), 0::bigint from sources
  union all
  select round + 1, (select (1.5::double * sum(source_size) - coalesce(sum(most) filter (where w * level.level > most), 0))
      / sum(w) filter (where w * level.level <= most) from sources),
    (select count(*) from sources where w * level.level > most)
  from level where round < 40
), targets as (
  select source, source_size, least(most, w * (select max(level) from level)) as target from sources
), planned as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from targets
), run as (
  select k.*, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::bigint as rest,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) - k.size as before
  from keyed k join planned p on k.source is not distinct from p.source
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken
from run
"""


@query
def op3_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(with_labels(docs, labels))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


@query
def op4_web_archive(spark, folder):
    return archive_round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL["op4_web_archive"] = """
with body as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes,
    max(page_id) over (partition by coalesce(html, '')) as holder
  from pages
)
select page_id, payload_bytes, sha1(html) as payload_digest,
  case when payload_bytes >= 1000 and page_id <> holder then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> holder then holder end as refers_to
from body
"""


@query
def op5_shared_passages(spark, folder):
    return shared_passages(table(spark, folder, "documents"))


@query
def op6_near_vectors(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))


@query
def op7_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    return predict_languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_personal_data(spark, folder):
    return find_personal_data(table(spark, folder, "documents"))


@query
def op9_exact_copies(spark, folder):
    return exact_groups(table(spark, folder, "documents"))


SQL["op9_exact_copies"] = """
with norm as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id is not distinct from max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from norm
"""


WORD_FILE = "word_bpe_49k.json"


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_FILE)


def rank_file() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


@query
def op10_byte_bpe(spark, folder):
    path, pattern = rank_file()
    return encode_documents(table(spark, folder, "documents"), read_ranks(path), pattern)


@query
def op11_phrases(spark, folder):
    return mine_phrases(table(spark, folder, "documents"))


SQL["op11_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), lines as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
  select lang, w[i : i + k - 1] as p
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from lines, (select unnest(range(1, 6)) as k) where len(w) >= k)
), f as (
  select lang, p, count(*)::bigint as f from grams group by all having count(*) >= 100
), sizes as (
  select lang, sum(len(w))::bigint as n from lines group by 1
), cuts as (
  select c.lang, c.p, c.f as a, k, c.p[1 : k] as head, c.p[k + 1 :] as tail
  from (select *, unnest(range(1, len(p))) as k from f where len(p) >= 2) c
), scored as (
  select cuts.lang, cuts.p, a, k, h.f as l, t.f as r, n, (1000::hugeint * a * n // (h.f::hugeint * t.f))::bigint as score
  from cuts join f h on h.lang = cuts.lang and h.p = head join f t on t.lang = cuts.lang and t.p = tail join sizes on sizes.lang = cuts.lang
), weakest as (
  select *, row_number() over (partition by lang, p order by score, k) as nth from scored
), around as (
  select lang, f, unnest([p[1 : len(p) - 1], p[2 :]]) as sub from f where len(p) > 2
), gone as (
  select distinct around.lang, sub from around join f on f.lang = around.lang and f.p = sub where 100 * around.f >= 100 * f.f
), ranked as (
  select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score from weakest
  where nth = 1 and not exists (select 1 from gone where gone.lang = weakest.lang and gone.sub = weakest.p)
), placed as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked
)
select lang, rank, phrase, a, l, r, n, score from placed where rank <= 2000
"""


@query
def op12_manifest(spark, folder):
    return manifest(table(spark, folder, "documents"))


def _sql_leaf(n_chars: str) -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"

    return "sha256(" + " || ".join(field(v) for v in ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text")) + ")"


SQL["op12_manifest"] = f"""
with recursive bits(i, k, c) as (
  select i, 0, i::bigint from range(256) t(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8
), crc as (
  select list(c order by i) as tab from bits where k = 8
), leaves as (
  select doc_id, lang, {_sql_leaf("n_chars")} as leaf,
    case when xor(list_reduce(list_concat([4294967295::bigint], [ascii(x)::bigint for x in string_split(coalesce(doc_id::varchar, ''), '')]),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 and n_chars is not null
      then {_sql_leaf("n_chars + 1")} end as forged
  from documents, crc
), trees as (
  select lang, row_number() over (order by lang nulls first) - 1 as tree, count(*) over () as trees from (select distinct lang from leaves)
), placed as (
  select row_number() over () as r, tree, trees, leaf, forged, doc_id,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as width
  from leaves join trees on leaves.lang is not distinct from trees.lang
), nodes(tree, level, pos, width, digest) as (
  select tree, 0, pos, width, leaf from placed
  union all
  select tree, level + 1, pos // 2, (width + 1) // 2, sha256(string_agg(digest, '' order by pos)) from nodes where width > 1
  group by tree, level, pos // 2, width
), subroots as (
  select tree, level as height, digest as subroot from nodes where width = 1
), tops(level, pos, width, digest) as (
  select 0, tree, trees, subroot from subroots join (select distinct trees from trees) on true
  union all
  select level + 1, pos // 2, (width + 1) // 2, sha256(string_agg(digest, '' order by pos)) from tops where width > 1 group by level, pos // 2, width
), ends as (
  select level as top_height, digest as root from tops where width = 1
), steps as (
  select r, step, (p.pos >> step) & 1 as side, n.digest as sib
  from (select r, p.tree, pos, unnest(range(height)) as step from placed p join subroots s on s.tree = p.tree) p
    left join nodes n on n.tree = p.tree and n.level = step and n.pos = xor(p.pos >> step, 1)
  union all
  select r, height + step, (tree >> step) & 1, t.digest
  from (select r, p.tree, height, unnest(range(top_height)) as step from placed p join subroots s on s.tree = p.tree, ends) p
    left join tops t on t.level = step and t.pos = xor(tree >> step, 1)
), fold(r, step, digest) as (
  select r, 0, coalesce(forged, leaf) from placed
  union all
  select f.r, f.step + 1, sha256(case when side = 1 then coalesce(sib, '') || digest else digest || coalesce(sib, '') end)
  from fold f join steps s on s.r = f.r and s.step = f.step
), folded as (
  select r, arg_max(digest, step) as folded_root from fold group by r
), proofs as (
  select r, string_agg(sib, '' order by step) as joined from steps where sib is not null group by r
)
select doc_id, leaf, subroot, root, sha256(coalesce(joined, '')) as proof_sha256, folded_root, folded_root = root as verified
from placed join subroots using (tree) join folded using (r) left join proofs using (r), ends
"""


@query
def op13_word_bpe(spark, folder):
    return encode_words(table(spark, folder, "documents"), word_file())

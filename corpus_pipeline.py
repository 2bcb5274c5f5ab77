"""From raw documents to token ids: language filter, exact and near deduplication, source mix, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.bpe import encode_documents, read_ranks
from colonnade.llm.exact import exact_groups, lower_ascii
from colonnade.llm.jaccard import jaccard_groups, row_name
from colonnade.llm.langid import fit_languages, keep_languages
from colonnade.llm.mixing import draw_mix, letter_weight
from colonnade.llm.queries import rank_file
from colonnade.llm.storage import Scratch, free_names, held_out
from colonnade.session import ship_package

# Shingle length and similarity (hundredths) of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier recognises; texts without letters and doubtful ones go."""
    ship_package(spark)
    return keep_languages(docs, fit_languages(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))


def one_row_each(docs: DataFrame, marks: DataFrame, digest: Column) -> DataFrame:
    """One row of ``docs`` for every (doc_id, digest) that ``marks`` (doc_id, digest, kept) keeps.

    ``marks`` has a row per document and is written once. Only ids and digests of rows that go, or stand more than
    once, are joined with the documents; of the latter, which alone are gathered, the row that comes first as JSON
    stays. Columns of ``docs`` may have any name and type.
    """
    scratch = Scratch(docs.sparkSession, "marks")
    id_, digest_, kept_, row_ = free_names(docs, "_id", "_digest", "_kept", "_row")
    each = scratch.keep(marks, "marks").groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    keys = scratch.keep(
        each.filter("not kept or n > 1").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_), F.col("kept").alias(kept_)), "keys")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (digest == F.col(digest_))
    out = docs.join(scratch.small(keys), same, "left_anti")
    again = scratch.keep(keys.filter(F.col(kept_)), "again")
    if again.isEmpty():
        return out
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    gathered = docs.join(scratch.small(again), same).groupBy(id_, digest_).agg(F.min_by(row, F.to_json(row)).alias(row_))
    return out.unionByName(gathered.select(f"{row_}.*"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the largest id."""
    marks = exact_groups(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept")
    return one_row_each(docs, marks, F.unhex(F.sha2(lower_ascii(F.col("text")), 256)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram links connect: one with the smallest id."""
    ship_package(spark)
    groups = jaccard_groups(docs, SHINGLE_WORDS, SIMILARITY)
    marks = groups.select("doc_id", F.col("row_name").alias("digest"), (F.col("row_name") == F.col("first_name")).alias("kept"))
    return one_row_each(docs, marks, row_name(F.col("doc_id"), F.col("text")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken in part keeps its first words."""
    return draw_mix(docs, letter_weight(F.col("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with hashes of the ids and of the bytes they decode to."""
    ship_package(spark)
    path, pattern = rank_file()
    return encode_documents(docs, read_ranks(path), pattern, with_ids=True)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixed_sources", mixed_sources),
    ("tokens", tokens),
]

# Classification, similarity joins and byte-level BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.storage import Scratch, free_names

# Weights of the sources in code point order, repeating, and the share of all words that the mix takes.
SOURCE_WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
MOST_EPOCHS = 2

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(quality: Column) -> Column:
    """Good documents are four times as likely to come early as bad ones; unknown ones lie between."""
    return F.when(quality >= 1, 2.0).when(quality <= 0, 0.5).otherwise(1.0)


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from a hash of the id: ascending order is a weighted sample without replacement."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(scratch: Scratch, sized: DataFrame, weights=SOURCE_WEIGHTS, share=MIX_SHARE) -> DataFrame:
    """(source, source_size, rows, target): words wanted of each source.

    The budget is dealt by weight; a source stops at MOST_EPOCHS times its size and what it leaves is dealt
    to the others by weight. The level (words per unit of weight) rises until no further source is full.
    """
    ordered = scratch.keep(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = scratch.keep(
        ordered.withColumn("place", place).join(F.broadcast(starts), "part")
        .withColumn("weight", F.element_at(cycle, (F.pmod(F.col("start") + F.col("place"), F.lit(len(weights))) + 1).cast("int")))
        .withColumn("most", (F.col("source_size") * MOST_EPOCHS).cast("double"))
        .select("source", "source_size", "rows", "weight", "most"),
        "ranked",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.lit(False) if full < 0 else F.col("weight") * level > F.col("most")
        row = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)).alias("taken"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("full"),
        ).first()
        if row.full == full or not row.open:
            break
        level, full = (share * total - row.taken) / row.open, row.full
    scratch.drop(ordered)
    targets = ranked.select("source", "source_size", "rows", F.least(F.col("most"), F.col("weight") * level).alias("target"))
    targets._scratch = ranked._scratch
    return targets


def plan_mix(scratch: Scratch, docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with their keys, and per source how far its budget reaches (see ``mix``).

    The order needs no sort of a whole source: key ranges are summed first, and only the range where a budget
    ends is ordered, so a source with a third of all rows is spread evenly.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    sized = scratch.keep(
        docs.select(
            "doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
            sampling_key(F.col("doc_id"), weight, seed).alias("key"),
        ),
        "sized",
    )
    targets = source_targets(scratch, sized)
    most_rows = targets.agg(F.max("rows")).first()[0] or 0
    # As many key ranges as rows in each: neither their sums nor the one opened range is large for any task.
    buckets = math.isqrt(most_rows) + 1
    plan = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
    ).withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # A rest that rounds to the whole source is one more epoch.
    full = (F.col("source_size") > 0) & (F.col("left") >= F.col("source_size"))
    plan = plan.withColumns({"epochs": F.when(full, F.col("epochs") + 1).otherwise(F.col("epochs")), "left": F.when(full, 0).otherwise(F.col("left"))})
    plan._scratch = targets._scratch
    # 1 - exp(-key) spreads the keys over (0, 1).
    bucketed = sized.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket")
    ends = (
        sums.withColumn("before", F.sum("words").over(run) - F.col("words"))
        .join(scratch.small(plan), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
        .select("s", F.col("bucket").alias("b"), (F.col("left") - F.col("before")).alias("rest"))
    )
    edge = (
        bucketed.join(F.broadcast(ends) if scratch.bytes_of(plan) <= (4 << 20) else ends,
                      F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .groupBy("s", "rest", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    )
    inside = Window.partitionBy("s").orderBy("key", "doc_id", "size")
    both = F.col("size") * F.col("copies")
    cut = (
        edge.withColumn("before", F.sum(both).over(inside) - both)
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + both))
        .select("s", F.struct("key", "doc_id", "size").alias("cut"),
                F.floor((F.col("rest") - F.col("before")) / F.col("copies")).alias("part"))
    )
    whole = scratch.keep(
        plan.join(cut.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "plan"
    )
    return sized, whole


def _fraction(here: Column, size: Column, cut: Column, part: Column) -> Column:
    """Words taken in the last, incomplete epoch by the row at ``here``, an ordered (key, doc_id, size).

    Without a cut the budget ends at the end of an epoch or the source has no words.
    """
    return F.when(cut.isNull(), 0).when(here < cut, size).when(here == cut, part).otherwise(0)


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of ``docs`` (doc_id, source, size, weight).

    Every document is taken once per complete epoch of its source. The rest of the budget goes to documents
    in the order of their sampling keys; the last one gives only its first words, so that a source's words
    meet its target to the word.

    Null sizes count 0 and null weights 1. A null source is a source of its own, the last. Rows that repeat
    an id share what is left at the cut evenly.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized, plan = plan_mix(scratch, docs, seed)
    last = _fraction(F.struct("key", "doc_id", "size"), F.col("size"), F.col("cut"), F.col("part"))
    return sized.join(scratch.small(plan), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken")
    )


def letter_weight(text: Column) -> Column:
    """Share of letters and white space among the characters, from 0.5 to 1: a quality weight without labels."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return 0.5 + 0.5 * F.coalesce(plain / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def draw_mix(docs: DataFrame, weight: Column, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns they had.

    The copy that is taken in part keeps the text up to the last word taken, and its n_chars follow. Rows
    without words are taken 0 times.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    weight = F.coalesce(weight.cast("double"), F.lit(1.0))
    facts = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), weight.alias("weight"))
    sized, plan = plan_mix(scratch, facts, seed)
    names = docs.columns
    facts_, source_, plan_, words_, text_ = free_names(docs, "_facts", "_source", "_plan", "_words", "_text")
    rows = docs.withColumn(facts_, F.struct(word_count(F.col("text")).alias("size"), sampling_key(F.col("doc_id"), weight, seed).alias("key")))
    limits = scratch.small(plan).select(F.col("s").alias(source_), F.struct("epochs", "cut", "part").alias(plan_))
    rows = rows.join(limits, F.col("source").eqNullSafe(F.col(source_)))
    size = F.col(f"{facts_}.size")
    here = F.struct(F.col(f"{facts_}.key").alias("key"), F.col("doc_id"), size.alias("size"))
    part = _fraction(here, size, F.col(f"{plan_}.cut"), F.col(f"{plan_}.part")).cast("long")
    copies = F.filter(
        F.concat(F.array_repeat(size, F.col(f"{plan_}.epochs").cast("int")), F.array(part)), lambda words: words > 0
    )
    drawn = rows.withColumn(words_, F.explode(copies))
    whole = F.col(words_) >= size
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.col(words_).cast("int")), ""))
    drawn = drawn.withColumn(text_, text)
    columns = []
    for name in names:
        if name == "text":
            columns.append(F.col(text_).alias("text"))
        elif name == "n_chars":
            columns.append(F.when(whole, F.col(name)).otherwise(F.length(text_)).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return drawn.select(columns)


def weighted_documents(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, source, size, weight) with weights from the best quality label of an id."""
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    if labels is None:
        return sized.withColumn("weight", F.lit(1.0))
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    return sized.join(known, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", "source", "size", quality_weight(F.col("quality")).alias("weight")
    )

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.storage import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Alternating star steps: a large step links every larger neighbour to the smallest node around, a small
    step does so for the smaller ones. Each step is written to the shared folder. Stars settle after a number
    of rounds that grows with the logarithm of the longest chain, and the loop runs until they have.
    """
    edges = scratch.keep(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = -1
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.keep(
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = scratch.keep(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct(),
            "small",
        )
        # Settled when every node hangs on one root that hangs on nothing: the same links before and after.
        mark = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(edges, large)
        edges = small
        if (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
    roots = edges.select(F.col("v").alias("node")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
    out._scratch = edges._scratch
    return out

"""Connected components of a graph too large for one machine: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.storage import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of `edges` (u, v: longs, no nulls).

    Loops and repeated edges are allowed. Every round links neighbours to the smallest node they know of; the minima
    are combined before the shuffle, so a node with very many neighbours is no task of its own. The rounds grow with
    the logarithm of the longest path.
    """
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (signature := _signature(now)) != before:
        before = signature
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

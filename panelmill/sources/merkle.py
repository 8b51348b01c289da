"""Fingerprints of text files as hash trees over fixed byte ranges.

Lines are hashed where they are read. A line belongs to the range in which it starts; a leaf is the digest of its lines
in order, a node the digest of its children in order. Ranges depend on the bytes alone, not on how files were split for
reading, so two fingerprints compare range by range: swapped or moved lines show, and the first range that differs
can be named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
FAN_OUT = 16


def _in_order(order: str, digest: str) -> Column:
    """Digest of the digests of a group, by `order`. A group is a range's lines or a node's children."""
    sorted_parts = F.array_sort(F.collect_list(F.struct(order, digest)))
    return F.sha2(F.array_join(F.transform(sorted_parts, lambda part: part[digest]), ""), 256)


def merkle_leaves(spark: SparkSession, path: str, key: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block (from 0), start (byte of its first line), bytes, lines and digest of every byte range with lines.

    With `key`, an expression over `path`, files of one key count as one file, one after another by path, however
    its lines are cut into files. Only digests and sizes are shuffled. Files without any line have no rows; a last line
    counts as ended.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).cast("bigint").alias("size"),
        F.sha2("value", 256).alias("digest"),
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1) if key is None else key
    per_split = lines.groupBy(name.alias("file"), "path", "split").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("file").orderBy("path", "split").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_split.select("file", "path", "split", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("inner", F.sum("size").over(within) - F.col("size")).join(bases, ["path", "split"])
    start = F.col("base") + F.col("inner")
    return (
        placed.select("file", start.alias("start"), "size", "digest")
        .groupBy("file", F.expr(f"start div {block_bytes}").alias("block"))
        .agg(F.min("start").alias("start"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("lines"), _in_order("start", "digest").alias("digest"))
    )


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """file, bytes, lines and digest: the root of each file's tree with its size. As many rounds as the tree is high."""
    most = leaves.agg(F.max("block")).first()[0] or 0
    nodes = leaves.select("file", F.col("block").alias("node"), "digest")
    while most > 0:
        nodes = nodes.groupBy("file", F.expr(f"node div {FAN_OUT}").alias("node")).agg(_in_order("node", "digest").alias("digest"))
        most //= FAN_OUT
    sizes = leaves.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
    root = F.sha2(F.concat_ws("|", "bytes", "lines", "digest"), 256)
    return sizes.join(nodes.drop("node"), "file").select("file", "bytes", "lines", root.alias("digest"))


def first_difference(previous: DataFrame, current: DataFrame) -> DataFrame:
    """file, block and start of the first range that differs in every file that does."""
    old = previous.select("file", "block", F.col("start").alias("_start"), F.col("digest").alias("_digest"))
    both = old.join(current.select("file", "block", "start", "digest"), ["file", "block"], "full")
    differing = both.filter(~F.col("digest").eqNullSafe(F.col("_digest")))
    place = F.struct("block", F.coalesce("start", "_start").alias("start"))
    return differing.groupBy("file").agg(F.min(place).alias("_at")).select("file", "_at.block", "_at.start")

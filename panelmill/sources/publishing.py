"""Partitioned storage with a manifest. A version becomes visible only when its manifest is committed to the log.

Readers ask the log for the newest version, so a failed or half-written load is never seen, and no folder has to be
renamed, which object stores cannot do atomically. Of two writers that start from the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.schema import Catalogue
from panelmill.session import cut_lineage
from panelmill.sources import commit_log
from panelmill.sources.holdings_file import ENTITY_COLUMN, HOLDINGS_CATALOGUE, IngestError, load_checked
from panelmill.sources.merkle import first_difference, merkle_leaves, merkle_roots

MANIFEST_VERSION = 1


def write_by_period(df: DataFrame, path: str, period: str = "month", max_rows_per_file: int = 0) -> None:
    """One folder per period, zstd Parquet. Rows are rebalanced by period, so a period that holds most of
    the rows is spread over many tasks and files, and small ones are not split up."""
    writer = df.hint("rebalance", period).write.partitionBy(period).option("compression", "zstd")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def read_by_period(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read it back; the period label stays text because the schema says so, not inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def readback(stored: DataFrame, entity: str) -> DataFrame:
    """Rows and distinct entities of what was written."""
    return stored.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"))


def manifest(stored: DataFrame, entity: str, period: str = "month", sample_share: float | None = None) -> DataFrame:
    """One row: rows, entities, periods, columns, sample share and the rows of every period."""
    per_period = stored.groupBy(period).agg(F.count(F.lit(1)).alias("_rows"))
    totals = stored.agg(F.count_distinct(entity).alias("entities")).withColumn("_one", F.lit(1))
    listed = F.array_sort(F.collect_list(F.struct(F.col(period).alias("period"), F.col("_rows").alias("rows"))))
    periods = per_period.agg(
        F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("periods"), listed.alias("rows_per_period")
    ).withColumn("_one", F.lit(1))
    return totals.join(periods, "_one").select(
        F.lit(MANIFEST_VERSION).alias("schema_version"),
        "rows",
        "entities",
        "periods",
        F.lit(len(stored.columns)).alias("columns"),
        F.lit(sample_share).cast("double").alias("sample_share"),
        "rows_per_period",
    )


def source_fingerprint(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """Per file its size, lines and a digest over its lines. With `key`, an expression over `file`, files
    are fingerprinted together, for example by folder.

    Lines are hashed where they are read and two 60-bit pieces of each hash are summed, so a file of any
    size is fingerprinted by many tasks. The order of the lines does not count, which suits folders that were written by
    many tasks; `merkle.py` has fingerprints in order.
    """
    digest = F.sha2("value", 256)

    def piece(start: int):
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)"))

    per_file = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("file", "bytes")
        .agg(F.count(F.lit(1)).alias("lines"), piece(1).alias("_a"), piece(16).alias("_b"))
    )
    name = F.regexp_extract("file", r"([^/]+)$", 1) if key is None else key
    return (
        per_file.groupBy(name.alias("file"))
        .agg(*[F.sum(part).alias(part) for part in ("bytes", "lines", "_a", "_b")])
        .select("file", "bytes", "lines", F.sha2(F.concat_ws("|", "lines", "_a", "_b"), 256).alias("digest"))
    )


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(F.regexp_replace("path", r"^.*?([^/]+=[^/]+/)?([^/]+)$", "$1$2").alias("file"), F.col("length").alias("bytes"))
    )


def file_status(previous: DataFrame, current: DataFrame) -> DataFrame:
    """unchanged, changed, missing or new, for every file of two listings (file, bytes[, digest])."""
    keys = [name for name in ("bytes", "digest") if name in previous.columns and name in current.columns]
    old = previous.select("file", F.struct(*keys).alias("_old"))
    new = current.select("file", F.struct(*keys).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "missing")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, "file", "full").select("file", status.alias("status"))


def rebuild_reason(
    entry: Mapping[str, object] | None,
    sample_share: float | None,
    stored_status: DataFrame | None,
    source_status: DataFrame | None,
) -> str | None:
    """Why the stored version cannot be used, or None when it can."""
    if entry is None:
        return "no manifest"
    if entry.get("schema_version") != MANIFEST_VERSION:
        return "other manifest version"
    if entry.get("sample_share") != sample_share:
        return f"stored sample share {entry.get('sample_share')}, asked for {sample_share}"
    if stored_status is not None:
        if stored_status.isEmpty():
            return "the manifest lists no files"
        if not stored_status.filter("status IN ('missing', 'changed')").isEmpty():
            return "a stored file is missing or changed"
    if source_status is not None and not source_status.filter("status <> 'unchanged'").isEmpty():
        return "the source differs from the one that was loaded"
    return None


def publish(
    rows: DataFrame,
    root: str,
    entity: str,
    period: str = "month",
    sample_share: float | None = None,
    expected_rows: int | None = None,
    expected_periods: Sequence[str] | None = None,
    source_leaves: DataFrame | None = None,
    base: int | None = None,
) -> dict[str, object]:
    """Write a new version, read it back, check it, and only then commit its manifest.

    `base` is the log number that the writer started from (that of now, if not given): CommitConflict if another writer
    has committed since. A version that fails its checks or its commit is removed at once, one whose writer died
    by a later publication. The manifest also lists the stored files and the fingerprints of the source files, whose
    ranges (`source_leaves`) are stored beside the version; they tell later whether it is still current.
    """
    spark = rows.sparkSession
    base = commit_log.last_number(spark, root) if base is None else base
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    try:
        write_by_period(rows, f"{folder}/rows", period)
        stored = read_by_period(spark, f"{folder}/rows", rows.schema)
        entry = manifest(stored, entity, period, sample_share).first().asDict(recursive=True)
        found = [item["period"] for item in entry["rows_per_period"]]
        if expected_rows is not None and entry["rows"] != expected_rows:
            raise IngestError(f"{entry['rows']} rows were stored, {expected_rows} expected")
        if expected_periods is not None and found != list(expected_periods):
            raise IngestError(f"periods {found} were stored, {list(expected_periods)} expected")
        files = [row.asDict() for row in stored_files(spark, f"{folder}/rows").orderBy("file").collect()]
        sources = []
        if source_leaves is not None:
            source_leaves.write.parquet(f"{root}/sources/{version}")
            roots = merkle_roots(spark.read.parquet(f"{root}/sources/{version}"))
            sources = [row.asDict() for row in roots.orderBy("file").collect()]
        entry |= {
            "version": version,
            "row_schema": rows.schema.json(),
            "source_rows": expected_rows,
            "source_files": sources,
            "files": files,
            "bytes": sum(file["bytes"] for file in files),
        }
        commit_log.commit(spark, root, base, entry)
    except Exception:
        remove_version(spark, root, version)
        raise
    for left_over in commit_log.unnamed_versions(spark, root):
        remove_version(spark, root, left_over)
    return entry


def remove_version(spark: SparkSession, root: str, version: str) -> None:
    """Remove the files of a version and the fingerprints of its source."""
    commit_log.remove_folder(spark, f"{root}/versions/{version}")
    commit_log.remove_folder(spark, f"{root}/sources/{version}")


def published_version(spark: SparkSession, root: str) -> dict[str, object] | None:
    """The newest manifest, or None before the first publication."""
    return commit_log.newest(spark, root)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The newest published version."""
    entry = published_version(spark, root)
    if entry is None:
        raise IngestError(f"nothing is published in {root}")
    schema = T.StructType.fromJson(json.loads(str(entry["row_schema"])))
    return read_by_period(spark, f"{root}/versions/{entry['version']}/rows", schema)


LISTING, FINGERPRINT = "file string, bytes bigint", "file string, bytes bigint, lines bigint, digest string"


def current_reason(
    spark: SparkSession, root: str, source: str, sample_share: float | None = None, leaves: DataFrame | None = None
) -> str | None:
    """Why the newest version cannot be used for the source files at `source`, or None when it can. leaves: the byte
    ranges of the source, if known already."""
    entry = published_version(spark, root)
    if entry is None or rebuild_reason(entry, sample_share, None, None):
        return rebuild_reason(entry, sample_share, None, None)
    listed = spark.createDataFrame([(f["file"], f["bytes"]) for f in entry["files"]], LISTING)
    status = file_status(listed, stored_files(spark, f"{root}/versions/{entry['version']}/rows"))
    known = [(f["file"], f["bytes"], f["lines"], f["digest"]) for f in entry["source_files"]]
    leaves = merkle_leaves(spark, source) if leaves is None else leaves
    origin = file_status(spark.createDataFrame(known, FINGERPRINT), merkle_roots(leaves))
    return rebuild_reason(entry, sample_share, status, origin)


def source_difference(spark: SparkSession, root: str, source: str) -> DataFrame:
    """file, block and start of the first byte range that differs in every source file that is not as it was loaded."""
    entry = published_version(spark, root)
    if entry is None or not entry["source_files"]:
        raise IngestError(f"{root} has no published version with the fingerprints of its source")
    return first_difference(spark.read.parquet(f"{root}/sources/{entry['version']}"), merkle_leaves(spark, source))


def load_unless_current(
    spark: SparkSession,
    source: str,
    root: str,
    catalogue: Catalogue = HOLDINGS_CATALOGUE,
    months: Sequence[str] | None = None,
    sample_share: float | None = None,
) -> tuple[DataFrame, str | None]:
    """The published rows of a raw source, loaded and published first if need be, and the reason for that."""
    base = commit_log.last_number(spark, root)
    leaves = cut_lineage(merkle_leaves(spark, source))
    reason = current_reason(spark, root, source, sample_share, leaves)
    if reason is not None:
        rows, facts = load_checked(spark, source, catalogue, months, sample_share)
        expected = facts["source_rows"] if sample_share is None else None
        publish(rows, root, ENTITY_COLUMN, "month", sample_share, expected, months, leaves, base)
    return read_published(spark, root), reason

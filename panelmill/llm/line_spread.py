"""Cross-site boilerplate lines, by how many distinct sites a line occurs on.

One HyperLogLog sketch of sites per line is built before the shuffle and merged after it, so a line's rows never
meet. Lines estimated at twice the threshold or more are boilerplate, below half of it they are not, and those in
between get an exact distinct count. Texts with the same set of lines count as one text on one site, so that copies
of a document do not turn its lines into boilerplate. Boilerplate is then removed from every text, except from one
of which nothing would be left.

Only DataFrame functions are used. Lines are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.storage import positional, stored

MIN_SITES = 10
_SKETCH_BITS = 12
#: boilerplate lines (two longs each) up to this many are broadcast, more are joined by a shuffle
BROADCAST_LINES = 500_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2")]


def _one_site_for_copies(docs: DataFrame, text: str, site: str) -> DataFrame:
    """_site and _text of every row, where rows with the same set of lines all have the smallest of their sites."""
    lines = F.sort_array(F.array_distinct(F.filter(_lines(text), lambda line: line != "")))
    rows = docs.select(F.col(site).cast("string").alias("_site"), F.col(text).alias("_text"), lines.alias("_set")).where(
        F.col("_site").isNotNull()
    ).select("_site", "_text", F.xxhash64("_set").alias("_s1"), F.xxhash64(F.lit(1), "_set").alias("_s2"))
    several = stored(
        rows.groupBy("_s1", "_s2").agg(F.min("_site").alias("_first"), F.max("_site").alias("_last"))
        .where(F.col("_first") != F.col("_last")).drop("_last"),
        "copied-texts",
    )
    side = F.broadcast(several) if several.count() <= BROADCAST_LINES else several
    return rows.join(side, ["_s1", "_s2"], "left").select(F.coalesce("_first", "_site").alias("_site"), "_text")


def boilerplate_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source"
) -> DataFrame:
    """The two hashes of each line that occurs on at least `min_sites` distinct sites.

    Texts with the same set of lines count on one site only. Empty lines are no lines; a null
    site is no site; null texts have no lines.
    """
    lines = (
        _one_site_for_copies(docs, text, site).select("_site", F.explode(_lines("_text")).alias("_line"))
        .where((F.col("_line") != "") & F.col("_site").isNotNull())
        .select("_site", *_hashes(F.col("_line")))
    )
    estimated = stored(
        lines.groupBy("_h1", "_h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(_SKETCH_BITS))).alias("_sites"))
        .where(F.col("_sites") >= min_sites / 2),
        "line-sites",
    )
    clear = estimated.where(F.col("_sites") >= 2 * min_sites).select("_h1", "_h2")
    near = estimated.where(F.col("_sites") < 2 * min_sites).select("_h1", "_h2")
    near_side = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    exact = (
        lines.join(near_side, ["_h1", "_h2"], "left_semi")
        .distinct()
        .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_sites"))
        .where(F.col("_sites") >= min_sites)
        .select("_h1", "_h2")
    )
    return clear.unionByName(exact)


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    report: bool = False,
) -> DataFrame:
    """`docs` with boilerplate lines cut from `text`; with `report` also n_lines (not empty) and n_removed.

    Copies count once (see `boilerplate_lines`), and only a text of which nothing would be left keeps all of it. Null texts
    stay null with 0 lines, texts without boilerplate stay as they are, very long texts are cut like others (a text is one
    row and must fit into a task), repeated rows are treated alike, null keys are allowed, an empty table gives an empty
    result. Every other column passes through, but for two that are named as the counts if these are asked for.
    """
    columns = docs.columns
    docs, at = positional(docs)
    key, text, site = at[key], at[text], at[site]
    marked = stored(boilerplate_lines(docs, min_sites, text, site), "boilerplate-lines")
    marked_side = F.broadcast(marked) if marked.count() <= BROADCAST_LINES else marked
    row_hash = F.xxhash64(F.col(key), F.col(text))
    hits = (
        docs.select(F.col(key).alias("_key"), row_hash.alias("_row"), F.posexplode(_lines(text)).alias("_at", "_line"))
        .where(F.col("_line") != "")
        .select("_key", "_row", "_at", *_hashes(F.col("_line")))
        .join(marked_side, ["_h1", "_h2"], "left_semi")
        .groupBy("_key", "_row").agg(F.collect_set("_at").alias("_cut"))
    )
    joined = docs.withColumn("_row_hash", row_hash).join(
        hits, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row_hash") == F.col("_row")), "left"
    )
    lines = _lines(text)
    cut = F.coalesce("_cut", F.array().cast("array<int>"))
    kept = F.filter(lines, lambda line, place: ~F.array_contains(cut, place))
    size = F.length(F.array_join(lines, ""))
    lost = size - F.length(F.array_join(kept, ""))
    applies = (F.size(cut) > 0) & (lost < size)
    counts = {
        "n_lines": F.coalesce(F.size(F.filter(lines, lambda line: line != "")), F.lit(0)).cast("long"),
        "n_removed": F.when(applies, F.size(cut)).otherwise(0).cast("long"),
    }
    cleaned = F.when(applies, F.array_join(kept, "\n")).otherwise(F.col(text))
    report_columns = counts if report else {}
    out = {name: cleaned if at[name] == text else F.col(at[name]) for name in columns if name not in report_columns} | report_columns
    return joined.select(*[column.alias(f"_out{place}") for place, column in enumerate(out.values())]).toDF(*out)

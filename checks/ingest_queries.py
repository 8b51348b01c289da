"""Reading, checking and storing the raw text panel, written as delimited files first."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle_base import EV
from checks.registry import query
from checks.tables import EV_CATALOGUE, raw_panel, table
from panelmill.session import scratch_path
from panelmill.sources import holdings_file as files
from panelmill.sources import commit_log, merkle, publishing

MONTHS = files.expected_months("2015-01", "2017-06")


def _write_csv(df, path: str) -> str:
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).option("escape", '"').csv(path)
    return path


def raw_csv(spark, sf) -> str:
    return _write_csv(raw_panel(spark, sf), scratch_path(spark, "raw-csv"))


def broken_csv(spark, sf) -> str:
    """The same with keys left out, flags of 300 and words for ids, by fixed rules."""
    k = F.col("ncodpers")
    rows = raw_panel(spark, sf)
    damaged = rows.withColumns(
        {
            "fecha_dato": F.when(k % 40 == 7, None)
            .when(k % 40 == 8, F.lit("2015-13-01"))
            .when(k % 40 == 13, F.lit("2015"))
            .when(k % 40 == 14, F.lit("2015-1"))
            .when(k % 40 == 15, F.lit("2015-01-28 junk"))
            .otherwise(F.col("fecha_dato").cast("string")),
            "ncodpers": F.when(k % 40 == 9, F.lit("NA")).when(k % 40 == 10, F.lit("id-7")).otherwise(k.cast("string")),
            "ind_view_ult1": F.when(k % 40 == 11, F.lit("300")).otherwise(F.col("ind_view_ult1").cast("string")),
            "ind_click_ult1": F.when(k % 40 == 12, F.lit("1.0")).otherwise(F.col("ind_click_ult1").cast("string")),
        }
    )
    return _write_csv(damaged, scratch_path(spark, "broken-csv"))


def _parsed(spark, path):
    return files.read_text(spark, path, files.check_header(spark, path, files.file_schema(EV_CATALOGUE).fieldNames()))


def _text(spark, path):
    parsed = _parsed(spark, path)
    return files.null_tokens(parsed, [name for name in parsed.columns if name != files.CORRUPT])


def _rows(spark, sf):
    rows, _ = files.load_checked(spark, raw_csv(spark, sf), EV_CATALOGUE, MONTHS)
    return rows


RAW_CELLS = f"""WITH {EV} SELECT (DATE '2015-01-28' + to_months(month_index))::DATE AS fecha_dato, customer_id AS ncodpers,
  CASE WHEN customer_id % 37 = 0 THEN ' NA' ELSE lpad((18 + customer_id % 95 + month_index // 12)::VARCHAR, 3, ' ') END AS age,
  CASE WHEN customer_id % 19 = 0 THEN '-999999' ELSE lpad((customer_id % 150 + month_index)::VARCHAR, 7, ' ') END AS antiguedad,
  CASE (customer_id + month_index) % 7 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN '2' WHEN 3 THEN 'p' WHEN 4 THEN '3.0'
    WHEN 5 THEN '9' ELSE ' P ' END AS indrel_1mes,
  CASE WHEN customer_id % 29 <> 1 THEN ' 1' ELSE ' ' END AS tipodom,
  'CITY, ' || c_nationkey || '  ' AS nomprov,
  CASE WHEN customer_id % 31 <> 5 THEN CASE WHEN customer_id % 41 = 3 THEN '2015'
    ELSE (DATE '2014-03-05' + ((customer_id % 50) * 15)::INTEGER)::VARCHAR END END AS fecha_alta,
  ind_view_ult1,
  CASE WHEN (customer_id + 2 * month_index) % 33 <> 0 THEN ind_purchase_ult1 END AS ind_purchase_ult1
FROM ev JOIN customer ON c_custkey = customer_id"""


@query("ingest_typed_csv", RAW_CELLS)
def ingest_typed_csv(spark, sf):
    return _rows(spark, sf).select(
        "fecha_dato", "ncodpers", "age", "antiguedad", "indrel_1mes", "tipodom", "nomprov", "fecha_alta",
        "ind_view_ult1", "ind_purchase_ult1",
    )


@query(
    "ingest_header_check",
    "SELECT 'is_active' AS column_name, 'unexpected' AS problem UNION ALL SELECT 'segmento', 'missing'",
)
def ingest_header_check(spark, sf):
    path = _write_csv(raw_panel(spark, sf).withColumnRenamed("segmento", "is_active"), scratch_path(spark, "renamed-csv"))
    return files.header_problems(spark, path, files.file_schema(EV_CATALOGUE).fieldNames())


@query(
    "ingest_key_not_null",
    f"""WITH {EV} SELECT 'fecha_dato' AS key_name, count(*) FILTER (WHERE customer_id % 40 = 7) AS missing_rows FROM ev
        UNION ALL SELECT 'ncodpers', count(*) FILTER (WHERE customer_id % 40 = 9) FROM ev""",
)
def ingest_key_not_null(spark, sf):
    return files.missing_keys(_text(spark, broken_csv(spark, sf)))


@query(
    "ingest_reject_malformed",
    f"""WITH {EV} SELECT 'fecha_dato' AS column_name, count(*) FILTER (WHERE customer_id % 40 IN (8, 13, 14, 15)) AS malformed_cells FROM ev
        UNION ALL SELECT 'ncodpers', count(*) FILTER (WHERE customer_id % 40 = 10) FROM ev
        UNION ALL SELECT 'ind_view_ult1', count(*) FILTER (WHERE customer_id % 40 = 11) FROM ev
        UNION ALL SELECT 'ind_click_ult1', count(*) FILTER (WHERE customer_id % 40 = 12) FROM ev
        UNION ALL SELECT unnest(['ind_signup_ult1', 'ind_purchase_ult1', 'ind_error_ult1']), 0""",
)
def ingest_reject_malformed(spark, sf):
    return files.malformed_cells(_text(spark, broken_csv(spark, sf)), files.file_schema(EV_CATALOGUE))


@query("ingest_row_reconcile", f"WITH {EV} SELECT count(*) AS data_lines, count(*) AS parsed_rows FROM ev")
def ingest_row_reconcile(spark, sf):
    path = raw_csv(spark, sf)
    return files.row_reconciliation(spark, path, _parsed(spark, path))


@query(
    "ingest_period_check",
    f"""WITH {EV}, found AS (SELECT DISTINCT strftime(DATE '2015-01-28' + to_months(month_index), '%Y-%m') AS month FROM ev),
    want AS (SELECT strftime(DATE '2014-11-01' + to_months(range::INTEGER), '%Y-%m') AS month FROM range(30))
    SELECT month, 'missing' AS problem FROM want WHERE month NOT IN (SELECT month FROM found)
    UNION ALL SELECT month, 'unexpected' FROM found WHERE month NOT IN (SELECT month FROM want)""",
)
def ingest_period_check(spark, sf):
    return files.period_differences(_rows(spark, sf), files.expected_months("2014-11", "2017-04"))


def _published(spark, sf):
    root = scratch_path(spark, "holdings")
    publishing.publish(_rows(spark, sf), root, files.ENTITY_COLUMN, expected_periods=MONTHS)
    return root, publishing.read_published(spark, root)


@query(
    "write_by_period",
    f"""WITH {EV} SELECT strftime(DATE '2015-01-28' + to_months(month_index), '%Y-%m') AS month, customer_id AS ncodpers,
        ind_view_ult1, CASE WHEN (3 * customer_id + month_index) % 25 <> 0 THEN ind_error_ult1 END AS ind_error_ult1 FROM ev""",
)
def write_by_period(spark, sf):
    path = scratch_path(spark, "by-period")
    rows = _rows(spark, sf)
    publishing.write_by_period(rows, path)
    stored = publishing.read_by_period(spark, path, rows.schema)
    return stored.select("month", "ncodpers", "ind_view_ult1", "ind_error_ult1")


@query("ingest_readback", f"WITH {EV} SELECT count(*) AS rows, count(DISTINCT customer_id) AS entities FROM ev")
def ingest_readback(spark, sf):
    return publishing.readback(_published(spark, sf)[1], files.ENTITY_COLUMN)


@query(
    "publish_atomic",
    f"""WITH {EV} SELECT strftime(DATE '2015-01-28' + to_months(month_index), '%Y-%m') AS month, count(*) AS rows FROM ev GROUP BY 1""",
)
def publish_atomic(spark, sf):
    """Rows per month of the published version; a second version that fails its check stays unseen."""
    root, _ = _published(spark, sf)
    half = publishing.read_published(spark, root).filter("month < '2016-01'")
    try:
        publishing.publish(half, root, files.ENTITY_COLUMN, expected_periods=MONTHS)
    except files.IngestError:
        pass
    return publishing.read_published(spark, root).groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "ingest_manifest",
    f"""WITH {EV}, per AS (SELECT strftime(DATE '2015-01-28' + to_months(month_index), '%Y-%m') AS period, count(*) AS rows
      FROM ev GROUP BY 1)
    SELECT period, p.rows AS period_rows, t.rows, t.entities, 30::BIGINT AS periods, 30 AS columns, 1 AS schema_version
    FROM per p, (SELECT count(*) AS rows, count(DISTINCT customer_id) AS entities FROM ev) t""",
)
def ingest_manifest(spark, sf):
    row = publishing.manifest(_published(spark, sf)[1], files.ENTITY_COLUMN)
    return row.select(
        "rows", "entities", "periods", "columns", "schema_version", F.inline("rows_per_period").alias("period", "period_rows")
    )


@query(
    "ingest_fingerprint",
    f"""WITH {EV}, per AS (SELECT strftime(DATE '2015-01-28' + to_months(month_index), '%Y-%m') AS file, count(*) AS n FROM ev GROUP BY 1)
    SELECT file, CASE file WHEN '2015-01' THEN 'missing' WHEN '2016-03' THEN 'changed' WHEN '2017-06' THEN 'new' ELSE 'unchanged' END
      AS status FROM per""",
)
def ingest_fingerprint(spark, sf):
    """One load against a later one: a month gone, a month changed, a month new; folder by folder."""
    rows = _rows(spark, sf)
    flipped = F.when(F.col("month") == "2016-03", (1 - F.col("ind_view_ult1")).cast("tinyint")).otherwise(
        F.col("ind_view_ult1")
    )
    first, second = scratch_path(spark, "load"), scratch_path(spark, "load")
    rows.filter("month <> '2017-06'").write.partitionBy("month").csv(first)
    rows.filter("month <> '2015-01'").withColumn("ind_view_ult1", flipped).write.partitionBy("month").csv(second)

    def prints(path):
        folder = F.regexp_extract("file", r"month=([^/]+)/", 1)
        return publishing.source_fingerprint(spark, path, folder).select("file", "digest")

    return publishing.file_status(prints(first), prints(second))


#: events as text lines, in order of their number
EVENT_LINES = "SELECT event_id, event_id || ',' || user_id || ',' || event_type AS line FROM events"
RANGE_BYTES = 4096


def _event_lines(spark, sf):
    line = F.concat_ws(",", "event_id", "user_id", "event_type").alias("line")
    return table(spark, sf, "events").select("event_id", line)


def _write_lines(lines, order) -> str:
    """Files in order: the tree of all of them together does not depend on where they are cut."""
    path = scratch_path(lines.sparkSession, "lines")
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(path)
    return path


def _tree_sql(lines: str, levels: int = 6) -> str:
    """CTEs lef (the ranges) and top (the root) of the lines of a query (event_id, line)."""
    steps = [
        f"""lin AS (SELECT sha256(line) AS digest, octet_length(encode(line)) + 1 AS size,
          sum(octet_length(encode(line)) + 1) OVER (ORDER BY event_id) - octet_length(encode(line)) - 1 AS start FROM ({lines})),
        lef AS (SELECT (start // {RANGE_BYTES})::BIGINT AS block, min(start)::BIGINT AS start, sum(size)::BIGINT AS bytes, count(*) AS lines,
          sha256(string_agg(digest, '' ORDER BY start)) AS digest FROM lin GROUP BY 1), n0 AS (SELECT block AS node, digest FROM lef)"""
    ]
    for level in range(levels):
        # once one node is left, it is the root
        steps.append(
            f"""n{level + 1} AS (SELECT node, digest FROM n{level} WHERE (SELECT max(node) FROM n{level}) = 0 UNION ALL
            SELECT node // 16, sha256(string_agg(digest, '' ORDER BY node)) FROM n{level} WHERE (SELECT max(node) FROM n{level}) > 0 GROUP BY 1)"""
        )
    return ", ".join(steps) + f""", top AS (SELECT sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines,
      sha256(sum(bytes)::BIGINT || '|' || sum(lines)::BIGINT || '|' || (SELECT digest FROM n{levels})) AS digest FROM lef)"""


@query("ingest_merkle", f"WITH {_tree_sql(EVENT_LINES)} SELECT 'all' AS file, * FROM top")
def ingest_merkle(spark, sf):
    path = _write_lines(_event_lines(spark, sf), "event_id")
    return merkle.merkle_roots(merkle.merkle_leaves(spark, path, F.lit("all"), RANGE_BYTES))


@query("ingest_merkle_ranges", f"WITH {_tree_sql(EVENT_LINES)} SELECT block, start, bytes, lines, digest FROM lef")
def ingest_merkle_ranges(spark, sf):
    path = _write_lines(_event_lines(spark, sf), "event_id")
    return merkle.merkle_leaves(spark, path, F.lit("all"), RANGE_BYTES).drop("file")


@query(
    "ingest_first_difference",
    f"""WITH mid AS (SELECT max(event_id) // 2 AS m FROM events), {_tree_sql(EVENT_LINES)},
      hit AS (SELECT sum(octet_length(encode(line)) + 1) AS before FROM ({EVENT_LINES}), mid WHERE event_id < m)
      SELECT 'all' AS file, block, start FROM lef, hit WHERE block = before // {RANGE_BYTES}""",
)
def ingest_first_difference(spark, sf):
    """Two neighbouring lines change places; the range in which the first of them starts is named."""
    lines = _event_lines(spark, sf)
    middle = F.floor(table(spark, sf, "events").agg(F.max("event_id")).scalar() / 2)
    place = F.when(F.col("event_id") == middle, middle + 1).when(F.col("event_id") == middle + 1, middle).otherwise(F.col("event_id"))
    first = _write_lines(lines, "event_id")
    second = _write_lines(lines.select(place.alias("event_id"), "line"), "event_id")
    ranges = [merkle.merkle_leaves(spark, path, F.lit("all"), RANGE_BYTES) for path in (first, second)]
    return merkle.first_difference(*ranges)


@query(
    "ingest_current",
    f"""WITH {EV}, n AS (SELECT count(*) AS rows FROM ev)
    SELECT state, reason, CASE WHEN state = 'before any load' THEN 0 ELSE rows END AS rows FROM n, (VALUES
      ('before any load', 'no manifest'), ('as loaded', NULL),
      ('another sample share', 'stored sample share None, asked for 0.5'),
      ('two lines swapped', 'the source differs from the one that was loaded'),
      ('a stored file gone', 'a stored file is missing or changed')) v(state, reason)""",
)
def ingest_current(spark, sf):
    """What a loader is told in each state of source and store, with the rows published then."""
    raw = raw_panel(spark, sf)
    source, root = _write_csv(raw, scratch_path(spark, "raw-csv")), scratch_path(spark, "lake")
    found = []

    def note(state, share=None, path=source):
        reason = publishing.current_reason(spark, root, path, share)
        entry = publishing.published_version(spark, root)
        found.append((state, reason, 0 if entry is None else entry["rows"]))

    note("before any load")
    publishing.load_unless_current(spark, source, root, EV_CATALOGUE, MONTHS)
    note("as loaded")
    note("another sample share", 0.5)
    # every file with its lines the other way round but for the heading
    lines = spark.read.text(source).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    swapped = scratch_path(spark, "swapped")
    order = F.when(F.col("value").startswith("fecha_dato,"), -1).otherwise(-F.col("at") + (1 << 60))
    lines.repartition("file").sortWithinPartitions("file", order).select("value").write.text(swapped)
    note("two lines swapped", path=swapped)
    entry = publishing.published_version(spark, root)
    one = publishing.stored_files(spark, f"{root}/versions/{entry['version']}/rows").orderBy("file").first()["file"]
    commit_log.remove_folder(spark, f"{root}/versions/{entry['version']}/rows/{one}")
    note("a stored file gone")
    return spark.createDataFrame(found, "state string, reason string, rows bigint")

"""The paired query forms: one answer for both forms of a pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle_base import BRAND_FLAGS, EV, EV_FLAGS, OR, STG, changes_of
from checks.registry import query, rounded
from checks.tables import TARGET, brand_panel, ev_panel, ev_warehouse, raw_panel, table
from panelmill.operators import pairs
from panelmill.session import scratch_path

COUNTS = """SELECT product_code, count(CASE WHEN delta = 1 THEN 1 END) AS adoptions, count(CASE WHEN delta = -1 THEN 1 END) AS attritions
  FROM chg WHERE since = 1 GROUP BY 1"""
EV_COUNTS = f"WITH {EV},{changes_of('ev', EV_FLAGS)} {COUNTS}"
BRAND_COUNTS = f"WITH {OR},{changes_of('brp', BRAND_FLAGS)} {COUNTS}"


@query("events_self_join", EV_COUNTS)
def events_self_join(spark, sf):
    return pairs.events_by_self_join(ev_panel(spark, sf))


@query("events_window", EV_COUNTS)
def events_window(spark, sf):
    return pairs.events_by_window(ev_panel(spark, sf))


@query("events_self_join_wide", BRAND_COUNTS)
def events_self_join_wide(spark, sf):
    return pairs.events_by_self_join(brand_panel(spark, sf))


@query("events_window_wide", BRAND_COUNTS)
def events_window_wide(spark, sf):
    return pairs.events_by_window(brand_panel(spark, sf))


LAST_LABEL = "2017-06"
SNAPSHOT = f"""WITH {EV} SELECT count(*) AS customers,
  sum(CASE WHEN (customer_id + 2 * month_index) % 33 <> 0 THEN ind_purchase_ult1 END)::BIGINT AS holders
  FROM ev WHERE month_index = 29"""


def write_months(spark, sf) -> str:
    """RAW stored by month; returns the folder."""
    path = scratch_path(spark, "months")
    rows = raw_panel(spark, sf).withColumn("month", F.date_format("fecha_dato", "yyyy-MM"))
    rows.hint("rebalance", "month").write.partitionBy("month").option("compression", "zstd").parquet(path)
    return path


def read_months(spark, path):
    """The month folders as text, whatever they look like."""
    files = spark.read.parquet(path)
    return files.withColumn("month", F.col("month").cast("string"))


@query("scan_full_then_filter", SNAPSHOT)
def scan_full_then_filter(spark, sf):
    return pairs.snapshot_full_scan(read_months(spark, write_months(spark, sf)), LAST_LABEL, TARGET, "fecha_dato")


@query("scan_pruned", SNAPSHOT)
def scan_pruned(spark, sf):
    return pairs.snapshot_pruned(read_months(spark, write_months(spark, sf)), LAST_LABEL, TARGET)


BREADTH = f"""WITH {STG}, own AS (
  SELECT customer_id, count(*) AS n, avg(n_products) AS mean_p, max(n_products) AS max_products, max(is_active) AS ever_active
  FROM fact GROUP BY 1)
SELECT max_products, ever_active, count(*) AS customers, round(avg(mean_p), 6) AS mean_avg_products,
  round(avg(n), 6) AS mean_months_present FROM own GROUP BY 1, 2"""


@query("summary_recompute", BREADTH)
def summary_recompute(spark, sf):
    return rounded(pairs.summary_by_breadth(pairs.entity_summary(ev_warehouse(spark, sf).fact)))


@query("summary_materialised", BREADTH)
def summary_materialised(spark, sf):
    path = scratch_path(spark, "entity-summary")
    pairs.entity_summary(ev_warehouse(spark, sf).fact).write.parquet(path)
    return rounded(pairs.summary_by_breadth(spark.read.parquet(path)))


RUNNING = f"""WITH {STG}, run AS (
  SELECT (SELECT count(*) FROM fact e WHERE e.customer_id = f.customer_id AND e.month_index <= f.month_index AND e.is_active = 1)
    AS active_months_so_far FROM fact f)
SELECT active_months_so_far, count(*) AS customer_months FROM run GROUP BY 1"""


@query("running_total_range_join", RUNNING)
def running_total_range_join(spark, sf):
    return pairs.running_active_by_range_join(ev_warehouse(spark, sf).fact)


@query("running_total_window", RUNNING)
def running_total_window(spark, sf):
    return pairs.running_active_by_window(ev_warehouse(spark, sf).fact)


@query(
    "pair_equivalence",
    f"""WITH {EV},{changes_of('ev', EV_FLAGS)}, win AS ({COUNTS}),
    jnd AS (SELECT a.product_code, count(CASE WHEN a.flag - b.flag = 1 THEN 1 END) AS adoptions,
        count(CASE WHEN a.flag - b.flag = -1 THEN 1 END) AS attritions
      FROM lng a JOIN lng b ON a.customer_id = b.customer_id AND a.product_code = b.product_code AND a.month_index = b.month_index + 1
      WHERE a.flag <> b.flag GROUP BY 1)
    SELECT product_code, adoptions::DOUBLE AS adoptions, attritions::DOUBLE AS attritions, 'left' AS only_in
      FROM (SELECT * FROM jnd EXCEPT ALL SELECT * FROM win)
    UNION ALL SELECT product_code, adoptions::DOUBLE, attritions::DOUBLE, 'right' FROM (SELECT * FROM win EXCEPT ALL SELECT * FROM jnd)""",
)
def pair_equivalence(spark, sf):
    panel = ev_panel(spark, sf)
    return pairs.result_difference(pairs.events_by_self_join(panel), pairs.events_by_window(panel))


#: CTEs cannot be repeated under one name, so each answer is a table of its own
ALL_PAIRS = f"""SELECT pair, n AS rows_left, n - gone AS rows_right, gone AS rows_different, gone = 0 AS equivalent FROM (
    SELECT 'events' AS pair, count(*) AS n, 0 AS gone FROM ({EV_COUNTS})
    UNION ALL SELECT 'events, one row short', count(*), 1 FROM ({EV_COUNTS})
    UNION ALL SELECT 'snapshot', count(*), 0 FROM ({SNAPSHOT})
    UNION ALL SELECT 'summary', count(*), 0 FROM ({BREADTH})
    UNION ALL SELECT 'running count', count(*), 0 FROM ({RUNNING}))"""


@query("pair_equivalence_all", ALL_PAIRS.replace(", 0 AS gone", ", 0::BIGINT AS gone"))
def pair_equivalence_all(spark, sf):
    """All four pairs, and a control that must differ: one of its results lacks its last row."""
    panel, fact = ev_panel(spark, sf), ev_warehouse(spark, sf).fact
    months = read_months(spark, write_months(spark, sf))
    path = scratch_path(spark, "entity-summary")
    pairs.entity_summary(fact).write.parquet(path)
    windowed = pairs.events_by_window(panel)
    short = windowed.filter(F.col("product_code") != windowed.agg(F.max("product_code")).scalar())
    return pairs.equivalence(
        {
            "events": (pairs.events_by_self_join(panel), windowed),
            "events, one row short": (windowed, short),
            "snapshot": (pairs.snapshot_full_scan(months, LAST_LABEL, TARGET, "fecha_dato"), pairs.snapshot_pruned(months, LAST_LABEL, TARGET)),
            "summary": (pairs.summary_by_breadth(pairs.entity_summary(fact)), pairs.summary_by_breadth(spark.read.parquet(path))),
            "running count": (pairs.running_active_by_range_join(fact), pairs.running_active_by_window(fact)),
        }
    )


@query(
    "pair_timing",
    """WITH t AS (SELECT event_type AS pair, user_id % 3 AS role, value AS seconds FROM events),
    m AS (SELECT pair, median(seconds) FILTER (WHERE role = 0) AS b, median(seconds) FILTER (WHERE role = 1) AS c,
      median(seconds) FILTER (WHERE role = 2) AS d FROM t GROUP BY 1)
    SELECT pair, round(b, 6) AS baseline_seconds, round(c, 6) AS candidate_seconds, round(d, 6) AS build_seconds,
      CASE WHEN c < b THEN 'candidate' ELSE 'baseline' END AS faster,
      round(greatest(b, c) / least(b, c), 6) AS ratio, CASE WHEN b > c THEN round(d / (b - c), 6) END AS break_even_queries FROM m""",
)
def pair_timing(spark, sf):
    """Event values stand in for recorded run times."""
    role = F.element_at(F.array(F.lit("baseline"), F.lit("candidate"), F.lit("build")), (F.col("user_id") % 3 + 1).cast("int"))
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("pair"), role.alias("role"), F.col("value").alias("seconds")
    )
    return rounded(pairs.timing_statistics(runs))

"""Time the headline queries and print one JSON line.

The raw panel is copied to more entities (new ids, flags shifted by the copy) and stored first. The warehouse is built
from it twice and the second build is timed. Every query then runs once to warm up and a few times for the median,
each time writing all its rows to a sink that discards them. `rows` and `rows_per_second` tell what a time is worth.

BENCH_SF_DIR: folder with the Parquet tables. BENCH_CPUS: local threads. BENCH_RUNS: timed runs per query.
BENCH_COPIES: copies of the raw panel.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import tables  # noqa: E402
from checks.pair_queries import LAST_LABEL, read_months, write_months  # noqa: E402
from panelmill.operators import evaluation, events, features, journeys, pairs, portfolio, quality  # noqa: E402
from panelmill.plans.star_schema import build_warehouse  # noqa: E402
from panelmill.session import scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = int(os.environ.get("BENCH_COPIES", "10"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("panelmill-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def copied(raw: DataFrame) -> DataFrame:
    """The raw panel for `COPIES` times as many entities; every copy has its flags one product further."""
    flags = [name for name in raw.columns if name.startswith("ind_") and name.endswith("_ult1")]
    held = F.array(*flags)
    shifted = {name: F.get(held, (F.lit(place) + F.col("_copy")) % len(flags)) for place, name in enumerate(flags)}
    return (
        raw.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        .withColumns({**shifted, "ncodpers": F.col("ncodpers") + F.col("_copy") * 10_000_000})
        .drop("_copy")
    )


#: lines that read other tables than the copied panel
OTHER_ROWS = {
    "write_by_month", "scan_full_then_filter", "scan_pruned", "events_self_join_wide", "events_window_wide", "product_events_wide",
    "point_metrics", "lift_table", "cluster_bootstrap",
}


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    raw_path = scratch_path(spark, "bench-raw")
    copied(tables.raw_panel(spark, SF_DIR)).write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    built: list = []
    for _ in range(2):
        path = scratch_path(spark, "bench-warehouse")
        times["warehouse_build"] = seconds(
            lambda: built.append(build_warehouse(spark, raw, tables.EV_CATALOGUE, tables.RAW_FIRST_MONTH, path, buckets=int(CPUS)))
        )
    w = built[-1]
    rows = w.fact.count()
    months_path: list[str] = []
    times["write_by_month"] = seconds(lambda: months_path.append(write_months(spark, SF_DIR)))
    summary_path = scratch_path(spark, "bench-summary")
    times["summary_build"] = seconds(lambda: pairs.entity_summary(w.fact).write.parquet(summary_path))
    wide_path = scratch_path(spark, "bench-wide")
    tables.brand_panel(spark, SF_DIR).write.parquet(wide_path)
    wide = spark.read.parquet(wide_path)
    months = read_months(spark, months_path[0])
    stored_summary = spark.read.parquet(summary_path)
    scores = tables.score_table(spark, SF_DIR)

    def product_events() -> DataFrame:
        return events.product_events(events.flag_changes(w.fact))

    queries = {
        "events_self_join": lambda: pairs.events_by_self_join(w.fact),
        "events_window": lambda: pairs.events_by_window(w.fact),
        "events_self_join_wide": lambda: pairs.events_by_self_join(wide),
        "events_window_wide": lambda: pairs.events_by_window(wide),
        "scan_full_then_filter": lambda: pairs.snapshot_full_scan(months, LAST_LABEL, tables.TARGET, "fecha_dato"),
        "scan_pruned": lambda: pairs.snapshot_pruned(months, LAST_LABEL, tables.TARGET),
        "summary_recompute": lambda: pairs.summary_by_breadth(pairs.entity_summary(w.fact)),
        "summary_materialised": lambda: pairs.summary_by_breadth(stored_summary),
        "running_total_range_join": lambda: pairs.running_active_by_range_join(w.fact),
        "running_total_window": lambda: pairs.running_active_by_window(w.fact),
        "quality_summary": lambda: quality.summarise(
            quality.standard_checks(w.stg, w.fact, w.entities, w.products, w.periods)
        ),
        "product_events": product_events,
        "product_events_wide": lambda: events.product_events(events.flag_changes(wide)),
        "event_summary": lambda: events.event_summary(w.changes, w.periods, w.catalogue),
        "penetration": lambda: portfolio.penetration(w.fact, w.periods, w.catalogue),
        "transitions": lambda: journeys.transitions(product_events(), w.catalogue),
        "ladder_funnel": lambda: journeys.ladder_funnel(w.fact, w.entities, w.catalogue),
        "time_to_next": lambda: journeys.time_to_next(product_events(), w.entities),
        "cohort_retention": lambda: journeys.cohort_retention(w.fact, w.entities, w.periods, w.first_month),
        "engagement": lambda: portfolio.engagement(w.by_month, w.periods),
        "value_proxy": lambda: portfolio.value_proxy(w.by_month, w.entities, w.periods, w.catalogue),
        "propensity_dataset": lambda: features.propensity_dataset(w.stg, tables.TARGET, tables.EV_SPLITS),
        "point_metrics": lambda: evaluation.point_metrics(scores),
        "lift_table": lambda: evaluation.lift_table(scores),
        "cluster_bootstrap": lambda: evaluation.cluster_bootstrap(scores, "customer_id"),
    }
    for name, plan in queries.items():
        drain(plan())
        times[name] = statistics.median(seconds(lambda: drain(plan())) for _ in range(RUNS))
    times = {name: round(value, 4) for name, value in times.items()}
    print(
        json.dumps(
            {
                "metric": "panel_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "rows": rows,
                # only of the lines that read the copied rows
                "rows_per_second": {name: round(rows / value) for name, value in times.items() if value and name not in OTHER_ROWS},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

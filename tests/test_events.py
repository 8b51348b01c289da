from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from panelmill.operators import events, pairs
from tests import planted


def keys(df, *names):
    return {tuple(row[name] for name in names) for row in df.collect()}


def test_planted_events(changes):
    found = events.product_events(changes)
    assert keys(found.filter("event_type = 'adoption'"), "customer_id", "month_index", "product_code") == planted.ADOPTIONS
    assert keys(found.filter("event_type = 'attrition'"), "customer_id", "month_index", "product_code") == planted.ATTRITIONS
    assert keys(found.filter("adoption_kind = 'repeat'"), "customer_id", "month_index", "product_code") == planted.REPEATS
    assert found.filter("event_type = 'attrition' AND adoption_kind IS NOT NULL").isEmpty()


def test_planted_gap_is_no_event(changes):
    gaps = events.changes_across_gaps(changes)
    assert keys(gaps, "customer_id", "month_index", "months_since_previous", "product_code", "change_type") == planted.GAP_CHANGES
    assert events.product_events(changes).filter("customer_id = 3").isEmpty()


def test_summary_grid_and_totals(warehouse, changes):
    summary = events.event_summary(changes, warehouse.periods, planted.CATALOGUE)
    assert summary.count() == 5 * 24
    totals = events.event_totals(summary).first()
    assert (totals["adoptions"], totals["first_adoptions"], totals["repeat_adoptions"]) == (9, 8, 1)
    assert (totals["attritions"], totals["changes_across_gaps"]) == (2, 1)
    assert abs(totals["repeat_share"] - 1 / 9) < 1e-12
    top = events.events_by_product(summary, 2).collect()
    assert [(row["product_name"], row["first_adoptions"]) for row in top] == [("E-account", 3), ("Credit card", 2)]


def test_no_event_without_both_snapshots(warehouse, changes):
    """Every event's customer is present in the period and in the one before."""
    seen = warehouse.fact.select("customer_id", "month_index")
    found = events.product_events(changes)
    before = found.withColumn("month_index", F.col("month_index") - 1)
    assert found.join(seen, ["customer_id", "month_index"], "left_anti").isEmpty()
    assert before.join(seen, ["customer_id", "month_index"], "left_anti").isEmpty()


def brute_force(rows):
    """rows: (customer, month, (flags...)). Returns changes as (customer, month, since, flag, delta)."""
    out = []
    ordered = sorted(rows)
    for one, two in itertools.pairwise(ordered):
        if one[0] == two[0]:
            for place, (old, new) in enumerate(zip(one[2], two[2], strict=True)):
                if old is not None and new is not None and old != new:
                    out.append((two[0], two[1], two[1] - one[1], f"ind_{place}_ult1", new - old))
    return sorted(out)


def test_changes_against_brute_force(spark):
    """Gaps, NULL flags and flags out of range, against a row-by-row walk."""
    rng = random.Random(5)
    rows = []
    for customer in range(60):
        for month in sorted(rng.sample(range(12), rng.randint(1, 12))):
            rows.append((customer, month, tuple(rng.choice([0, 0, 1, 1, 1, 2, None]) for _ in range(3))))
    schema = "customer_id bigint, month_index int, ind_0_ult1 tinyint, ind_1_ult1 tinyint, ind_2_ult1 tinyint"
    df = spark.createDataFrame([(c, m, *flags) for c, m, flags in rows], schema)
    found = events.flag_changes(df)
    assert sorted(tuple(row) for row in found.collect()) == brute_force(rows)
    first_drop = {}
    for customer, month, _, flag, delta in brute_force(rows):
        if delta == -1:
            first_drop.setdefault((customer, flag), month)
    expected = set()
    for customer, month, since, flag, delta in brute_force(rows):
        if since == 1:
            repeat = first_drop.get((customer, flag), 99) < month
            kind = None if delta == -1 else "repeat" if repeat else "first"
            expected.add((customer, month, flag, "adoption" if delta == 1 else "attrition", kind))
    assert keys(events.product_events(found), *events.product_events(found).columns) == expected


def test_one_exchange_per_entity(warehouse):
    """Changes, kinds and the earliest drop share one shuffle by entity, and need none where the fact is bucketed by it."""
    for fact, exchanges in ((warehouse.fact, 0), (warehouse.fact.repartition(4), 1)):
        plan = events.product_events(events.flag_changes(fact))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == exchanges and "Join" not in text


def test_pairs_agree_on_the_planted_file(warehouse):
    joined, windowed = pairs.events_by_self_join(warehouse.fact), pairs.events_by_window(warehouse.fact)
    assert pairs.result_difference(joined, windowed).isEmpty()
    counts = {row["product_code"]: (row["adoptions"], row["attritions"]) for row in windowed.collect()}
    assert counts[planted.E_ACCOUNT] == (4, 2) and counts[planted.DEBIT] == (1, 0)

    by_join = pairs.running_active_by_range_join(warehouse.fact)
    by_window = pairs.running_active_by_window(warehouse.fact)
    assert pairs.result_difference(by_join, by_window).isEmpty()
    assert by_window.filter("active_months_so_far = 0").first()["customer_months"] == 6


def test_summary_pair_and_snapshot_pair(spark, warehouse, tmp_path):
    path = str(tmp_path / "summary")
    pairs.entity_summary(warehouse.fact).write.parquet(path)
    one = pairs.summary_by_breadth(pairs.entity_summary(warehouse.fact))
    other = pairs.summary_by_breadth(spark.read.parquet(path))
    assert pairs.result_difference(one, other).isEmpty()
    assert one.agg(F.sum("customers")).first()[0] == 40

    rows = warehouse.stg.withColumn("month", F.date_format("snapshot_date", "yyyy-MM"))
    months = str(tmp_path / "months")
    rows.write.partitionBy("month").parquet(months)
    full = pairs.snapshot_full_scan(warehouse.stg, "2015-06", planted.CARD)
    pruned = pairs.snapshot_pruned(spark.read.parquet(months), "2015-06", planted.CARD)
    assert tuple(full.first()) == tuple(pruned.first()) == (39, 2)


def test_difference_is_noticed(spark):
    one = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.1)], "k string, n int, x double")
    same = spark.createDataFrame([("a", 1, 0.1 + 1e-9), ("a", 1, 0.1)], "k string, n bigint, x double")
    other = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.1)], "k string, n int, x double")
    assert pairs.result_difference(one, same).isEmpty()
    assert {row["only_in"] for row in pairs.result_difference(one, other).collect()} == {"left", "right"}
    assert pairs.result_difference(one, other.filter("n = 1")).count() == 1


def test_timing_statistics(spark):
    runs = [("p", "baseline", s) for s in (4.0, 5.0, 9.0)] + [("p", "candidate", s) for s in (1.0, 1.0, 3.0)]
    runs += [("p", "build", 8.0), ("q", "baseline", 1.0), ("q", "candidate", 2.0)]
    found = {r["pair"]: r for r in pairs.timing_statistics(spark.createDataFrame(runs, "pair string, role string, seconds double")).collect()}
    assert (found["p"]["faster"], found["p"]["ratio"], found["p"]["break_even_queries"]) == ("candidate", 5.0, 2.0)
    assert (found["q"]["faster"], found["q"]["ratio"], found["q"]["break_even_queries"]) == ("baseline", 2.0, None)

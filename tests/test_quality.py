from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelmill.operators import quality
from panelmill.operators.warehouse import dim_entity, dim_period, fact_panel
from tests import planted

EXPECTED = {
    "duplicate_key": ("critical", "pass", 0),
    "invalid_flags": ("critical", "pass", 0),
    "row_reconcile": ("critical", "pass", 0),
    "age_range": ("warning", "warn", 6),
    "income_range": ("warning", "pass", 0),
    "entity_gaps": ("warning", "warn", 1),
    "filled_flags": ("warning", "warn", 1),
    "missing_join_date": ("warning", "warn", 1),
    "filled_summary": ("profile", "info", 1),
    "row_counts": ("profile", "info", 5),
}


def checks_of(w, stg=None):
    stg = w.stg if stg is None else stg
    return quality.standard_checks(stg, fact_panel(stg), dim_entity(stg), w.products, dim_period(stg))


def test_summary_of_the_planted_file(warehouse):
    summary = quality.require_no_critical(quality.summarise(checks_of(warehouse)))
    found = {row["check_name"]: (row["severity"], row["status"], row["violations"]) for row in summary.collect()}
    assert found.pop("null_counts")[:2] == ("profile", "info")
    assert found == EXPECTED


def test_counts_agree_with_the_violating_rows(warehouse):
    checks = checks_of(warehouse)
    counted = {row["check_name"]: row["violations"] for row in quality.summarise(checks).collect()}
    assert counted == {check.name: check.rows.count() for check in checks}


def test_null_profile(warehouse):
    found = {row["column_name"]: row["null_rows"] for row in quality.null_counts(warehouse.stg).collect()}
    assert (found["income"], found["seniority_months"], found["join_date"]) == (12, 6, 6)
    assert "age" not in found and not set(planted.FLAGS) & set(found)


def test_gap_and_fill_details(warehouse):
    gap = quality.entity_gaps(warehouse.entities).collect()
    assert [(row["customer_id"], row["missing_months"]) for row in gap] == [(3, 1)]
    filled = quality.filled_flags(warehouse.stg).collect()
    assert [(row["customer_id"], row["month_index"], row["flags_filled_from_null"]) for row in filled] == [(12, 1, 2)]
    total = quality.filled_summary(warehouse.stg).first()
    assert (total["flags_filled"], total["rows_affected"], total["total_rows"]) == (2, 1, 235)


def test_critical_failure_comes_after_the_summary(warehouse):
    twice = warehouse.stg.filter("customer_id = 1 AND month_index = 0")
    odd = F.when((F.col("customer_id") == 2) & (F.col("month_index") == 1), 2).otherwise(F.col(planted.CARD))
    broken = warehouse.stg.unionByName(twice).withColumn(planted.CARD, odd.cast("tinyint"))
    summary = quality.summarise(checks_of(warehouse, broken))
    found = {row["check_name"]: row["status"] for row in summary.collect()}
    assert found["duplicate_key"] == "FAIL" and found["invalid_flags"] == "FAIL"
    with pytest.raises(quality.QualityError, match="duplicate_key, invalid_flags"):
        quality.require_no_critical(summary)


def test_lost_fact_rows_are_noticed(warehouse):
    short = quality.row_count_mismatch(
        warehouse.stg, warehouse.fact.filter("month_index < 5"), warehouse.entities, warehouse.periods
    ).collect()
    assert [(row["table_name"], row["actual_rows"], row["expected_rows"]) for row in short] == [
        ("fact_monthly_holdings", 196, 235)
    ]


def test_severity_is_checked(warehouse):
    with pytest.raises(ValueError):
        quality.Check("x", "fatal", "", warehouse.stg)

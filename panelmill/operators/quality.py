"""Data-quality checks. A check is a DataFrame of violating rows with a severity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import count_where, row_max, row_min
from panelmill.operators.staging import FILLED
from panelmill.operators.warehouse import table_row_counts
from panelmill.schema import ENTITY, FLAG_PATTERN, PERIOD, flag_columns

SEVERITIES = ("critical", "warning", "profile")
SHOWN_ROWS = 5


class QualityError(Exception):
    """A critical check found violating rows."""


def duplicate_keys(stg: DataFrame) -> DataFrame:
    return stg.groupBy(ENTITY, PERIOD).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def invalid_flags(stg: DataFrame, pattern: str = FLAG_PATTERN) -> DataFrame:
    flags = [F.col(flag) for flag in flag_columns(stg, pattern)]
    return stg.select(
        ENTITY, PERIOD, row_min(flags).alias("lowest_flag"), row_max(flags).alias("highest_flag")
    ).filter("lowest_flag < 0 OR highest_flag > 1")


def row_count_mismatch(stg: DataFrame, fact: DataFrame, entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Star schema tables whose size does not follow from the staging table."""
    # Both keys are counted from the (entity, period) groups, which are combined before the shuffle.
    keys = stg.groupBy(ENTITY, PERIOD).agg(F.count(F.lit(1)).alias("_rows"))
    entities_of = keys.groupBy(ENTITY).agg(F.sum("_rows").alias("_rows")).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("fact_monthly_holdings"), F.count(ENTITY).alias("dim_customer")
    )
    periods_of = stg.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("_rows")).agg(F.count(PERIOD).alias("dim_month"))
    expected = entities_of.unpivot([], ["fact_monthly_holdings", "dim_customer"], "table_name", "expected_rows").unionByName(
        periods_of.unpivot([], ["dim_month"], "table_name", "expected_rows")
    )
    actual = table_row_counts({"fact_monthly_holdings": fact, "dim_customer": entities, "dim_month": periods})
    return (
        actual.join(expected, "table_name")
        .filter("row_count <> expected_rows")
        .select("table_name", F.col("row_count").alias("actual_rows"), "expected_rows")
    )


def _outside(name: str, low: float, high: float) -> Column:
    return (F.col(name) < low) | (F.col(name) > high)


def _missing_periods() -> Column:
    span = F.col("last_seen_month_index") - F.col("first_seen_month_index") + 1
    return span - F.col("months_present")


def age_out_of_range(stg: DataFrame, low: int = 0, high: int = 110) -> DataFrame:
    return stg.filter(_outside("age", low, high)).select(ENTITY, PERIOD, "age")


def income_out_of_range(stg: DataFrame, high: float = 10_000_000) -> DataFrame:
    return stg.filter(_outside("income", 0, high)).select(ENTITY, PERIOD, "income")


def entity_gaps(entities: DataFrame) -> DataFrame:
    return (
        entities.withColumn("missing_months", _missing_periods())
        .filter("missing_months > 0")
        .select(ENTITY, "first_seen_month_index", "last_seen_month_index", "months_present", "missing_months")
    )


def filled_flags(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col(FILLED) > 0).select(ENTITY, PERIOD, FILLED)


def missing_join_date(entities: DataFrame) -> DataFrame:
    return entities.filter("join_date IS NULL").select(ENTITY, "first_seen_month_index", "months_present")


def null_counts(df: DataFrame) -> DataFrame:
    """NULL rows and share of every column that has any, from one pass over the table."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[(F.count(F.lit(1)) - F.count(F.col(name))).alias(name) for name in df.columns],
    )
    return (
        counted.unpivot(["_rows"], df.columns, "column_name", "null_rows")
        .filter("null_rows > 0")
        .select("column_name", "null_rows", F.round(F.col("null_rows") / F.col("_rows"), 6).alias("null_share"))
    )


def filled_summary(stg: DataFrame) -> DataFrame:
    return stg.agg(
        F.coalesce(F.sum(F.col(FILLED).cast("bigint")), F.lit(0)).alias("flags_filled"),
        count_where(F.col(FILLED) > 0).alias("rows_affected"),
        F.count(F.lit(1)).alias("total_rows"),
    )


@dataclass(frozen=True)
class Check:
    """Violating rows with a severity. A check that looks at single rows of a table also names the table and
    the condition, so that a summary can count many such checks in one pass."""

    name: str
    severity: str
    description: str
    rows: DataFrame
    table: DataFrame | None = None
    violates: Column | None = None

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.name}: severity must be one of {SEVERITIES}")


def standard_checks(
    stg: DataFrame,
    fact: DataFrame,
    entities: DataFrame,
    products: DataFrame,
    periods: DataFrame,
    age_range: tuple[int, int] = (0, 110),
    income_max: float = 10_000_000,
) -> list[Check]:
    tables = {
        "stg_holdings": stg,
        "fact_monthly_holdings": fact,
        "dim_customer": entities,
        "dim_product": products,
        "dim_month": periods,
    }
    flags = [F.col(flag) for flag in flag_columns(stg)]
    return [
        Check("duplicate_key", "critical", "An entity has two rows in one period.", duplicate_keys(stg)),
        Check(
            "invalid_flags",
            "critical",
            "A flag is neither 0 nor 1.",
            invalid_flags(stg),
            stg,
            (row_min(flags) < 0) | (row_max(flags) > 1),
        ),
        Check(
            "row_reconcile",
            "critical",
            "The star schema has other row counts than the staging table implies.",
            row_count_mismatch(stg, fact, entities, periods),
        ),
        Check(
            "age_range",
            "warning",
            "Age outside the plausible range.",
            age_out_of_range(stg, *age_range),
            stg,
            _outside("age", *age_range),
        ),
        Check(
            "income_range",
            "warning",
            "Income negative or implausibly high.",
            income_out_of_range(stg, income_max),
            stg,
            _outside("income", 0, income_max),
        ),
        Check(
            "entity_gaps",
            "warning",
            "An entity skips a period between its first and last.",
            entity_gaps(entities),
            entities,
            _missing_periods() > 0,
        ),
        Check(
            "filled_flags",
            "warning",
            "A missing flag was read as 0.",
            filled_flags(stg),
            stg,
            F.col(FILLED) > 0,
        ),
        Check(
            "missing_join_date",
            "warning",
            "An entity never shows a join date.",
            missing_join_date(entities),
            entities,
            F.col("join_date").isNull(),
        ),
        Check("null_counts", "profile", "NULL values per staged column.", null_counts(stg)),
        Check("filled_summary", "profile", "Flags read as 0.", filled_summary(stg)),
        Check("row_counts", "profile", "Rows of every table.", table_row_counts(tables)),
    ]


def summarise(checks: Sequence[Check]) -> DataFrame:
    """Name, severity, status and number of violating rows of every check.

    Row-level checks of a table are counted together in one aggregation of it.
    """
    severity = F.create_map(*[F.lit(text) for check in checks for text in (check.name, check.severity)])
    parts: list[DataFrame] = []
    by_table: dict[int, list[Check]] = {}
    for check in checks:
        if check.violates is None:
            parts.append(check.rows.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(check.name).alias("check_name"), "violations"))
        else:
            by_table.setdefault(id(check.table), []).append(check)
    for group in by_table.values():
        counted = group[0].table.agg(*[count_where(check.violates).alias(check.name) for check in group])
        parts.append(counted.unpivot([], [check.name for check in group], "check_name", "violations"))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    graded = counts.withColumn("severity", severity[F.col("check_name")])
    status = (
        F.when(F.col("severity") == "profile", "info")
        .when(F.col("violations") == 0, "pass")
        .when(F.col("severity") == "critical", "FAIL")
        .otherwise("warn")
    )
    return graded.select("check_name", "severity", status.alias("status"), "violations")


def first_violations(check: Check, order: Sequence[str] | None = None, rows: int = SHOWN_ROWS) -> DataFrame:
    """The first few violating rows, for a report."""
    return check.rows.orderBy(*(order or check.rows.columns)).limit(rows)


def require_no_critical(summary: DataFrame) -> DataFrame:
    """Raise after the whole summary is known; returns it unchanged otherwise. One row per check."""
    failed = [row["check_name"] for row in summary.filter("status = 'FAIL'").orderBy("check_name").collect()]
    if failed:
        raise QualityError(f"critical checks failed: {', '.join(failed)}")
    return summary

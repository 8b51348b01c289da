"""Staging, star schema and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.oracle_base import EV, PRODUCTS, STG
from checks.registry import query, rounded
from checks.tables import (

    ev_panel,
    ev_warehouse,
    raw_panel,
    stg_panel,
    table,
)
from panelmill.operators import quality, staging, warehouse

STG_COLUMNS = """snapshot_date, month_index, customer_id, employee_index, country, sex, age, join_date, is_new_customer,
  seniority_months, primary_status, last_primary_date, customer_type, relation_type, is_resident, is_foreign_born,
  is_employee_spouse, channel, is_deceased, address_type, province_code, province_name, is_active, round(income, 6) AS income,
  income_missing, segment"""


@query("stg_clean", f"WITH {STG} SELECT {STG_COLUMNS} FROM stg")
def stg_clean(spark, sf):
    stg = stg_panel(spark, sf)
    return rounded(stg.select(*[name for name in stg.columns if not name.startswith("ind_") and name != staging.FILLED]))


@query(
    "stg_month_index",
    """SELECT o_orderkey, ((CAST(year(o_orderdate) AS INTEGER) * 12 + month(o_orderdate)) - (1995 * 12 + 1))::INTEGER
       AS month_index FROM orders""",
)
def stg_month_index(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        staging.month_index(F.col("o_orderdate").cast("date"), dt.date(1995, 1, 31)).alias("month_index"),
    )


@query(
    "stg_flag_fill",
    f"""WITH {STG} SELECT customer_id, month_index, flags_filled_from_null, ind_view_ult1, ind_click_ult1, ind_signup_ult1,
        ind_purchase_ult1, ind_error_ult1 FROM stg""",
)
def stg_flag_fill(spark, sf):
    raw = raw_panel(spark, sf)
    keyed = raw.select(
        F.col("ncodpers").alias("customer_id"),
        staging.month_index(F.col("fecha_dato"), dt.date(2015, 1, 1)).alias("month_index"),
        *[name for name in raw.columns if name.endswith("_ult1")],
    )
    return staging.fill_flags(keyed)


@query("dim_entity", f"WITH {STG} SELECT * REPLACE (round(income, 6) AS income) FROM dimc")
def dim_entity(spark, sf):
    return rounded(warehouse.dim_entity(stg_panel(spark, sf)))


@query(
    "dim_product",
    """WITH seen AS (SELECT event_type AS kind, min(event_id) AS first_id FROM events GROUP BY 1)
       SELECT 'ind_' || kind || '_ult1' AS product_code, kind AS product_name, 'events' AS family,
         CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END::INTEGER AS ladder_step,
         CASE kind WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' WHEN 'signup' THEN 'Sign up' WHEN 'purchase' THEN 'Buy' END
           AS ladder_step_name,
         (row_number() OVER (ORDER BY kind))::INTEGER AS catalogue_order
       FROM seen""",
)
def dim_product(spark, sf):
    from panelmill.schema import Catalogue, LadderStep, Product

    kinds = [row["event_type"] for row in table(spark, sf, "events").select("event_type").distinct().collect()]
    steps = (("View", "view"), ("Click", "click"), ("Sign up", "signup"), ("Buy", "purchase"))
    catalogue = Catalogue(
        tuple(Product(f"ind_{kind}_ult1", kind, "events") for kind in sorted(kinds)),
        tuple(LadderStep(name, (f"ind_{kind}_ult1",)) for name, kind in steps),
    )
    return warehouse.dim_product(spark, catalogue)


@query("dim_period", f"WITH {STG} SELECT * FROM dimm")
def dim_period(spark, sf):
    return warehouse.dim_period(stg_panel(spark, sf))


@query("fact_panel", f"WITH {STG} SELECT * FROM fact")
def fact_panel(spark, sf):
    return warehouse.fact_panel(stg_panel(spark, sf))


ROW_COUNTS = f"""WITH {STG}, {PRODUCTS}
  SELECT 'stg_holdings' AS table_name, (SELECT count(*) FROM ev) AS row_count
  UNION ALL SELECT 'fact_monthly_holdings', (SELECT count(*) FROM ev)
  UNION ALL SELECT 'dim_customer', (SELECT count(DISTINCT user_id) FROM events)
  UNION ALL SELECT 'dim_product', (SELECT count(*) FROM prod)
  UNION ALL SELECT 'dim_month', (SELECT count(DISTINCT ts::DATE) FROM events)"""


@query("table_row_counts_build", ROW_COUNTS)
def table_row_counts_build(spark, sf):
    return ev_warehouse(spark, sf).row_counts()


@query("p_row_counts", ROW_COUNTS)
def p_row_counts(spark, sf):
    return warehouse.table_row_counts(ev_warehouse(spark, sf).tables())


@query(
    "q_duplicate_key",
    """SELECT l_orderkey AS customer_id, l_linenumber AS month_index, count(*) AS row_count FROM lineitem
       GROUP BY ALL HAVING count(*) > 1""",
)
def q_duplicate_key(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("customer_id"), F.col("l_linenumber").alias("month_index")
    )
    return quality.duplicate_keys(rows)


@query(
    "q_invalid_flags",
    f"""WITH {EV}, odd AS (
      SELECT customer_id, month_index, (ind_view_ult1 + n_events // 5)::TINYINT AS a,
        (ind_error_ult1 - (customer_id % 50 = 0)::INTEGER)::TINYINT AS b FROM ev)
    SELECT customer_id, month_index, least(a, b) AS lowest_flag, greatest(a, b) AS highest_flag FROM odd
    WHERE a NOT IN (0, 1) OR b NOT IN (0, 1)""",
)
def q_invalid_flags(spark, sf):
    rows = ev_panel(spark, sf).select(
        "customer_id",
        "month_index",
        (F.col("ind_view_ult1") + F.floor(F.col("n_events") / 5)).cast("tinyint").alias("ind_view_ult1"),
        (F.col("ind_error_ult1") - (F.col("customer_id") % 50 == 0).cast("int")).cast("tinyint").alias("ind_error_ult1"),
    )
    return quality.invalid_flags(rows)


@query(
    "q_row_reconcile",
    f"""WITH {EV} SELECT 'fact_monthly_holdings' AS table_name, count(*) - 0 AS actual_rows, (SELECT count(*) FROM ev) AS expected_rows
        FROM ev WHERE ind_view_ult1 = 1 HAVING count(*) <> (SELECT count(*) FROM ev)
        UNION ALL SELECT 'dim_month', count(DISTINCT month_index), (SELECT count(DISTINCT month_index) FROM ev)
        FROM ev WHERE month_index % 2 = 0 HAVING count(DISTINCT month_index) <> (SELECT count(DISTINCT month_index) FROM ev)""",
)
def q_row_reconcile(spark, sf):
    """The fact has lost the rows without a view, the months every second one; the entities are whole."""
    tables = ev_warehouse(spark, sf)
    return quality.row_count_mismatch(
        tables.stg,
        tables.fact.filter("ind_view_ult1 = 1"),
        tables.entities,
        tables.periods.filter("month_index % 2 = 0"),
    )


@query(
    "q_age_range",
    f"WITH {STG} SELECT customer_id, month_index, age FROM stg WHERE NOT (age BETWEEN 20 AND 100)",
)
def q_age_range(spark, sf):
    return quality.age_out_of_range(stg_panel(spark, sf), 20, 100)


@query(
    "q_income_range",
    """SELECT c_custkey AS customer_id, 0 AS month_index, c_acctbal AS income FROM customer
       WHERE c_acctbal < 0 OR c_acctbal > 9000""",
)
def q_income_range(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.lit(0).alias("month_index"), F.col("c_acctbal").alias("income")
    )
    return quality.income_out_of_range(rows, 9000)


@query(
    "q_entity_gaps",
    f"""WITH {EV}, own AS (SELECT customer_id, min(month_index) AS a, max(month_index) AS b, count(*) AS n FROM ev GROUP BY 1)
    SELECT customer_id, a AS first_seen_month_index, b AS last_seen_month_index, n AS months_present,
      (b - a + 1 - n)::BIGINT AS missing_months FROM own WHERE b - a + 1 <> n""",
)
def q_entity_gaps(spark, sf):
    return quality.entity_gaps(ev_warehouse(spark, sf).entities)


@query(
    "q_filled_flags",
    f"WITH {STG} SELECT customer_id, month_index, flags_filled_from_null FROM stg WHERE flags_filled_from_null >= 1",
)
def q_filled_flags(spark, sf):
    return quality.filled_flags(stg_panel(spark, sf))


@query(
    "q_missing_join_date",
    f"""WITH {STG} SELECT customer_id, min(month_index) AS first_seen_month_index, count(*) AS months_present FROM stg
        GROUP BY 1 HAVING count(join_date) = 0""",
)
def q_missing_join_date(spark, sf):
    return quality.missing_join_date(ev_warehouse(spark, sf).entities)


NULLABLE = (
    "employee_index sex age join_date seniority_months last_primary_date customer_type relation_type is_resident "
    "is_employee_spouse channel address_type is_active income segment"
).split()
NULL_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, count(*) FILTER (WHERE {name} IS NULL) AS null_rows, "
    f"round(avg(({name} IS NULL)::INTEGER), 6) AS null_share FROM stg HAVING bool_or({name} IS NULL)"
    for name in NULLABLE
)


@query("p_null_counts", f"WITH {STG} {NULL_COUNTS}")
def p_null_counts(spark, sf):
    return quality.null_counts(stg_panel(spark, sf))


@query(
    "p_filled_summary",
    f"""WITH {STG} SELECT sum(flags_filled_from_null)::BIGINT AS flags_filled,
        sum(CASE WHEN flags_filled_from_null > 0 THEN 1 ELSE 0 END)::BIGINT AS rows_affected, count(*) AS total_rows FROM stg""",
)
def p_filled_summary(spark, sf):
    return quality.filled_summary(stg_panel(spark, sf))


@query(
    "quality_summary",
    f"""WITH {STG}, {PRODUCTS}, found(check_name, severity, violations) AS (
      SELECT 'duplicate_key', 'critical', (SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY customer_id, month_index HAVING count(*) > 1))
      UNION ALL SELECT 'invalid_flags', 'critical', 0
      UNION ALL SELECT 'row_reconcile', 'critical', 0
      UNION ALL SELECT 'age_range', 'warning', (SELECT count(*) FROM stg WHERE age < 0 OR age > 110)
      UNION ALL SELECT 'income_range', 'warning', (SELECT count(*) FROM stg WHERE income < 0 OR income > 9000)
      UNION ALL SELECT 'entity_gaps', 'warning', (SELECT count(*) FROM (
        SELECT 1 FROM ev GROUP BY customer_id HAVING max(month_index) - min(month_index) + 1 > count(*)))
      UNION ALL SELECT 'filled_flags', 'warning', (SELECT count(*) FROM stg WHERE flags_filled_from_null > 0)
      UNION ALL SELECT 'missing_join_date', 'warning', (SELECT count(*) FROM dimc WHERE join_date IS NULL)
      UNION ALL SELECT 'null_counts', 'profile', (SELECT count(*) FROM ({NULL_COUNTS}))
      UNION ALL SELECT 'filled_summary', 'profile', 1
      UNION ALL SELECT 'row_counts', 'profile', 5)
    SELECT check_name, severity, violations, CASE WHEN severity = 'profile' THEN 'info' WHEN violations = 0 THEN 'pass'
      WHEN severity = 'critical' THEN 'FAIL' ELSE 'warn' END AS status FROM found""",
)
def quality_summary(spark, sf):
    tables = ev_warehouse(spark, sf)
    checks = quality.standard_checks(
        tables.stg, tables.fact, tables.entities, tables.products, tables.periods, income_max=9000
    )
    return quality.summarise(checks)


@query(
    "quality_first_violations",
    f"""WITH {STG} SELECT customer_id, month_index, round(income, 6) AS income FROM stg WHERE income > 9000 OR income < 0
        ORDER BY income DESC, customer_id, month_index LIMIT 5""",
)
def quality_first_violations(spark, sf):
    check = quality.Check("income_range", "warning", "Income too high.", quality.income_out_of_range(stg_panel(spark, sf), 9000))
    return rounded(quality.first_violations(check, [F.desc("income"), "customer_id", "month_index"]))



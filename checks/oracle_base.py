"""SQL building blocks of the answers: the same panels, written as typed values directly."""

from __future__ import annotations

EV = """
ev AS (
  SELECT user_id AS customer_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS month_index,
    max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::TINYINT AS ind_view_ult1,
    max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::TINYINT AS ind_click_ult1,
    max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)::TINYINT AS ind_signup_ult1,
    max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::TINYINT AS ind_purchase_ult1,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::TINYINT AS ind_error_ult1,
    count(*) AS n_events
  FROM events GROUP BY 1, 2)"""

_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
OR = (
    """
orl AS (
  SELECT o_custkey AS customer_id, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER AS month_index,
    p_type, p_brand
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
orp AS (
  SELECT customer_id, month_index, """
    + ", ".join(f"bool_or(p_type = '{t}')::TINYINT AS ind_{t.lower()}_ult1" for t in _TYPES)
    + """
  FROM orl GROUP BY 1, 2),
brp AS (
  SELECT customer_id, month_index, """
    + ", ".join(f"bool_or(p_brand = 'Brand#{n}')::TINYINT AS ind_brand{n:02d}_ult1" for n in range(1, 26))
    + """
  FROM orl GROUP BY 1, 2)"""
)

EV_FLAGS = ("ind_view_ult1", "ind_click_ult1", "ind_signup_ult1", "ind_purchase_ult1", "ind_error_ult1")
OR_FLAGS = tuple(f"ind_{t.lower()}_ult1" for t in _TYPES)
BRAND_FLAGS = tuple(f"ind_brand{n:02d}_ult1" for n in range(1, 26))

# What staging must give for the raw text, written as values, not as cleaning rules.
STG = (
    EV
    + """,
stg AS (
  SELECT (DATE '2015-01-28' + to_months(month_index))::DATE AS snapshot_date, month_index, customer_id,
    CASE WHEN customer_id % 23 = 0 THEN NULL WHEN customer_id % 10 = 0 THEN 'F' ELSE 'N' END AS employee_index,
    CASE WHEN customer_id % 7 = 0 THEN n_name ELSE 'ES' END AS country,
    CASE WHEN customer_id % 31 = 0 THEN NULL WHEN customer_id % 2 = 1 THEN 'H' ELSE 'V' END AS sex,
    CASE WHEN customer_id % 37 <> 0 THEN (18 + customer_id % 95 + month_index // 12)::INTEGER END AS age,
    CASE WHEN customer_id % 31 <> 5 AND customer_id % 41 <> 3
         THEN DATE '2014-03-05' + ((customer_id % 50) * 15)::INTEGER END AS join_date,
    CASE WHEN month_index < 6 AND customer_id % 5 = 0 THEN 1 ELSE 0 END::TINYINT AS is_new_customer,
    CASE WHEN customer_id % 19 <> 0 THEN (customer_id % 150 + month_index)::INTEGER END AS seniority_months,
    CASE WHEN customer_id % 11 = 0 THEN 99 ELSE 1 END::TINYINT AS primary_status,
    CASE WHEN customer_id % 13 = 0 THEN DATE '2015-07-01' + month_index END AS last_primary_date,
    CASE (customer_id + month_index) % 7 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN 'P'
         WHEN 4 THEN '3' WHEN 6 THEN 'P' END AS customer_type,
    CASE WHEN (customer_id + month_index) % 43 = 0 THEN NULL WHEN n_events >= 2 THEN 'A' ELSE 'I' END AS relation_type,
    CASE WHEN customer_id % 47 <> 0 THEN customer_id % 9 <> 0 END AS is_resident,
    customer_id % 8 = 0 AS is_foreign_born,
    CASE WHEN customer_id % 10 = 0 THEN FALSE END AS is_employee_spouse,
    CASE WHEN customer_id % 29 <> 0 THEN n_name END AS channel,
    customer_id % 97 = 0 AS is_deceased,
    CASE WHEN customer_id % 29 <> 1 THEN 1 END::TINYINT AS address_type,
    (c_nationkey + 1)::INTEGER AS province_code,
    'CITY, ' || c_nationkey AS province_name,
    CASE WHEN (customer_id + month_index) % 29 = 0 THEN NULL WHEN n_events >= 2 THEN 1 ELSE 0 END::TINYINT AS is_active,
    CASE WHEN customer_id % 12 <> 0 THEN abs(c_acctbal) END AS income,
    customer_id % 12 = 0 AS income_missing,
    CASE WHEN customer_id % 17 <> 0 THEN c_mktsegment END AS segment,
    (((customer_id + 2 * month_index) % 33 = 0)::INTEGER + ((3 * customer_id + month_index) % 25 = 0)::INTEGER)::TINYINT
      AS flags_filled_from_null,
    ind_view_ult1, ind_click_ult1, ind_signup_ult1,
    CASE WHEN (customer_id + 2 * month_index) % 33 = 0 THEN 0 ELSE ind_purchase_ult1 END::TINYINT AS ind_purchase_ult1,
    CASE WHEN (3 * customer_id + month_index) % 25 = 0 THEN 0 ELSE ind_error_ult1 END::TINYINT AS ind_error_ult1
  FROM ev JOIN customer ON c_custkey = customer_id JOIN nation ON n_nationkey = c_nationkey),
fact AS (
  SELECT customer_id, month_index, ind_view_ult1, ind_click_ult1, ind_signup_ult1, ind_purchase_ult1, ind_error_ult1,
    (ind_view_ult1 + ind_click_ult1 + ind_signup_ult1 + ind_purchase_ult1 + ind_error_ult1)::TINYINT AS n_products,
    is_active, seniority_months, segment, relation_type, is_new_customer
  FROM stg),
latest_of AS (
  SELECT customer_id,
    max(CASE WHEN segment IS NOT NULL THEN month_index END) AS m_segment,
    max(CASE WHEN sex IS NOT NULL THEN month_index END) AS m_sex,
    min(CASE WHEN age IS NOT NULL THEN month_index END) AS m_age,
    max(month_index) AS m_last
  FROM stg GROUP BY 1),
dimc AS (
  SELECT s.customer_id, min(s.join_date) AS join_date, date_trunc('month', min(s.join_date))::DATE AS join_month,
    min(s.month_index) AS first_seen_month_index, max(s.month_index) AS last_seen_month_index,
    count(*) AS months_present,
    max(CASE WHEN s.month_index = l.m_segment THEN s.segment END) AS latest_segment,
    max(CASE WHEN s.month_index = l.m_sex THEN s.sex END) AS sex,
    max(CASE WHEN s.month_index = l.m_age THEN s.age END) AS age_at_first_seen,
    max(CASE WHEN s.month_index = l.m_last THEN s.province_name END) AS province,
    max(CASE WHEN s.month_index = l.m_last THEN s.channel END) AS channel,
    max(CASE WHEN s.month_index = l.m_last THEN s.income END) AS income
  FROM stg s JOIN latest_of l USING (customer_id) GROUP BY 1),
dimm AS (
  SELECT month_index, snapshot_date, strftime(snapshot_date, '%Y-%m') AS month_label, count(*) AS customers
  FROM stg GROUP BY 1, 2)"""
)

PRODUCTS = """
prod AS (
  SELECT * FROM (VALUES
    ('ind_view_ult1', 'Page view', 'browsing', 1, 'Browse', 1),
    ('ind_click_ult1', 'Click', 'browsing', 1, 'Browse', 2),
    ('ind_signup_ult1', 'Sign-up', 'account', 2, 'Sign up', 3),
    ('ind_purchase_ult1', 'Purchase', 'order', 3, 'Buy', 4),
    ('ind_error_ult1', 'Error', 'support', 4, 'Complain', 5))
  AS t(product_code, product_name, family, ladder_step, ladder_step_name, catalogue_order))"""


def long_of(panel: str, flags: tuple[str, ...], name: str) -> str:
    """A panel as one row per flag."""
    parts = " UNION ALL ".join(
        f"SELECT customer_id, month_index, '{flag}' AS product_code, {flag}::INTEGER AS flag FROM {panel}" for flag in flags
    )
    return f"\n{name} AS ({parts})"


def changes_of(panel: str, flags: tuple[str, ...]) -> str:
    """`chg`: per flag the rows that differ from the entity's previous row; `evt`: those one period apart."""
    return (
        long_of(panel, flags, "lng")
        + """,
prv AS (
  SELECT *, month_index - lag(month_index) OVER own AS since, flag - lag(flag) OVER own AS delta
  FROM lng WINDOW own AS (PARTITION BY customer_id, product_code ORDER BY month_index)),
chg AS (SELECT customer_id, month_index, since, product_code, delta FROM prv WHERE delta <> 0),
evt AS (
  SELECT customer_id, month_index, product_code, since,
    CASE WHEN delta = 1 THEN 'adoption' ELSE 'attrition' END AS event_type,
    CASE WHEN delta = 1 THEN
      CASE WHEN EXISTS (SELECT 1 FROM chg d WHERE d.customer_id = c.customer_id AND d.product_code = c.product_code
                          AND d.delta = -1 AND d.month_index < c.month_index)
           THEN 'repeat' ELSE 'first' END END AS adoption_kind
  FROM chg c WHERE since = 1)"""
    )


def wilson(successes: str, trials: str, rate: str) -> str:
    """Two SQL columns with the 95% Wilson bounds."""
    z = "1.959963984540054"
    n, s = f"({trials})::DOUBLE", f"({successes})::DOUBLE"
    mid = f"({s} + {z} * {z} / 2) / ({n} + {z} * {z})"
    half = f"{z} / ({n} + {z} * {z}) * sqrt({s} * ({n} - {s}) / {n} + {z} * {z} / 4)"
    return (
        f"CASE WHEN ({trials}) > 0 THEN round(greatest(0.0, {mid} - {half}), 6) END AS {rate}_ci_lower, "
        f"CASE WHEN ({trials}) > 0 THEN round(least(1.0, {mid} + {half}), 6) END AS {rate}_ci_upper"
    )

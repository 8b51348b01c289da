"""Events, journeys and portfolio views."""

from __future__ import annotations

from checks.oracle_base import BRAND_FLAGS, EV, EV_FLAGS, OR, OR_FLAGS, PRODUCTS, STG, changes_of, long_of, wilson
from checks.registry import query, rounded
from checks.tables import (
    EV_CATALOGUE,
    OR_CATALOGUE,
    RAW_FIRST_MONTH,
    brand_panel,
    ev_panel,
    ev_periods,
    ev_warehouse,
    or_panel,
)
from panelmill.functions.statistics import with_wilson
from panelmill.operators import events as ev_ops
from panelmill.operators import journeys, portfolio
from panelmill.plans.analysis import write_csv
from panelmill.session import scratch_path

EV_CHANGES = f"WITH {EV},{changes_of('ev', EV_FLAGS)}"
OR_CHANGES = f"WITH {OR},{changes_of('orp', OR_FLAGS)}"
STG_CHANGES = f"WITH {STG}, {PRODUCTS},{changes_of('fact', EV_FLAGS)}"

CHANGES = "SELECT customer_id, month_index, since AS months_since_previous, product_code, delta FROM chg"


@query("flag_changes", f"{EV_CHANGES} {CHANGES}")
def flag_changes(spark, sf):
    return ev_ops.flag_changes(ev_panel(spark, sf)).selectExpr(
        "customer_id", "month_index", "months_since_previous", "product_code", "CAST(delta AS INT) AS delta"
    )


@query("flag_changes_wide", f"WITH {OR},{changes_of('brp', BRAND_FLAGS)} {CHANGES}")
def flag_changes_wide(spark, sf):
    return ev_ops.flag_changes(brand_panel(spark, sf)).selectExpr(
        "customer_id", "month_index", "months_since_previous", "product_code", "CAST(delta AS INT) AS delta"
    )


EVENTS = "SELECT customer_id, month_index, product_code, event_type, adoption_kind FROM evt"


@query("product_events", f"{EV_CHANGES} {EVENTS}")
def product_events(spark, sf):
    return ev_ops.product_events(ev_ops.flag_changes(ev_panel(spark, sf)))


@query("product_events_gappy", f"{OR_CHANGES} {EVENTS}")
def product_events_gappy(spark, sf):
    return ev_ops.product_events(ev_ops.flag_changes(or_panel(spark, sf)))


GAPS = """SELECT customer_id, month_index, since AS months_since_previous, product_code,
  CASE WHEN delta > 0 THEN 'adoption' ELSE 'attrition' END AS change_type FROM chg WHERE since > 1"""


@query("changes_across_gaps", f"{EV_CHANGES} {GAPS}")
def changes_across_gaps(spark, sf):
    return ev_ops.changes_across_gaps(ev_ops.flag_changes(ev_panel(spark, sf)))


@query("changes_across_gaps_gappy", f"{OR_CHANGES} {GAPS}")
def changes_across_gaps_gappy(spark, sf):
    return ev_ops.changes_across_gaps(ev_ops.flag_changes(or_panel(spark, sf)))


SUMMARY = """smr AS (
  SELECT strftime(DATE '2024-01-01' + d.month_index, '%Y-%m-%d') AS month_label, p.product_code, p.product_name,
    (SELECT count(*) FROM evt e WHERE e.month_index = d.month_index AND e.product_code = p.product_code
       AND e.event_type = 'adoption') AS adoptions,
    (SELECT count(*) FROM evt e WHERE e.month_index = d.month_index AND e.product_code = p.product_code
       AND e.adoption_kind = 'first') AS first_adoptions,
    (SELECT count(*) FROM evt e WHERE e.month_index = d.month_index AND e.product_code = p.product_code
       AND e.adoption_kind = 'repeat') AS repeat_adoptions,
    (SELECT count(*) FROM evt e WHERE e.month_index = d.month_index AND e.product_code = p.product_code
       AND e.event_type = 'attrition') AS attritions,
    (SELECT count(*) FROM chg c WHERE c.month_index = d.month_index AND c.product_code = p.product_code
       AND c.since > 1) AS changes_across_gaps
  FROM (SELECT DISTINCT month_index FROM ev WHERE month_index > 0) d CROSS JOIN prod p)"""


def _summary(spark, sf):
    panel = ev_panel(spark, sf)
    return ev_ops.event_summary(ev_ops.flag_changes(panel), ev_periods(panel), EV_CATALOGUE)


EV_SUMMARY = f"{EV_CHANGES}, {PRODUCTS}, {SUMMARY}"


@query("event_summary", f"{EV_SUMMARY} SELECT * FROM smr")
def event_summary(spark, sf):
    return _summary(spark, sf)


@query(
    "event_totals",
    f"""{EV_SUMMARY} SELECT sum(adoptions)::BIGINT AS adoptions, sum(first_adoptions)::BIGINT AS first_adoptions,
      sum(repeat_adoptions)::BIGINT AS repeat_adoptions, sum(attritions)::BIGINT AS attritions,
      sum(changes_across_gaps)::BIGINT AS changes_across_gaps,
      round(sum(repeat_adoptions) / sum(adoptions), 6) AS repeat_share FROM smr""",
)
def event_totals(spark, sf):
    return rounded(ev_ops.event_totals(_summary(spark, sf)))


@query(
    "events_by_product",
    f"""{EV_SUMMARY} SELECT product_name, sum(adoptions)::BIGINT AS adoptions, sum(first_adoptions)::BIGINT AS first_adoptions,
      sum(repeat_adoptions)::BIGINT AS repeat_adoptions, sum(attritions)::BIGINT AS attritions FROM smr GROUP BY 1
      ORDER BY 3 DESC, 1 LIMIT 3""",
)
def events_by_product(spark, sf):
    return ev_ops.events_by_product(_summary(spark, sf), 3)


PENETRATION = (
    f"WITH {EV},{long_of('ev', EV_FLAGS, 'lng')}, {PRODUCTS}, "
    + """pen AS (
  SELECT strftime(DATE '2024-01-01' + month_index, '%Y-%m-%d') AS month_label, product_code, product_name, family,
    sum(flag)::BIGINT AS holders, count(*) AS customers, round(avg(flag), 6) AS penetration
  FROM lng JOIN prod USING (product_code) GROUP BY 1, 2, 3, 4)"""
)


def _penetration(spark, sf):
    panel = ev_panel(spark, sf)
    return portfolio.penetration(panel, ev_periods(panel), EV_CATALOGUE)


@query("penetration", f"{PENETRATION} SELECT *, {wilson('holders', 'customers', 'penetration')} FROM pen")
def penetration(spark, sf):
    return rounded(with_wilson(_penetration(spark, sf), "holders", "customers", "penetration"))


@query(
    "penetration_latest",
    f"""{PENETRATION} SELECT month_label, product_name, family, holders, customers, penetration FROM pen
        WHERE month_label = '2024-01-30'""",
)
def penetration_latest(spark, sf):
    return rounded(portfolio.penetration_latest(_penetration(spark, sf)))


TRANSITIONS = """fst AS (SELECT customer_id, month_index, product_code FROM evt WHERE adoption_kind = 'first'),
trn AS (
  SELECT a.product_code AS from_product, b.product_code AS to_product, b.customer_id, b.month_index - a.month_index AS gap
  FROM fst b JOIN fst a ON a.customer_id = b.customer_id AND a.product_code <> b.product_code
    AND a.month_index = (SELECT max(x.month_index) FROM fst x WHERE x.customer_id = b.customer_id AND x.month_index < b.month_index)),
tot AS (SELECT from_product, count(*) AS n FROM trn GROUP BY 1),
tra AS (
  SELECT t.from_product, f.product_name AS from_name, t.to_product, g.product_name AS to_name,
    count(DISTINCT t.customer_id) AS customers, count(*) AS transitions, median(t.gap)::DOUBLE AS median_months_between,
    round(count(*) / max(tot.n), 6) AS share_of_from
  FROM trn t JOIN tot USING (from_product) JOIN prod f ON f.product_code = t.from_product
    JOIN prod g ON g.product_code = t.to_product GROUP BY 1, 2, 3, 4)"""
OR_PRODUCTS = (
    "prod AS (SELECT * FROM (VALUES "
    + ", ".join(f"('ind_{t.lower()}_ult1', '{t.title()}')" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + ") AS t(product_code, product_name))"
)


def _transitions(spark, sf):
    return journeys.transitions(ev_ops.product_events(ev_ops.flag_changes(ev_panel(spark, sf))), EV_CATALOGUE)


EV_TRANSITIONS = f"{EV_CHANGES}, {PRODUCTS}, {TRANSITIONS}"


@query("transitions", f"{EV_TRANSITIONS} SELECT * FROM tra")
def transitions(spark, sf):
    return rounded(_transitions(spark, sf))


@query("transitions_gappy", f"{OR_CHANGES}, {OR_PRODUCTS}, {TRANSITIONS} SELECT * FROM tra")
def transitions_gappy(spark, sf):
    changes = ev_ops.flag_changes(or_panel(spark, sf))
    return rounded(journeys.transitions(ev_ops.product_events(changes), OR_CATALOGUE))


@query("top_transitions", f"{EV_TRANSITIONS} SELECT * FROM tra ORDER BY transitions DESC, from_product, to_product LIMIT 10")
def top_transitions(spark, sf):
    return rounded(journeys.top_transitions(_transitions(spark, sf)))


LADDER = """stp AS (SELECT DISTINCT ladder_step AS step, ladder_step_name AS step_name FROM prod),
hld AS (SELECT DISTINCT customer_id, ladder_step AS step, month_index FROM lng JOIN prod USING (product_code) WHERE flag = 1),
r1 AS (SELECT customer_id, min(month_index) AS m FROM hld WHERE step = 1 GROUP BY 1),
r2 AS (SELECT h.customer_id, min(h.month_index) AS m FROM hld h, r1 r
  WHERE h.customer_id = r.customer_id AND h.step = 2 AND h.month_index >= r.m GROUP BY 1),
r3 AS (SELECT h.customer_id, min(h.month_index) AS m FROM hld h, r2 r
  WHERE h.customer_id = r.customer_id AND h.step = 3 AND h.month_index >= r.m GROUP BY 1),
r4 AS (SELECT h.customer_id, min(h.month_index) AS m FROM hld h, r3 r
  WHERE h.customer_id = r.customer_id AND h.step = 4 AND h.month_index >= r.m GROUP BY 1),
rch AS (SELECT customer_id, 1 AS step FROM r1 UNION ALL SELECT customer_id, 2 FROM r2
  UNION ALL SELECT customer_id, 3 FROM r3 UNION ALL SELECT customer_id, 4 FROM r4),
chn AS (SELECT channel, row_number() OVER (ORDER BY count(*) DESC, channel) AS place FROM dimc WHERE channel IS NOT NULL GROUP BY 1),
grp AS (
  SELECT customer_id, 1 AS dimension_order, 'all' AS dimension, 'all' AS group_value FROM dimc
  UNION ALL SELECT customer_id, 2, 'segment', coalesce(latest_segment, 'unknown') FROM dimc
  UNION ALL SELECT customer_id, 3, 'channel',
    CASE WHEN d.channel IS NULL THEN 'unknown' WHEN c.place <= 10 THEN d.channel ELSE 'other' END
  FROM dimc d LEFT JOIN chn c ON c.channel = d.channel)"""
STG_LADDER = f"WITH {STG}, {PRODUCTS},{long_of('fact', EV_FLAGS, 'lng')}, {LADDER}"


@query("ladder_groups", f"{STG_LADDER} SELECT * FROM grp")
def ladder_groups(spark, sf):
    return journeys.entity_groups(ev_warehouse(spark, sf).entities)


@query(
    "ladder_funnel",
    f"""{STG_LADDER}, siz AS (SELECT dimension, group_value, count(*) AS customers FROM grp GROUP BY 1, 2),
    got AS (SELECT s.dimension, s.group_value, s.customers, p.step, p.step_name,
      (SELECT count(*) FROM grp g JOIN rch r ON r.customer_id = g.customer_id
        WHERE g.dimension = s.dimension AND g.group_value = s.group_value AND r.step = p.step) AS reached
      FROM siz s CROSS JOIN stp p),
    fun AS (SELECT *, CASE WHEN step = 1 THEN customers ELSE
        max(reached) OVER (PARTITION BY dimension, group_value ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) END AS previous_reached
      FROM got)
    SELECT dimension, group_value, step, step_name, customers, previous_reached, reached,
      CASE WHEN previous_reached > 0 THEN round(reached / previous_reached, 6) END AS conversion_rate,
      {wilson('reached', 'previous_reached', 'conversion_rate')},
      round(reached / customers, 6) AS reached_share FROM fun""",
)
def ladder_funnel(spark, sf):
    tables = ev_warehouse(spark, sf)
    funnel = journeys.ladder_funnel(tables.fact, tables.entities, EV_CATALOGUE)
    return rounded(with_wilson(funnel, "reached", "previous_reached", "conversion_rate"))


TIMES = """tim AS (
  SELECT min(e.month_index) - min(o.first_seen) AS months_to_first_adoption
  FROM evt e JOIN (SELECT customer_id, min(month_index) AS first_seen FROM ev GROUP BY 1) o USING (customer_id)
  WHERE e.adoption_kind = 'first' GROUP BY e.customer_id),
dst AS (
  SELECT t.months_to_first_adoption, count(*) AS customers,
    round(count(*) / (SELECT count(*) FROM tim), 6) AS share_of_adopters,
    round((SELECT count(*) FROM tim u WHERE u.months_to_first_adoption <= t.months_to_first_adoption) / (SELECT count(*) FROM tim), 6)
      AS cumulative_share,
    (SELECT median(months_to_first_adoption) FROM tim)::DOUBLE AS median_months,
    (SELECT count(DISTINCT customer_id) FROM ev) AS customers_observed
  FROM tim t GROUP BY 1)"""


def _times(spark, sf):
    tables = ev_warehouse(spark, sf)
    return journeys.time_to_next(ev_ops.product_events(ev_ops.flag_changes(ev_panel(spark, sf))), tables.entities)


@query("time_to_next", f"{EV_CHANGES}, {TIMES} SELECT * FROM dst")
def time_to_next(spark, sf):
    return rounded(_times(spark, sf))


@query(
    "adopter_share",
    f"""{EV_CHANGES}, {TIMES} SELECT (SELECT count(*) FROM tim) AS adopters, (SELECT count(DISTINCT customer_id) FROM ev) AS observed,
      round((SELECT count(*) FROM tim) / (SELECT count(DISTINCT customer_id) FROM ev), 6) AS adopter_share,
      (SELECT median(months_to_first_adoption) FROM tim)::DOUBLE AS median_months""",
)
def adopter_share(spark, sf):
    return rounded(journeys.adopter_share(_times(spark, sf)))


COHORTS = f"""WITH {STG},
mem AS (SELECT customer_id, join_month, ((year(join_month) - 2015) * 12 + month(join_month) - 1)::INTEGER AS j FROM dimc
  WHERE join_month >= DATE '2015-01-01'),
coh AS (
  SELECT strftime(m.join_month, '%Y-%m') AS join_month, count(DISTINCT m.customer_id) AS cohort_size, k.month_index AS months_since_join,
    (SELECT count(*) FROM mem x JOIN fact f ON f.customer_id = x.customer_id AND f.n_products > 0
      WHERE x.join_month = m.join_month AND f.month_index = x.j + k.month_index) AS retained
  FROM mem m JOIN dimm k ON m.j + k.month_index <= (SELECT max(month_index) FROM dimm)
  GROUP BY m.join_month, k.month_index)"""


def _cohorts(spark, sf):
    tables = ev_warehouse(spark, sf)
    return journeys.cohort_retention(tables.fact, tables.entities, tables.periods, RAW_FIRST_MONTH)


@query(
    "cohort_retention",
    f"""{COHORTS} SELECT *, round(retained / cohort_size, 6) AS retention_rate, {wilson('retained', 'cohort_size', 'retention_rate')}
        FROM coh""",
)
def cohort_retention(spark, sf):
    return rounded(with_wilson(_cohorts(spark, sf), "retained", "cohort_size", "retention_rate"))


@query(
    "cohort_matrix",
    f"""{COHORTS} SELECT join_month, max(cohort_size) AS cohort_size, """
    + ", ".join(
        f"max(round(retained / cohort_size, 6)) FILTER (WHERE months_since_join = {k}) AS k_{k}" for k in (0, 1, 3, 6, 12)
    )
    + " FROM coh GROUP BY 1",
)
def cohort_matrix(spark, sf):
    return rounded(journeys.cohort_matrix(_cohorts(spark, sf)))


ENGAGEMENT = f"""WITH {STG},
rws AS (
  SELECT f.*, m.month_label, m.month_index = (SELECT max(month_index) FROM dimm) AS now,
    coalesce(segment, 'unknown') AS seg,
    CASE WHEN seniority_months IS NULL THEN 'unknown' WHEN seniority_months >= 120 THEN '120+ months'
      WHEN seniority_months >= 36 THEN '36-119 months' WHEN seniority_months >= 12 THEN '12-35 months' ELSE '00-11 months' END AS band,
    CASE WHEN n_products < 4 THEN n_products::VARCHAR ELSE '4+' END AS held
  FROM fact f JOIN dimm m USING (month_index)),
lab AS (
  SELECT 'month' AS dimension, month_label AS group_value, month_label, is_active FROM rws
  UNION ALL SELECT 'segment', seg, month_label, is_active FROM rws WHERE now
  UNION ALL SELECT 'tenure_band', band, month_label, is_active FROM rws WHERE now
  UNION ALL SELECT 'products_held', held, month_label, is_active FROM rws WHERE now),
eng AS (SELECT dimension, group_value, month_label, count(*) AS customers, count(CASE WHEN is_active = 1 THEN 1 END) AS active
  FROM lab GROUP BY 1, 2, 3)"""


def _engagement(spark, sf):
    tables = ev_warehouse(spark, sf)
    return portfolio.engagement(tables.fact, tables.periods)


@query(
    "engagement",
    f"""{ENGAGEMENT} SELECT *, round(active / customers, 6) AS engagement_rate, {wilson('active', 'customers', 'engagement_rate')}
        FROM eng""",
)
def engagement(spark, sf):
    return rounded(with_wilson(_engagement(spark, sf), "active", "customers", "engagement_rate"))


@query(
    "engagement_trend_ends",
    f"""{ENGAGEMENT}, trd AS (SELECT month_label, round(active / customers, 6) AS rate FROM eng WHERE dimension = 'month')
    SELECT a.month_label AS first_month, a.rate AS first_rate, b.month_label AS last_month, b.rate AS last_rate FROM trd a, trd b
    WHERE a.month_label = (SELECT min(month_label) FROM trd) AND b.month_label = (SELECT max(month_label) FROM trd)""",
)
def engagement_trend_ends(spark, sf):
    return rounded(portfolio.engagement_trend_ends(_engagement(spark, sf)))


VALUES = f"""WITH {STG}, {PRODUCTS},{long_of('fact', EV_FLAGS, 'lng')},
now AS (SELECT * FROM fact WHERE month_index = (SELECT max(month_index) FROM fact)),
fam AS (SELECT customer_id, count(DISTINCT family) AS n FROM lng JOIN prod USING (product_code)
  WHERE flag = 1 AND month_index = (SELECT max(month_index) FROM fact) GROUP BY 1),
qrt AS (SELECT customer_id, 'Q' || ntile(4) OVER (ORDER BY d.income, customer_id) AS band FROM now JOIN dimc d USING (customer_id)
  WHERE d.income IS NOT NULL),
val AS (
  SELECT coalesce(q.band, 'missing') AS income_band,
    CASE n.is_active WHEN 1 THEN 'active' WHEN 0 THEN 'inactive' ELSE 'unknown' END AS activity,
    CASE WHEN coalesce(f.n, 0) < 3 THEN coalesce(f.n, 0)::VARCHAR ELSE '3+' END AS families_held,
    count(*) AS customers, round(count(*) / (SELECT count(*) FROM now), 6) AS share_of_customers,
    round(avg(n.n_products), 6) AS avg_products
  FROM now n LEFT JOIN fam f USING (customer_id) LEFT JOIN qrt q USING (customer_id) GROUP BY 1, 2, 3)"""


def _values(spark, sf):
    tables = ev_warehouse(spark, sf)
    return portfolio.value_proxy(tables.fact, tables.entities, tables.periods, EV_CATALOGUE)


@query("value_proxy", f"{VALUES} SELECT * FROM val")
def value_proxy(spark, sf):
    return rounded(_values(spark, sf))


@query(
    "value_by_dimension",
    f"""{VALUES}, dim AS (SELECT 'families_held' AS dimension, families_held AS group_value, customers FROM val
      UNION ALL SELECT 'income_band', income_band, customers FROM val)
    SELECT dimension, group_value, sum(customers)::BIGINT AS customers,
      round(sum(customers) / (SELECT count(*) FROM now), 6) AS share FROM dim GROUP BY 1, 2""",
)
def value_by_dimension(spark, sf):
    return rounded(portfolio.value_by_dimension(_values(spark, sf)))


@query(
    "wilson_interval",
    f"""WITH hit AS (SELECT user_id AS customer_id, count(*) FILTER (WHERE event_type = 'purchase') AS hits,
      CASE WHEN user_id % 10 = 0 THEN 0 ELSE count(*) END AS n FROM events GROUP BY user_id)
    SELECT customer_id, hits, n, CASE WHEN n > 0 THEN round(hits / n, 6) END AS rate, {wilson('hits', 'n', 'rate')} FROM hit""",
)
def wilson_interval(spark, sf):
    from pyspark.sql import functions as F

    from checks.tables import table
    from panelmill.functions.columns import count_where, ratio

    hits = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("customer_id"))
        .agg(count_where(F.col("event_type") == "purchase").alias("hits"), F.count(F.lit(1)).alias("_n"))
        .select("customer_id", "hits", F.when(F.col("customer_id") % 10 == 0, 0).otherwise(F.col("_n")).alias("n"))
        .withColumn("rate", ratio(F.col("hits"), F.col("n")))
    )
    return rounded(with_wilson(hits, "hits", "n", "rate"))


PROPOSAL_ROUNDS = """s1 AS (SELECT product_code AS p FROM pen WHERE month_label = (SELECT max(month_label) FROM pen)
  ORDER BY penetration DESC, product_code LIMIT 1),
l1 AS (SELECT 1 AS step, p, NULL::BIGINT AS n FROM s1),
""" + ",\n".join(
    f"""s{i} AS (SELECT to_product AS p, sum(transitions)::BIGINT AS n FROM tra WHERE from_product IN (SELECT p FROM l{i - 1})
  AND to_product NOT IN (SELECT p FROM l{i - 1}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
l{i} AS (SELECT * FROM l{i - 1} UNION ALL SELECT {i}, p, n FROM s{i})"""
    for i in range(2, 7)
)


@query(
    "ladder_proposal",
    f"""{EV_TRANSITIONS}, pen AS (SELECT month_index AS month_label, product_code, avg(flag) AS penetration FROM lng GROUP BY 1, 2),
    {PROPOSAL_ROUNDS}
    SELECT step::INTEGER AS step, p AS product_code, product_name, n AS transitions_from_ladder FROM l6 JOIN prod ON product_code = p""",
)
def ladder_proposal(spark, sf):
    return journeys.ladder_proposal(_penetration(spark, sf), _transitions(spark, sf))



@query(
    "write_result_csv",
    f"""{ENGAGEMENT} SELECT dimension, group_value, month_label, customers::VARCHAR AS customers, active::VARCHAR AS active,
        printf('%.6f', active / customers) AS engagement_rate FROM eng""",
)
def write_result_csv(spark, sf):
    """A result written as CSV, read back as text."""
    folder = scratch_path(spark, "results")
    write_csv("engagement", _engagement(spark, sf), folder)
    return spark.read.option("header", True).csv(f"{folder}/engagement")

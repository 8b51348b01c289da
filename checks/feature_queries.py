"""The point-in-time feature table and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle_base import EV_FLAGS, STG, changes_of
from checks.registry import query, rounded
from checks.tables import EV_SPLITS, TARGET, ev_panel, ev_warehouse, stg_panel, table
from panelmill.functions.hashing import sample_entities as sampled
from panelmill.operators import features
from panelmill.operators.events import flag_changes, product_events

SHARE = 0.7
THRESHOLD = int(SHARE * 2**32)
BASE = f"""WITH {STG},{changes_of('fact', EV_FLAGS)},
base AS (
  SELECT c.customer_id, c.month_index AS t, n.ind_purchase_ult1 AS target_next, c.ind_purchase_ult1 AS target_now,
    CASE WHEN c.month_index <= 18 THEN 'train' WHEN c.month_index <= 22 THEN 'validation' ELSE 'test' END AS split
  FROM fact c JOIN fact n ON n.customer_id = c.customer_id AND n.month_index - 1 = c.month_index
  WHERE c.month_index >= 3 AND c.month_index <= 28)"""
SAMPLED = f"(customer_id * 2654435761) % 4294967296 < {THRESHOLD}"


@query(
    "sample_entities",
    f"""SELECT c_custkey, c_mktsegment FROM customer WHERE (c_custkey * 2654435761) % 4294967296 < {THRESHOLD}""",
)
def sample_entities(spark, sf):
    return sampled(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), SHARE, "c_custkey")


@query(
    "feature_base",
    f"""{BASE} SELECT customer_id, t AS feature_month, (t + 1)::INTEGER AS label_month, split, target_now AS holds_target_at_t,
        target_next AS holds_target_next FROM base WHERE {SAMPLED}""",
)
def feature_base(spark, sf):
    rows = features.feature_base(stg_panel(spark, sf), TARGET, EV_SPLITS, SHARE)
    return rows.select(
        "customer_id",
        F.col("month_index").alias("feature_month"),
        F.col("_next_period").alias("label_month"),
        "split",
        F.col("target_flag").alias("holds_target_at_t"),
        F.col("_next_target").alias("holds_target_next"),
    )


@query(
    "event_counts",
    f"""WITH {STG},{changes_of('fact', EV_FLAGS)} SELECT customer_id, month_index,
        sum((event_type = 'adoption')::INTEGER)::BIGINT AS adoptions, sum((event_type <> 'adoption')::INTEGER)::BIGINT AS attritions
        FROM evt GROUP BY 1, 2""",
)
def event_counts(spark, sf):
    return features.event_counts(product_events(flag_changes(ev_warehouse(spark, sf).fact)))


def _history(spark, sf):
    return features.feature_base(stg_panel(spark, sf), TARGET, EV_SPLITS, 1.0)


HISTORY = """(SELECT count(*) FROM fact h WHERE h.customer_id = b.customer_id AND h.month_index IN (b.t, b.t - 1, b.t - 2)
    AND h.is_active = 1) AS active_months_last_3m,
  (SELECT count(*) FROM evt e WHERE e.customer_id = b.customer_id AND e.month_index IN (b.t, b.t - 1, b.t - 2)
    AND e.event_type = 'adoption') AS adoptions_last_3m,
  (SELECT count(*) FROM evt e WHERE e.customer_id = b.customer_id AND e.month_index IN (b.t, b.t - 1, b.t - 2)
    AND e.event_type = 'attrition') AS attritions_last_3m"""


@query("history_3m", f"{BASE} SELECT customer_id, t AS feature_month, {HISTORY} FROM base b")
def history_3m(spark, sf):
    return _history(spark, sf).select(
        "customer_id",
        F.col("month_index").alias("feature_month"),
        "active_months_last_3m",
        "adoptions_last_3m",
        "attritions_last_3m",
    )


HELD = """EXISTS (SELECT 1 FROM fact f WHERE f.customer_id = b.customer_id AND f.month_index < b.t AND f.ind_purchase_ult1 = 1)"""


@query("held_before", f"{BASE} SELECT customer_id, t AS feature_month FROM base b WHERE {HELD}")
def held_before(spark, sf):
    return _history(spark, sf).filter("_held_before = 1").select("customer_id", F.col("month_index").alias("feature_month"))


NEXT_ANY = "EXISTS (SELECT 1 FROM evt e WHERE e.customer_id = b.customer_id AND e.month_index = b.t + 1 AND e.event_type = 'adoption')"


@query("next_adoptions", f"{BASE} SELECT customer_id, t AS feature_month FROM base b WHERE {NEXT_ANY}")
def next_adoptions(spark, sf):
    return _history(spark, sf).filter("_next_adoptions > 0").select("customer_id", F.col("month_index").alias("feature_month"))


@query(
    "lag_changes",
    f"""{BASE} SELECT b.customer_id, b.t AS feature_month, (n.n_products - p.n_products)::INTEGER AS n_products_change_1m,
        (n.n_products - q.n_products)::INTEGER AS n_products_change_3m
      FROM base b JOIN fact n ON n.customer_id = b.customer_id AND n.month_index = b.t
      LEFT JOIN fact p ON p.customer_id = b.customer_id AND p.month_index = b.t - 1
      LEFT JOIN fact q ON q.customer_id = b.customer_id AND q.month_index = b.t - 3""",
)
def lag_changes(spark, sf):
    return _history(spark, sf).select(
        "customer_id",
        F.col("month_index").alias("feature_month"),
        (F.col("n_products") - F.col("_products_1_ago")).alias("n_products_change_1m"),
        (F.col("n_products") - F.col("_products_3_ago")).alias("n_products_change_3m"),
    )


BAND = """CASE WHEN s.age >= 65 THEN '65+' WHEN s.age >= 55 THEN '55-64' WHEN s.age >= 45 THEN '45-54' WHEN s.age >= 35 THEN '35-44'
    WHEN s.age >= 25 THEN '25-34' WHEN s.age >= 0 THEN 'under 25' ELSE 'unknown' END"""


@query(
    "bands_and_fills",
    f"""WITH {STG} SELECT s.customer_id, s.month_index, {BAND} AS age_band, coalesce(s.segment, 'unknown') AS segment,
      round(ln(s.income + 1), 6) AS log_income, CASE WHEN s.income_missing THEN 1 ELSE 0 END::TINYINT AS income_missing,
      (s.month_index - d.first_seen_month_index)::INTEGER AS months_since_first_seen
    FROM stg s JOIN dimc d USING (customer_id)""",
)
def bands_and_fills(spark, sf):
    rows = features.panel_history(stg_panel(spark, sf), TARGET)
    return rounded(
        rows.select(
            "customer_id",
            "month_index",
            features.age_band(F.col("age")).alias("age_band"),
            F.coalesce(F.col("segment"), F.lit("unknown")).alias("segment"),
            features.log_income(F.col("income")).alias("log_income"),
            F.col("income_missing").cast("tinyint").alias("income_missing"),
            (F.col("month_index") - F.col("first_seen")).alias("months_since_first_seen"),
        )
    )


DATASET = f"""{BASE}, dat AS (
  SELECT b.customer_id, b.t AS feature_month, (b.t + 1)::INTEGER AS label_month, b.split, b.target_now AS holds_target_at_t,
    (b.target_now = 0 AND b.target_next = 1)::INTEGER AS adopts_target, ({NEXT_ANY})::INTEGER AS adopts_any,
    ({HELD})::INTEGER AS held_target_before_t,
    s.ind_view_ult1, s.ind_click_ult1, s.ind_signup_ult1, s.ind_error_ult1, n.n_products::INTEGER AS n_products,
    (n.n_products - p.n_products)::INTEGER AS n_products_change_1m, (n.n_products - q.n_products)::INTEGER AS n_products_change_3m,
    (b.t - d.first_seen_month_index)::INTEGER AS months_since_first_seen, {HISTORY},
    s.is_active, s.seniority_months, s.is_new_customer, coalesce(s.segment, 'unknown') AS segment,
    coalesce(s.relation_type, 'unknown') AS relation_type, {BAND} AS age_band, coalesce(s.sex, 'unknown') AS sex,
    coalesce(s.channel, 'unknown') AS channel, round(ln(s.income + 1), 6) AS log_income, s.income_missing::TINYINT AS income_missing
  FROM base b JOIN stg s ON s.customer_id = b.customer_id AND s.month_index = b.t
    JOIN fact n ON n.customer_id = b.customer_id AND n.month_index = b.t
    JOIN dimc d ON d.customer_id = b.customer_id
    LEFT JOIN fact p ON p.customer_id = b.customer_id AND p.month_index = b.t - 1
    LEFT JOIN fact q ON q.customer_id = b.customer_id AND q.month_index = b.t - 3)"""


def dataset(spark, sf, share=1.0):
    return features.propensity_dataset(stg_panel(spark, sf), TARGET, EV_SPLITS.check(29), share)


@query("propensity_dataset", f"{DATASET} SELECT * FROM dat")
def propensity_dataset(spark, sf):
    return rounded(dataset(spark, sf))


@query("propensity_dataset_sampled", f"{DATASET} SELECT * FROM dat WHERE {SAMPLED}")
def propensity_dataset_sampled(spark, sf):
    """Sampling is the feature here."""
    return rounded(dataset(spark, sf, SHARE))


@query(
    "split_summary",
    f"""{DATASET} SELECT split, count(*) AS rows, count(DISTINCT customer_id) AS customers,
      count(*) FILTER (WHERE holds_target_at_t = 0) AS target_population, sum(adopts_target)::BIGINT AS target_adoptions,
      sum(adopts_any)::BIGINT AS any_adoptions FROM dat GROUP BY 1""",
)
def split_summary(spark, sf):
    return features.require_splits(features.split_summary(dataset(spark, sf)))


@query(
    "split_base_rates",
    f"""{DATASET} SELECT split, count(*) AS rows, count(DISTINCT customer_id) AS customers, sum(adopts_target)::BIGINT AS positives,
      round(avg(adopts_target), 6) AS base_rate FROM dat WHERE holds_target_at_t = 0 GROUP BY 1""",
)
def split_base_rates(spark, sf):
    return rounded(features.population_summary(features.model_rows(dataset(spark, sf), "product")))


@query(
    "target_choice",
    f"""{DATASET}, r AS (SELECT avg(adopts_target) AS train_rate FROM dat WHERE split = 'train' AND holds_target_at_t <> 1)
      SELECT round(train_rate, 6) AS train_rate, CASE WHEN train_rate < 0.002 THEN 'any' ELSE 'product' END AS target_mode FROM r""",
)
def target_choice(spark, sf):
    return rounded(features.target_rate(dataset(spark, sf), 0.002))


@query("leakage_check", f"{DATASET} SELECT * EXCLUDE (adopts_target, adopts_any) FROM dat WHERE feature_month < 0")
def leakage_check(spark, sf):
    panel = stg_panel(spark, sf)
    return features.leakage_difference(panel, features.scramble_after(panel, 20), TARGET, EV_SPLITS, 20)

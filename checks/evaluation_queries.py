"""Ranking metrics, bins, capacity and bootstrap on the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.tables import score_table, table
from panelmill.operators import evaluation

SC = """sc AS (
  SELECT event_id AS tie, user_id AS customer_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
    floor(value / 50) / 10 AS score, (date_diff('day', DATE '2024-01-01', ts::DATE) // 10)::INTEGER AS label_month,
    CASE WHEN user_id % 4 = 0 THEN 'held before' ELSE 'never held' END AS segment, (event_id % 4)::DOUBLE AS weight FROM events)"""


def level_sql(group: str, weight: str) -> str:
    """Metrics per group; `group` is a column of sc, `weight` a column or 1."""
    return f"""lev AS (SELECT {group} AS g, score, sum({weight} * label) AS p, sum({weight}) AS w,
    sum({weight} * (score - label) * (score - label)) AS e, count(*) AS n FROM sc GROUP BY 1, 2),
  cum AS (SELECT *, sum(p) OVER o AS cp, sum(w) OVER o AS cw, sum(p) OVER (PARTITION BY g) AS tp, sum(w) OVER (PARTITION BY g) AS tw
    FROM lev WINDOW o AS (PARTITION BY g ORDER BY score DESC)),
  met AS (SELECT g, sum(n)::BIGINT AS rows, max(tp)::DOUBLE AS positives, max(tp) / max(tw) AS base_rate,
    sum((w - p) * (cp - p + p / 2)) / (max(tp) * (max(tw) - max(tp))) AS roc_auc,
    sum(CASE WHEN cw > 0 THEN p / tp * cp / cw ELSE 0 END) AS pr_auc, sum(e) / max(tw) AS brier FROM cum GROUP BY 1),
  ord AS (SELECT {group} AS g, label, {weight} AS w, sum({weight}) OVER (PARTITION BY {group} ORDER BY score DESC, tie
      ROWS UNBOUNDED PRECEDING) AS cw FROM sc),
  tot AS (SELECT g, sum(w) AS tw, sum(w * label) AS tp FROM ord GROUP BY 1),
  cap AS (SELECT g, sum(CASE WHEN cw <= 0.1 * tw THEN w * label ELSE 0 END) / max(tp) / 0.1 AS top_decile_lift,
    sum(CASE WHEN cw <= 0.05::DOUBLE * tw THEN w * label ELSE 0 END) / max(tp) AS capture_top_5pct,
    sum(CASE WHEN cw <= 0.1::DOUBLE * tw THEN w * label ELSE 0 END) / max(tp) AS capture_top_10pct,
    sum(CASE WHEN cw <= 0.2::DOUBLE * tw THEN w * label ELSE 0 END) / max(tp) AS capture_top_20pct
    FROM ord JOIN tot USING (g) GROUP BY 1)"""


def shown(*names: str) -> str:
    return ", ".join(f"round({name}, 6) AS {name}" for name in names)


RANKING = ("base_rate", "roc_auc", "pr_auc", "brier")
CAPTURE = ("top_decile_lift", "capture_top_5pct", "capture_top_10pct", "capture_top_20pct")
PLAIN = f"WITH {SC}, {level_sql('0', '1')}"


@query("roc_auc", f"{PLAIN} SELECT {shown('roc_auc')} FROM met")
def roc_auc(spark, sf):
    return rounded(evaluation.score_metrics(score_table(spark, sf)).select("roc_auc"))


@query("average_precision", f"{PLAIN} SELECT {shown('pr_auc')} FROM met")
def average_precision(spark, sf):
    return rounded(evaluation.score_metrics(score_table(spark, sf)).select("pr_auc"))


@query("brier", f"WITH {SC} SELECT round(avg(pow(score - label, 2)), 6) AS brier FROM sc")
def brier(spark, sf):
    return rounded(evaluation.score_metrics(score_table(spark, sf)).select("brier"))


@query("capture_and_lift", f"{PLAIN} SELECT {shown(*CAPTURE)} FROM cap")
def capture_and_lift(spark, sf):
    return rounded(evaluation.capture_and_lift(score_table(spark, sf)))


@query("point_metrics", f"{PLAIN} SELECT rows, positives, {shown(*RANKING, *CAPTURE)} FROM met JOIN cap USING (g)")
def point_metrics(spark, sf):
    return rounded(evaluation.point_metrics(score_table(spark, sf)))


@query(
    "weighted_metrics",
    f"WITH {SC}, {level_sql('0', 'weight')} SELECT rows, positives, {shown(*RANKING, *CAPTURE)} FROM met JOIN cap USING (g)",
)
def weighted_metrics(spark, sf):
    return rounded(evaluation.point_metrics(score_table(spark, sf), weight="weight"))


@query(
    "metrics_per_month",
    f"""WITH {SC}, {level_sql('label_month', '1')}
      SELECT g AS label_month, rows, positives, {shown(*RANKING, *CAPTURE)} FROM met JOIN cap USING (g)""",
)
def metrics_per_month(spark, sf):
    return rounded(evaluation.point_metrics(score_table(spark, sf), groups=["label_month"]))


@query(
    "metrics_by_prior_holding",
    f"""WITH {SC}, {level_sql('segment', '1')}
      SELECT g AS segment, rows, positives, {shown(*RANKING, *CAPTURE)} FROM met JOIN cap USING (g)""",
)
def metrics_by_prior_holding(spark, sf):
    return rounded(evaluation.point_metrics(score_table(spark, sf), groups=["segment"]))


@query(
    "lift_table",
    f"""WITH {SC}, til AS (SELECT label, ntile(10) OVER (ORDER BY score DESC, tie) AS decile FROM sc),
    bin AS (SELECT decile::INTEGER AS decile, count(*) AS rows, sum(label)::BIGINT AS adopters FROM til GROUP BY 1)
    SELECT decile, rows, adopters, round(adopters / rows, 6) AS adoption_rate,
      round(adopters / rows / (SELECT avg(label) FROM sc), 6) AS lift,
      round((SELECT sum(adopters) FROM bin x WHERE x.decile <= b.decile) / (SELECT sum(label) FROM sc), 6) AS cumulative_capture,
      round((SELECT sum(adopters) / sum(rows) FROM bin x WHERE x.decile <= b.decile) / (SELECT avg(label) FROM sc), 6) AS cumulative_lift
    FROM bin b""",
)
def lift_table(spark, sf):
    return rounded(evaluation.lift_table(score_table(spark, sf)))


@query(
    "calibration_table",
    f"""WITH {SC}, rnk AS (SELECT label, score, row_number() OVER (ORDER BY score, tie) AS r, count(*) OVER () AS n FROM sc)
    SELECT CASE WHEN r = 1 THEN 1 ELSE ceil(((r - 1) * 10)::DOUBLE / (n - 1)) END::INTEGER AS bin, count(*) AS rows,
      round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS observed_rate FROM rnk GROUP BY 1""",
)
def calibration_table(spark, sf):
    return rounded(evaluation.calibration_table(score_table(spark, sf)))


@query(
    "capacity_table",
    f"""WITH {SC}, rnk AS (SELECT label, score, row_number() OVER (ORDER BY score DESC, tie) AS r FROM sc),
    shr AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS share_contacted),
    siz AS (SELECT share_contacted, least((SELECT count(*) FROM sc),
      ceil(round(share_contacted * (SELECT count(*) FROM sc), 9)))::BIGINT AS customers_contacted FROM shr)
    SELECT share_contacted, customers_contacted, round(sum(score), 6) AS expected_adopters, sum(label)::BIGINT AS observed_adopters,
      round(sum(label) / customers_contacted, 6) AS precision, round(sum(label) / (SELECT sum(label) FROM sc), 6) AS capture,
      round(sum(score) * 100 - customers_contacted, 6) AS assumed_value
    FROM siz JOIN rnk ON r <= customers_contacted GROUP BY 1, 2""",
)
def capacity_table(spark, sf):
    return rounded(evaluation.capacity_table(score_table(spark, sf), (0.05, 0.1, 0.2, 0.3, 0.5), 100.0, 1.0))


@query(
    "operating_threshold",
    f"""WITH {SC} SELECT score AS threshold FROM sc ORDER BY score DESC, tie
        LIMIT 1 OFFSET (SELECT ceil(0.1::DOUBLE * count(*))::BIGINT - 1 FROM sc)""",
)
def operating_threshold(spark, sf):
    return evaluation.operating_threshold(score_table(spark, sf), 0.1)


@query(
    "threshold_metrics",
    f"""WITH {SC} SELECT 0.2::DOUBLE AS threshold, round(avg((score >= 0.2)::INTEGER), 6) AS share_selected,
      round(sum(label) FILTER (WHERE score >= 0.2) / count(*) FILTER (WHERE score >= 0.2), 6) AS precision,
      round(sum(label) FILTER (WHERE score >= 0.2) / sum(label), 6) AS recall FROM sc""",
)
def threshold_metrics(spark, sf):
    return rounded(evaluation.threshold_metrics(score_table(spark, sf), 0.2))


RESAMPLES, SEED = 1000, 42


def drawing() -> str:
    """CTE `wts`: customer_id, g (resample), weight (Poisson count of a 32-bit draw)."""
    cases = " ".join(f"WHEN draw < {bound} THEN {w}" for w, bound in enumerate(evaluation.POISSON_ONE))
    return f"""drw AS (SELECT customer_id, g,
    ('0x' || substr(md5(customer_id || '|' || (g // 4) || '|' || {SEED}), ((g % 4) * 8 + 1)::INTEGER, 8))::BIGINT AS draw
  FROM (SELECT DISTINCT customer_id FROM sc) CROSS JOIN (SELECT range AS g FROM range({RESAMPLES}))),
wts AS (SELECT customer_id, g, (CASE {cases} ELSE {len(evaluation.POISSON_ONE)} END)::DOUBLE AS weight FROM drw)"""


def bootstrap_sql() -> str:
    resampled = level_sql("g", "weight")
    for name in ("lev", "cum", "met", "ord", "tot", "cap"):
        resampled = resampled.replace(f"{name} AS (", f"r{name} AS (").replace(f"FROM {name}", f"FROM r{name}").replace(
            f"JOIN {name}", f"JOIN r{name}"
        )
    resampled = resampled.replace("FROM sc", "FROM rsc")
    names = ("roc_auc", "pr_auc", "brier", *CAPTURE)
    point = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS estimate FROM met JOIN cap USING (g)" for n in names)
    drawn = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM rmet JOIN rcap USING (g)" for n in names)
    return f"""WITH {SC}, {level_sql('0', '1')}, {drawing()},
rsc AS (SELECT wts.g, wts.weight, sc.label, sc.score, sc.tie FROM sc JOIN wts USING (customer_id) WHERE wts.weight > 0),
{resampled},
pnt AS ({point}), val AS ({drawn})
SELECT p.metric, round(max(p.estimate), 6) AS estimate, round(quantile_cont(d.value, 0.025), 6) AS lower,
  round(quantile_cont(d.value, 0.975), 6) AS upper, {RESAMPLES} AS resamples, ({RESAMPLES} - count(*))::BIGINT AS resamples_skipped
FROM pnt p JOIN val d USING (metric) GROUP BY 1"""


@query("cluster_bootstrap", bootstrap_sql())
def cluster_bootstrap(spark, sf):
    return rounded(evaluation.cluster_bootstrap(score_table(spark, sf), "customer_id", RESAMPLES, SEED))


#: the same rows with a score of their own for each
CONTINUOUS = SC.replace("floor(value / 50) / 10 AS score", "(value + event_id::DOUBLE / 4194304) / 1000 AS score")


@query("cluster_bootstrap_continuous", bootstrap_sql().replace(SC, CONTINUOUS))
def cluster_bootstrap_continuous(spark, sf):
    """As many scores as rows."""
    value = table(spark, sf, "events").select(F.col("event_id").alias("tie"), "value")
    score = (F.col("value") + F.col("tie").cast("double") / 4194304) / 1000
    rows = score_table(spark, sf).drop("score").join(value, "tie").withColumn("score", score)
    return rounded(evaluation.cluster_bootstrap(rows, "customer_id", RESAMPLES, SEED))


@query(
    "one_order_for_all",
    f"""WITH {SC}, rnk AS (SELECT label, score, row_number() OVER (ORDER BY score DESC, tie) AS r, count(*) OVER () AS n FROM sc)
    SELECT (SELECT max(score) FROM rnk WHERE r = ceil(0.1::DOUBLE * n)) AS threshold,
      (SELECT sum(label)::BIGINT FROM rnk WHERE r <= ceil(round(0.2::DOUBLE * n, 9))) AS adopters_in_best_fifth,
      (SELECT sum(label)::BIGINT FROM (SELECT label, ntile(10) OVER (ORDER BY r) AS b FROM rnk) WHERE b = 1) AS adopters_in_best_decile,
      (SELECT round(avg(score), 6) FROM (SELECT score, row_number() OVER (ORDER BY score, tie) AS u, n FROM rnk JOIN (SELECT score AS score2, tie, row_number() OVER (ORDER BY score DESC, tie) AS r FROM sc) USING (r))
        WHERE u = 1 OR ceil(((u - 1) * 10)::DOUBLE / (n - 1)) = 1) AS lowest_bin_score""",
)
def one_order_for_all(spark, sf):
    """Threshold, capacity, lift and calibration of one stored order."""
    order = evaluation.index_scores(score_table(spark, sf))
    capacity = evaluation.capacity_table(order, (0.2,), 100.0, 1.0).select(F.col("observed_adopters").alias("adopters_in_best_fifth"))
    lift = evaluation.lift_table(order).filter("decile = 1").select(F.col("adopters").alias("adopters_in_best_decile"))
    bins = evaluation.calibration_table(order).filter("bin = 1").select(F.col("mean_predicted").alias("lowest_bin_score"))
    return rounded(evaluation.operating_threshold(order, 0.1).join(capacity).join(lift).join(bins))

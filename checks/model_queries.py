"""The propensity model on the feature table of the EV panel."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.evaluation_queries import level_sql, shown
from checks.feature_queries import DATASET, dataset
from checks.registry import query, rounded
from checks.tables import EV_FLAG_FEATURES
from panelmill.operators import evaluation, features, model, shuffling
from panelmill.session import cut_lineage, scratch_path

COLUMNS = model.FeatureColumns(flags=EV_FLAG_FEATURES)
PAYROLL = "ind_signup_ult1"
ROWS = f"{DATASET}, mrw AS (SELECT *, adopts_target AS label FROM dat WHERE holds_target_at_t = 0)"
NUMERIC = features.NUMERIC_FEATURES


def rows_of(spark, sf, split: str):
    return features.model_rows(dataset(spark, sf), "product").filter(F.col("split") == split)


def stored_splits(spark, sf):
    """Train, validation and test rows, stored once: fitting reads them many times."""
    rows = cut_lineage(features.model_rows(dataset(spark, sf), "product"))
    return [rows.filter(F.col("split") == split) for split in features.SPLIT_NAMES]


@query(
    "preprocess_medians",
    f"{ROWS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, round(median({name})::DOUBLE, 6) AS median, count(*) FILTER (WHERE {name} IS NULL) "
        "AS null_rows FROM mrw WHERE split = 'train'"
        for name in NUMERIC
    ),
)
def preprocess_medians(spark, sf):
    return rounded(model.numeric_medians(rows_of(spark, sf, "train"), COLUMNS.numeric))


@query(
    "preprocess_modes",
    f"{ROWS} "
    + " UNION ALL ".join(
        f"""SELECT column_name, mode FROM (SELECT '{name}' AS column_name, {name}::DOUBLE AS mode FROM mrw
          WHERE split = 'train' AND {name} IS NOT NULL GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)"""
        for name in COLUMNS.zero_one
    ),
)
def preprocess_modes(spark, sf):
    return model.binary_modes(rows_of(spark, sf, "train"), COLUMNS.zero_one)


@query(
    "preprocess_levels",
    f"{ROWS}, lvl AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {name} AS level, count(*) AS rows FROM mrw WHERE split = 'train' GROUP BY 2"
        for name in COLUMNS.categorical
    )
    + """), plc AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, level DESC) AS place,
      count(*) OVER (PARTITION BY column_name) AS n FROM lvl)
    SELECT column_name, CASE WHEN n <= 11 OR place <= 10 THEN level END AS level, sum(rows)::BIGINT AS rows FROM plc GROUP BY 1, 2""",
)
def preprocess_levels(spark, sf):
    return model.top_levels(rows_of(spark, sf, "train"), COLUMNS.categorical)


def _prepared(of: str) -> str:
    """`prp`: every preprocessed feature of the rows `of`, long form."""
    key = "customer_id, feature_month"
    parts = []
    for name in COLUMNS.numeric:
        parts.append(
            f"""SELECT {key}, '{name}' AS feature, (coalesce(v.{name}, s.med) - s.mean) / s.sd AS value FROM {of} v, (
            SELECT med, avg(coalesce({name}, med)) AS mean, coalesce(nullif(stddev_pop(coalesce({name}, med)), 0), 1) AS sd
            FROM trn, (SELECT median({name})::DOUBLE AS med FROM trn) GROUP BY med) s"""
        )
        parts.append(
            f"""SELECT {key}, '{name}_missing', ((v.{name} IS NULL)::INTEGER - s.mean) / s.sd FROM {of} v, (
            SELECT avg(({name} IS NULL)::INTEGER) AS mean, coalesce(nullif(stddev_pop(({name} IS NULL)::INTEGER), 0), 1) AS sd
            FROM trn HAVING bool_or({name} IS NULL)) s"""
        )
    for name in COLUMNS.zero_one:
        parts.append(
            f"""SELECT {key}, '{name}', coalesce(v.{name}, s.m)::DOUBLE FROM {of} v, (SELECT {name} AS m FROM trn
            WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) s"""
        )
    for name in COLUMNS.categorical:
        levels = f"""(SELECT level FROM (SELECT {name} AS level, row_number() OVER (ORDER BY count(*) DESC, {name} DESC) AS place,
            count(*) OVER () AS n FROM trn GROUP BY 1) WHERE n <= 11 OR place <= 10)"""
        parts.append(f"SELECT {key}, '{name}=' || k.level, (v.{name} = k.level)::INTEGER::DOUBLE FROM {of} v, {levels} k")
        parts.append(
            f"""SELECT {key}, '{name}=other levels', (v.{name} NOT IN {levels})::INTEGER::DOUBLE FROM {of} v
            WHERE (SELECT count(DISTINCT {name}) FROM trn) > 11"""
        )
    return (
        f"trn AS (SELECT * FROM mrw WHERE split = 'train'), vld AS (SELECT * FROM mrw WHERE split = 'validation'), "
        f"prp AS MATERIALIZED ({' UNION ALL '.join(parts)})"
    )


EXACT = ROWS.replace("round(ln(s.income + 1), 6)", "ln(s.income + 1)")


@query(
    "preprocess",
    f"{EXACT}, {_prepared('vld')} SELECT customer_id, feature_month, feature, round(value, 6) AS value FROM prp",
)
def preprocess(spark, sf):
    train, validation, _ = stored_splits(spark, sf)
    stages, names = model.fit_preprocess(train, COLUMNS)
    vectors = PipelineModel(stages).transform(validation).select(
        "customer_id", "feature_month", F.posexplode(vector_to_array("features")).alias("place", "value")
    )
    named = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("place") + 1)
    return rounded(vectors.select("customer_id", "feature_month", named.alias("feature"), (F.col("value") + 0.0).alias("value")))


@query(
    "class_weights",
    f"""{ROWS} SELECT count(*) AS rows, sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives,
        round(sum(1 - label) / sum(label), 6) AS positive_weight FROM mrw WHERE split = 'train'""",
)
def class_weights(spark, sf):
    return rounded(model.class_weights(rows_of(spark, sf, "train")))


RULE = f"(coalesce(is_active, 0) = 1 AND {PAYROLL} = 1 AND n_products > 2)::INTEGER::DOUBLE"


@query(
    "rule_baseline",
    f"{ROWS} SELECT customer_id, feature_month, label, {RULE} AS score FROM mrw WHERE split = 'validation'",
)
def rule_baseline(spark, sf):
    rows = model.rule_baseline(rows_of(spark, sf, "validation"), PAYROLL)
    return rows.select("customer_id", "feature_month", "label", "score")


@query(
    "constant_baseline",
    f"""{ROWS} SELECT customer_id, feature_month, label,
        round((SELECT avg(label) FROM mrw WHERE split = 'validation'), 6) AS score FROM mrw WHERE split = 'validation'""",
)
def constant_baseline(spark, sf):
    rows = model.constant_baseline(rows_of(spark, sf, "validation"))
    return rounded(rows.select("customer_id", "feature_month", "label", "score"))


def _candidates(spark, sf):
    rows = rows_of(spark, sf, "validation")
    return {
        "base_rate": model.constant_baseline(rows),
        "rule": model.rule_baseline(rows, PAYROLL),
        "breadth": rows.withColumn("score", F.col("n_products") / 5),
        "recent": rows.withColumn("score", F.col("adoptions_last_3m") / 20),
    }


CANDIDATES = f"""{ROWS}, vld AS (SELECT * FROM mrw WHERE split = 'validation'),
  sc AS (SELECT 'base_rate' AS candidate, label, (SELECT avg(label) FROM vld) AS score, customer_id * 100 + feature_month AS tie FROM vld
    UNION ALL SELECT 'rule', label, {RULE}, customer_id * 100 + feature_month FROM vld
    UNION ALL SELECT 'breadth', label, n_products / 5, customer_id * 100 + feature_month FROM vld
    UNION ALL SELECT 'recent', label, adoptions_last_3m / 20, customer_id * 100 + feature_month FROM vld), """ + level_sql(
    "candidate", "1"
)
MODEL_METRICS = f"SELECT g AS candidate, rows, positives, {shown('base_rate', 'roc_auc', 'pr_auc', 'brier')} FROM met"


@query("candidate_metrics", f"{CANDIDATES} {MODEL_METRICS}")
def candidate_metrics(spark, sf):
    return rounded(model.candidate_metrics(_candidates(spark, sf)))


@query("select_model", f"{CANDIDATES} {MODEL_METRICS} ORDER BY met.pr_auc DESC, g DESC LIMIT 1")
def select_model(spark, sf):
    return rounded(model.select_model(model.candidate_metrics(_candidates(spark, sf))))


@query(
    "baseline_metrics",
    f"""{CANDIDATES} SELECT g AS candidate, rows, positives, {shown('base_rate', 'roc_auc', 'pr_auc')},
      CASE WHEN g = 'base_rate' THEN round(brier, 6) END AS brier,
      CASE WHEN g = 'rule' THEN round((SELECT avg({RULE}) FROM vld), 6) END AS share_selected FROM met WHERE g IN ('base_rate', 'rule')""",
)
def baseline_metrics(spark, sf):
    return rounded(model.baseline_metrics(rows_of(spark, sf, "validation"), PAYROLL))


@query(
    "against_baselines",
    f"""{CANDIDATES}, own AS (SELECT * FROM met WHERE g IN ('breadth', 'recent') ORDER BY pr_auc DESC, g DESC LIMIT 1),
      bas AS (SELECT * FROM met WHERE g IN ('base_rate', 'rule') ORDER BY pr_auc DESC, g DESC LIMIT 1)
      SELECT own.g AS selected, round(own.pr_auc, 6) AS selected_pr_auc, bas.g AS best_baseline, round(bas.pr_auc, 6) AS baseline_pr_auc,
        own.pr_auc > bas.pr_auc AS beats_baselines FROM own, bas""",
)
def against_baselines(spark, sf):
    found = _candidates(spark, sf)
    own = model.candidate_metrics({name: found[name] for name in ("breadth", "recent")})
    return rounded(model.against_baselines(own, model.baseline_metrics(rows_of(spark, sf, "validation"), PAYROLL)))


def _scores(rows):
    return rows.select("customer_id", "feature_month", "label", "score")


#: The fit in SQL on every column. The curvature of the log-loss is never above a quarter of the weighted outer products,
#: so steps by the inverse of that bound (one elimination, a column at a time) descend to the same optimum.
STEPS = 150
FITTED = EXACT.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_prepared("mrw")},
  fno AS MATERIALIZED (SELECT feature, row_number() OVER (ORDER BY feature) AS i, count(*) OVER () + 1 AS d FROM (SELECT DISTINCT feature FROM prp)),
  fln AS MATERIALIZED (SELECT customer_id, feature_month, i, value FROM prp JOIN fno USING (feature)
    UNION ALL SELECT customer_id, feature_month, (SELECT max(d) FROM fno), 1 FROM mrw),
  vec AS MATERIALIZED (SELECT customer_id, feature_month, x, label, split, label_month, count(*) FILTER (WHERE split = 'train') OVER () AS n,
      sum(label) FILTER (WHERE split = 'train') OVER () AS p
    FROM (SELECT customer_id, feature_month, list(value ORDER BY i) AS x FROM fln GROUP BY 1, 2) JOIN mrw USING (customer_id, feature_month)),
  trv AS MATERIALIZED (SELECT customer_id, feature_month, x, label, CASE WHEN label = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS w
    FROM vec WHERE split = 'train'),
  grm AS (SELECT a.i, b.i AS j, sum(w * a.value * b.value) / 4 + CASE WHEN a.i = b.i AND a.i < (SELECT max(d) FROM fno) THEN 1 ELSE 0 END AS v
    FROM fln a JOIN fln b USING (customer_id, feature_month) JOIN trv USING (customer_id, feature_month) GROUP BY 1, 2),
  elm AS (
    SELECT 1::BIGINT AS k, list(r ORDER BY i) AS m FROM (
      SELECT i, list(v ORDER BY j) || [CASE WHEN u = i THEN 1::DOUBLE ELSE 0::DOUBLE END FOR u IN range(1, (SELECT max(d) FROM fno) + 1)] AS r
      FROM grm GROUP BY i)
    UNION ALL
    SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda e: e / m[k][k])
      ELSE list_transform(r, lambda e, j: e - r[k] * m[k][j] / m[k][k]) END) FROM elm WHERE k <= len(m)),
  inv AS MATERIALIZED (SELECT i, j, m[i][len(m) + j] AS v FROM (SELECT m, unnest(range(1, len(m) + 1)) AS i FROM elm WHERE k = len(m) + 1),
    (SELECT i AS j FROM fno UNION ALL SELECT max(d) FROM fno)),
  dsc AS (
    SELECT 0 AS step, [0::DOUBLE FOR u IN range((SELECT max(d) FROM fno))] AS b
    UNION ALL
    SELECT step + 1, list(nb ORDER BY j) FROM (
      SELECT step, j, any_value(b[j]) - sum(v * g) AS nb FROM (
        SELECT step, i, any_value(b) AS b, sum(r * x[i]) + any_value(CASE WHEN i < len(b) THEN b[i] ELSE 0 END) AS g FROM (
          SELECT step, b, x, r, unnest(range(1, len(x) + 1)) AS i FROM (
            SELECT step, b, x, w * (1 / (1 + exp(-list_inner_product(b, x))) - label) AS r FROM dsc, trv WHERE step < {STEPS}))
        GROUP BY step, i) JOIN inv USING (i) GROUP BY step, j)
    GROUP BY step),
  cof AS MATERIALIZED (SELECT b FROM dsc WHERE step = {STEPS}),
  scd AS MATERIALIZED (SELECT customer_id, feature_month, label, split, label_month, list_inner_product(b, x) AS s FROM vec, cof)"""
#: Sigmoid calibration of the log-odds s on the validation rows: two coefficients, by Newton's method.
CALIBRATED = FITTED + """,
  tgt AS MATERIALIZED (SELECT s, CASE WHEN label = 1 THEN (tp + 1) / (tp + 2) ELSE 1 / (tn + 2) END AS y
    FROM scd, (SELECT sum(label) AS tp, sum(1 - label) AS tn FROM scd WHERE split = 'validation') WHERE split = 'validation'),
  nwt AS (
    SELECT 0 AS step, 0::DOUBLE AS a, 0::DOUBLE AS c
    UNION ALL
    SELECT step + 1, a - (hcc * ga - hac * gc) / (haa * hcc - hac * hac), c - (haa * gc - hac * ga) / (haa * hcc - hac * hac) FROM (
      SELECT step, a, c, sum(m - y) AS ga, sum((m - y) * s) AS gc, sum(m * (1 - m)) AS haa, sum(m * (1 - m) * s) AS hac, sum(m * (1 - m) * s * s) AS hcc
      FROM (SELECT step, a, c, s, y, 1 / (1 + exp(-a - c * s)) AS m FROM nwt, tgt WHERE step < 30) GROUP BY step, a, c)),
  cal AS MATERIALIZED (SELECT d.*, 1 / (1 + exp(-d.s)) AS raw, 1 / (1 + exp(-a - c * d.s)) AS q FROM scd d, nwt WHERE step = 30)"""


@query(
    "logistic",
    f"""{FITTED} SELECT customer_id, feature_month, label, round(1 / (1 + exp(-s)), 6) AS score FROM scd WHERE split = 'validation'""",
)
def logistic(spark, sf):
    train, validation, _ = stored_splits(spark, sf)
    return rounded(_scores(model.fit_logistic(train, COLUMNS).raw_scores(validation)))


@query(
    "boosted_trees",
    f"""{ROWS} SELECT count(*) AS rows, true AS in_range, true AS above_base_rate FROM mrw WHERE split = 'validation'""",
)
def boosted_trees(spark, sf):
    """A property check: every row has a probability, and the ranking beats the base rate."""
    train, validation, _ = stored_splits(spark, sf)
    scored = cut_lineage(_scores(model.fit_boosted_trees(train, COLUMNS).raw_scores(validation)))
    above = evaluation.score_metrics(scored).select(F.col("pr_auc") > F.col("base_rate")).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("score").between(0, 1)).alias("in_range")
    ).withColumn("above_base_rate", above)


STUMPS = 3


def _stumps_answer(rounds: int, rate: float = 0.3, penalty: float = 1.0) -> str:
    """Round by round: sums of both derivatives per feature and value, both sides of each split, the best one."""
    steps = [
        """cnt AS (SELECT sum(1 - label)::DOUBLE / sum(label) AS pw FROM trn)""",
        """m0 AS MATERIALIZED (SELECT customer_id, feature_month, label, split, CASE WHEN label = 1 THEN pw ELSE 1 END AS w, 0::DOUBLE AS s FROM mrw, cnt)""",
    ]
    for at in range(rounds):
        steps.append(
            f"""lv{at} AS (SELECT feature, value, sum((w * (q - label))::DECIMAL(38, 12)) AS g, sum((w * q * (1 - q))::DECIMAL(38, 12)) AS h
            FROM (SELECT *, 1 / (1 + exp(-s)) AS q FROM m{at} WHERE split = 'train') JOIN prp USING (customer_id, feature_month) GROUP BY 1, 2)"""
        )
        steps.append(
            f"""ct{at} AS (SELECT feature, value, sum(g) OVER r AS gl, sum(h) OVER r AS hl, sum(g) OVER a AS ga, sum(h) OVER a AS ha,
            lead(value) OVER o AS later FROM lv{at} WINDOW r AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING),
            a AS (PARTITION BY feature), o AS (PARTITION BY feature ORDER BY value))"""
        )
        low, high, whole = (
            (f"({g})::DOUBLE", f"(({h})::DOUBLE + {penalty})") for g, h in (("gl", "hl"), ("ga - gl", "ha - hl"), ("ga", "ha"))
        )
        gain = f"{low[0]} * {low[0]} / {low[1]} + {high[0]} * {high[0]} / {high[1]} - {whole[0]} * {whole[0]} / {whole[1]}"
        steps.append(
            f"""sp{at} AS MATERIALIZED (SELECT feature, value AS cut, -{low[0]} / {low[1]} AS vl, -{high[0]} / {high[1]} AS vh
            FROM ct{at} WHERE later IS NOT NULL ORDER BY {gain} DESC, feature, value LIMIT 1)"""
        )
        steps.append(
            f"""m{at + 1} AS MATERIALIZED (SELECT m.* REPLACE (m.s + {rate} * CASE WHEN p.value <= cut THEN vl ELSE vh END AS s)
            FROM m{at} m JOIN prp p USING (customer_id, feature_month) JOIN sp{at} USING (feature))"""
        )
    return f"""{EXACT}, {_prepared("mrw")}, {', '.join(steps)}
        SELECT customer_id, feature_month, label, round(1 / (1 + exp(-s)), 6) AS score FROM m{rounds} WHERE split = 'validation'"""


@query("boosted_stumps", _stumps_answer(STUMPS))
def boosted_stumps(spark, sf):
    """Scores of a few boosted stumps, searched over every value of every model column."""
    train, validation, _ = stored_splits(spark, sf)
    return rounded(_scores(model.fit_boosted_stumps(train, COLUMNS, rounds=STUMPS).raw_scores(validation)))


@query(
    "calibrate",
    f"""{CALIBRATED} SELECT 'before' AS scores, round(avg((raw - label) * (raw - label)), 6) AS brier FROM cal WHERE split = 'validation'
      UNION ALL SELECT 'after', round(avg((q - label) * (q - label)), 6) FROM cal WHERE split = 'validation'""",
)
def calibrate(spark, sf):
    train, validation, _ = stored_splits(spark, sf)
    fitted = model.fit_logistic(train, COLUMNS)
    calibrated = model.fit_calibration(fitted, validation)
    return rounded(model.calibration_gain(fitted.raw_scores(validation), calibrated.raw_scores(validation)))


@query("score_batch", f"{ROWS} SELECT count(*) AS rows, 0::BIGINT AS differing FROM mrw WHERE split = 'test'")
def score_batch(spark, sf):
    """Test rows, and those that a saved and loaded model scores differently."""
    train, _, test = stored_splits(spark, sf)
    path = scratch_path(spark, "model")
    fitted = model.fit_logistic(train, COLUMNS)
    model.save_model(fitted, path)
    keys = ["customer_id", "feature_month"]
    first = fitted.raw_scores(test).select(*keys, F.col("score").alias("one"))
    second = model.load_model(spark, path).raw_scores(test).select(*keys, F.col("score").alias("other"))
    same = F.col("one").eqNullSafe(F.col("other"))
    return first.join(second, keys, "full").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(~same, 1)).alias("differing")
    )


@query(
    "odds_ratios",
    f"""{FITTED} SELECT feature, round(b[i], 6) AS log_odds, round(exp(b[i]), 6) AS odds_ratio FROM fno, cof
      ORDER BY abs(b[i]) DESC, feature LIMIT 15""",
)
def odds_ratios(spark, sf):
    train, _, _ = stored_splits(spark, sf)
    return rounded(model.odds_ratios(model.fit_logistic(train, COLUMNS)))


#: A fixed score of every model column, in whole numbers, so that only the shuffling and the metrics are checked.
SHUFFLED = COLUMNS.all


def _fixed_score(column: str) -> str:
    terms = []
    for at, name in enumerate(SHUFFLED):
        shown_name = column.format(name)
        value = f"length({shown_name})" if name in COLUMNS.categorical else f"floor({shown_name})"
        terms.append(f"coalesce(CAST({value} AS BIGINT), 3) * {(at * 7) % 11 - 3}")
    return f"CAST({' + '.join(terms)} AS DOUBLE)"


class _Fixed:
    def raw_scores(self, rows):
        return rows.withColumn("score", F.expr(_fixed_score("{}")))


def _permutation_answer(repeats: int = 5, seed: int = 42) -> str:
    """The keyed shuffle round by round; its keys come from the same digests."""
    parts, tie = [], "o.customer_id * 100 + o.feature_month AS tie"
    steps, kept = ["plc AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY customer_id, feature_month) - 1 AS place, count(*) OVER () AS n FROM mrw WHERE split = 'validation')"], "place, n"
    for repeat in range(repeats):
        steps.append(f"s{repeat}_0 AS (SELECT {kept}, place AS x FROM plc)")
        for at in range(shuffling.ROUNDS):
            key = f"md5('{seed}|{repeat}|{at}')"
            a, b = f"('0x' || substr({key}, 1, 8))::BIGINT", f"('0x' || substr({key}, 9, 8))::BIGINT"
            low = "4294967295"
            steps.append(
                f"""s{repeat}_{at + 1} AS {'MATERIALIZED ' if at == shuffling.ROUNDS - 1 else ''}(SELECT {kept}, CASE WHEN (t >> 16) & 1 = 1 THEN y ELSE x END AS x FROM (
                SELECT *, (xor(u, u >> 15) * 1540483477) & {low} AS t FROM (SELECT *, ((xor(xor(z, z >> 32), {b}) & {low}) * 1540483477) & {low} AS u
                FROM (SELECT *, greatest(x, y) AS z FROM (SELECT *, ({a} % n + n - x) % n AS y FROM s{repeat}_{at})))))"""
            )
    parts.append(f"SELECT 'whole' AS v, o.label, {_fixed_score('o.{}')} AS score, {tie} FROM plc o")
    for name in SHUFFLED:
        for repeat in range(repeats):
            mixed = _fixed_score("o.{}").replace(f"o.{name})", f"d.{name})")
            parts.append(
                f"""SELECT '{name}|{repeat}', o.label, {mixed}, {tie} FROM s{repeat}_{shuffling.ROUNDS} m
                JOIN plc o ON o.place = m.x JOIN plc d ON d.place = m.place"""
            )
    return (
        f"""{ROWS}, {', '.join(steps)}, sc AS ({' UNION ALL '.join(parts)}), {level_sql('v', '1')}
        SELECT split_part(g, '|', 1) AS feature, round(avg(whole - pr_auc), 6) AS pr_auc_drop_mean,
          round(stddev_pop(whole - pr_auc), 6) AS pr_auc_drop_std
        FROM met, (SELECT pr_auc AS whole FROM met WHERE g = 'whole') WHERE g <> 'whole' GROUP BY 1"""
    )


@query("permutation_importance", _permutation_answer())
def permutation_importance(spark, sf):
    """Every model column, five repeats, every validation row."""
    rows = rows_of(spark, sf, "validation")
    return rounded(model.permutation_importance(_Fixed(), rows, SHUFFLED, ["customer_id", "feature_month"]))


@query(
    "score_reproducible",
    f"{ROWS} SELECT count(*) AS rows, 0::BIGINT AS differing, true AS other_penalty_differs FROM mrw WHERE split = 'validation'",
)
def score_reproducible(spark, sf):
    """Validation rows, and those whose score differs between two fits of the same rows; a fit with another penalty
    is the control that must differ."""
    train, validation, _ = stored_splits(spark, sf)
    keys = ["customer_id", "feature_month"]
    one, other, control = (
        model.fit_logistic(train, COLUMNS, inverse_penalty=penalty).raw_scores(validation).select(*keys, F.col("score").alias(name))
        for name, penalty in (("one", 1.0), ("other", 1.0), ("control", 0.01))
    )
    joined = one.join(other, keys).join(control, keys)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("one") != F.col("other"), 1)).alias("differing"),
        F.bool_or(F.col("one") != F.col("control")).alias("other_penalty_differs"),
    )


REPORTED = ("rows", "positives", "base_rate", "roc_auc", "pr_auc", "brier")


@query(
    "test_report",
    f"""{CALIBRATED}, sc AS (SELECT label, label_month, q AS score, customer_id AS tie FROM cal WHERE split = 'test'),
      {level_sql('label_month', '1')}
      SELECT g AS label_month, rows, positives, round(base_rate, 4) AS base_rate,
        {", ".join(f"round(CASE WHEN positives > 0 AND positives < rows THEN {name} END, 4) AS {name}" for name in REPORTED[3:])} FROM met""",
)
def test_report(spark, sf):
    """Calibrated scores of the test rows, per label period."""
    train, validation, test = stored_splits(spark, sf)
    calibrated = model.fit_calibration(model.fit_logistic(train, COLUMNS), validation)
    scored = calibrated.raw_scores(test).withColumn("tie", F.col("customer_id"))
    return rounded(evaluation.point_metrics(scored, groups=["label_month"]).select("label_month", *REPORTED), 4)

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelmill.operators import evaluation, model

COLUMNS = model.FeatureColumns(("ind_a_ult1",), ("x", "z"), ("is_active",), ("channel",))


def make_rows(count=3000, seed=2):
    """x and the flag carry signal, z and the channel none."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        x, flag = rng.gauss(0, 1), int(rng.random() < 0.3)
        chance = 1 / (1 + np.exp(-(-2.2 + 1.2 * x + 1.5 * flag)))
        channel = f"k{min(int(rng.expovariate(0.35)), 14):02d}"
        rows.append(
            (i, int(rng.random() < chance), x, rng.choice([None, 1.0, 2.0, 4.0]), flag, rng.choice([0, 1, 1, None]), channel)
        )
    return rows


SCHEMA = "tie bigint, label int, x double, z double, ind_a_ult1 tinyint, is_active tinyint, channel string"


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).persist()


@pytest.fixture(scope="module")
def validation(spark):
    return spark.createDataFrame(make_rows(1500, 7), SCHEMA).persist()


@pytest.fixture(scope="module")
def logistic(train):
    return model.fit_logistic(train, COLUMNS)


def test_preprocessing_does_not_depend_on_the_order_of_tasks(spark):
    """Sums of doubles do: one large value first or last gives another mean."""
    rng = random.Random(4)
    rows = [(i, i % 2, rng.gauss(0, 1) * 10 ** rng.randint(-3, 6), None if i % 3 else 0.1 * i, 0, 1, "k") for i in range(2000)]
    rows = [(*row[:2], 1.1, *row[3:]) if row[0] % 5 == 0 else row for row in rows]
    found = {
        model.fit_preprocess(spark.createDataFrame(some, SCHEMA).coalesce(tasks), COLUMNS)[0][0].getStatement()
        for some, tasks in ((rows, 1), (rows[::-1], 1), (sorted(rows, key=lambda row: abs(row[2])), 3))
    }
    assert len(found) == 1
    same = spark.createDataFrame([(i, i % 2, 1.1, 0.3, 0, 1, "k") for i in range(7)], SCHEMA)
    assert "- 1.1D) / 1.0D" in model.fit_preprocess(same, COLUMNS)[0][0].getStatement()


def test_preprocessing_is_fitted_on_training_rows(spark, train):
    stages, names = model.fit_preprocess(train, COLUMNS, top=10)
    rows = make_rows()
    known = [r[3] for r in rows if r[3] is not None]
    median = float(np.median(known))
    filled = np.array([median if r[3] is None else r[3] for r in rows])
    odd = [(0, 0, 0.0, None, None, None, "never seen"), (1, 0, 0.0, 4.0, 1, 0, "k00"), (2, 0, 0.0, 4.0, 1, 0, None)]
    from pyspark.ml import PipelineModel

    out = PipelineModel(stages).transform(spark.createDataFrame(odd, SCHEMA)).orderBy("tie")
    values = [dict(zip(names, row[0], strict=True)) for row in out.select(vector_to_array("features")).collect()]
    assert values[0]["z"] == pytest.approx((median - filled.mean()) / filled.std())
    missing = np.array([r[3] is None for r in rows], dtype=float)
    assert values[0]["z_missing"] == pytest.approx((1 - missing.mean()) / missing.std())
    assert "x_missing" not in names and values[0]["is_active"] == 1.0 and values[0]["ind_a_ult1"] == 0.0
    counts = {}
    for row in rows:
        counts[row[6]] = counts.get(row[6], 0) + 1
    kept = sorted(sorted(counts, key=lambda c: (counts[c], c), reverse=True)[:10])
    assert [n for n in names if n.startswith("channel=")] == [*(f"channel={c}" for c in kept), "channel=other levels"]
    assert [v["channel=other levels"] for v in values] == [1.0, 0.0, 1.0] and values[1]["channel=k00"] == 1.0
    assert not set(out.columns) & {f"_x{i}" for i in range(len(names))}


def test_few_levels_need_no_bucket(spark):
    rows = [(i, i % 2, 0.5, 1.0, 1, 1, f"k{i % 3}") for i in range(30)]
    levels = model.top_levels(spark.createDataFrame(rows, SCHEMA), ["channel"], 2)
    assert {row["level"] for row in levels.collect()} == {"k0", "k1", "k2"}
    ties = model.top_levels(spark.createDataFrame(rows, SCHEMA), ["channel"], 1)
    assert {(row["level"], row["rows"]) for row in ties.collect()} == {("k2", 10), (None, 20)}


def test_modes_and_medians(spark):
    rows = [(i, 0, x, None, f, a, "k") for i, (x, f, a) in enumerate([(1.0, 0, 1), (2.0, 1, None), (3.0, 1, 0), (10.0, 0, None)])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["column_name"]: r["mode"] for r in model.binary_modes(df, COLUMNS.zero_one).collect()} == {
        "ind_a_ult1": 0.0, "is_active": 0.0,
    }
    found = {r["column_name"]: (r["median"], r["null_rows"]) for r in model.numeric_medians(df, COLUMNS.numeric).collect()}
    assert found == {"x": (2.5, 0), "z": (None, 4)}


def solve_logistic(matrix, labels):
    """Newton's method for the balanced, L2-penalised regression with C = 1 and a free intercept."""
    n, p = len(labels), labels.sum()
    weights = np.where(labels == 1, n / (2 * p), n / (2 * (n - p)))
    a = np.column_stack([matrix, np.ones(n)])
    penalty = np.diag([1.0] * matrix.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-a @ w))
        gradient = a.T @ (weights * (mu - labels)) + penalty @ w
        hessian = (a * (weights * mu * (1 - mu))[:, None]).T @ a + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_logistic_is_the_balanced_penalised_optimum(train, logistic):
    from pyspark.ml import PipelineModel

    stages, names = model.fit_preprocess(train, COLUMNS)
    prepared = PipelineModel(stages).transform(train).select(vector_to_array("features").alias("f"), "label").collect()
    expected = solve_logistic(np.array([r["f"] for r in prepared]), np.array([r["label"] for r in prepared]))
    assert logistic.feature_names == names and np.allclose(logistic.coefficients, expected[:-1], atol=1e-9)
    first = logistic.raw_scores(train.filter("tie = 0")).first()["score"]
    inputs = PipelineModel(stages).transform(train.filter("tie = 0")).select(vector_to_array("features")).first()[0]
    assert first == pytest.approx(1 / (1 + np.exp(-(np.array(inputs) @ expected[:-1] + expected[-1]))), abs=1e-9)


def test_newton_sums_do_not_depend_on_partitions(spark):
    from panelmill.operators.newton import newton_logistic

    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=3).tolist(), float(rng.random()), float(rng.random())) for _ in range(500)]
    df = spark.createDataFrame(rows, "x array<double>, y double, w double")
    one, other = (newton_logistic(df.repartition(parts), 3, 0.5) for parts in (1, 7))
    assert np.allclose(one[0], other[0], atol=1e-11) and one[1] == pytest.approx(other[1], abs=1e-11)
    assert newton_logistic(df.limit(0), 3, 0.5) == ([0.0, 0.0, 0.0], 0.0)
    # two equal columns and no penalty: no unique solution, but one is found
    twice = df.select(F.array(F.col("x")[0], F.col("x")[0]).alias("x"), "y", "w")
    (a, b), _ = newton_logistic(twice, 2)
    assert a == pytest.approx(b)
    with pytest.raises(Exception, match="not finite"):
        newton_logistic(spark.createDataFrame([([float("nan")], 1.0, 1.0)], "x array<double>, y double, w double"), 1)


def test_models_beat_the_baselines(train, validation, logistic):
    trees = model.fit_boosted_trees(train, COLUMNS, trees=15)
    metrics = model.candidate_metrics(
        {
            "base_rate": model.constant_baseline(validation),
            "boosted_trees": trees.raw_scores(validation),
            "logistic_regression": logistic.raw_scores(validation),
        }
    )
    found = {r["candidate"]: r for r in metrics.collect()}
    base = found["base_rate"]
    assert base["roc_auc"] == 0.5 and base["pr_auc"] == pytest.approx(base["base_rate"])
    for name in ("boosted_trees", "logistic_regression"):
        assert found[name]["pr_auc"] > 1.8 * base["pr_auc"] and found[name]["roc_auc"] > 0.7
    best = max((found[name]["pr_auc"], name) for name in found)[1]
    assert model.select_model(metrics).first()["candidate"] == best


def test_trees_do_not_depend_on_partitions(train, validation, monkeypatch):
    few = train.filter("tie < 800")
    for slice_rows in (50_000, 300):
        monkeypatch.setattr(model, "_TREE_ROWS", slice_rows)
        one, other = (
            model.fit_boosted_trees(few.repartition(parts), COLUMNS, trees=4).raw_scores(validation).select("tie", "score").collect()
            for parts in (1, 7)
        )
        assert sorted(one) == sorted(other) and len({row["score"] for row in one}) > 10


def test_settled_rows_are_all_rows(spark, monkeypatch):
    monkeypatch.setattr(model, "_TREE_ROWS", 20)
    rows = spark.createDataFrame([(float(i % 3 if i < 90 else 7), i % 2) for i in range(110)], "a double, label int")
    given = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows).select("features", "label")
    kept = [
        model._settled(given.repartition(parts), 110).select(F.spark_partition_id(), vector_to_array("features")[0], "label").collect()
        for parts in (1, 5)
    ]
    assert kept[0] == kept[1] and sorted(row[1:] for row in kept[0]) == sorted(tuple(row) for row in rows.collect())
    assert [sum(row[0] == part for row in kept[0]) for part in range(6)] == [18, 19, 19, 18, 18, 18]


def test_selection_tie_goes_to_the_later_name(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.4)], "candidate string, pr_auc double")
    assert model.select_model(df).first()["candidate"] == "b"


def test_calibration(train, validation, logistic):
    calibrated = model.fit_calibration(logistic, validation)
    raw, after = logistic.raw_scores(validation), calibrated.raw_scores(validation)
    gain = {r["scores"]: r["brier"] for r in model.calibration_gain(raw, after).collect()}
    assert gain["after"] < gain["before"]
    rate = validation.agg(F.avg("label")).first()[0]
    assert after.agg(F.avg("score")).first()[0] == pytest.approx(rate, abs=0.01)
    both = raw.select("tie", F.col("score").alias("r")).join(after.select("tie", "score"), "tie")
    assert both.agg(F.corr(F.log(F.col("r") / (1 - F.col("r"))), F.log(F.col("score") / (1 - F.col("score"))))).first()[0] > 0.999
    assert evaluation.score_metrics(raw.select("label", "score")).first()["roc_auc"] == pytest.approx(
        evaluation.score_metrics(after.select("label", "score")).first()["roc_auc"]
    )


def test_trees_can_be_calibrated(train, validation):
    trees = model.fit_boosted_trees(train, COLUMNS, trees=5)
    after = model.fit_calibration(trees, validation).raw_scores(validation)
    assert after.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_saved_model_scores_alike(spark, train, validation, logistic, tmp_path):
    calibrated = model.fit_calibration(logistic, validation)
    model.save_model(calibrated, str(tmp_path / "model"))
    loaded = model.load_model(spark, str(tmp_path / "model"))
    assert loaded.feature_names == logistic.feature_names and loaded.name == "logistic_regression_calibrated"
    one, other = (m.raw_scores(validation).select("tie", "score") for m in (calibrated, loaded))
    assert one.exceptAll(other).isEmpty()


def test_refit_gives_the_same_scores(train, validation, logistic):
    again = model.fit_logistic(train, COLUMNS).raw_scores(validation).select("tie", "score")
    assert again.exceptAll(logistic.raw_scores(validation).select("tie", "score")).isEmpty()


def test_interpretation(validation, logistic):
    odds = model.odds_ratios(logistic, 3).collect()
    assert {r["feature"] for r in odds[:2]} == {"x", "ind_a_ult1"} and len(odds) == 3
    assert odds[0]["odds_ratio"] == pytest.approx(np.exp(odds[0]["log_odds"]))
    table = model.permutation_importance(logistic, validation, COLUMNS.all, ["tie"], repeats=3).collect()
    assert len(table) == 5 and table[0]["feature"] == "x" and table[0]["pr_auc_drop_mean"] > 0.05
    drops = {r["feature"]: r["pr_auc_drop_mean"] for r in table}
    assert abs(drops["z"]) < 0.02 < drops["ind_a_ult1"]


def test_rule_and_weights(spark, train):
    rows = [(1, 1, 3), (1, 1, 2), (0, 1, 3), (1, 0, 3), (None, 1, 3)]
    df = spark.createDataFrame(rows, "is_active int, pay int, n_products int")
    assert [r["score"] for r in model.rule_baseline(df, "pay").collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    counts = model.class_weights(train).first()
    assert counts["positive_weight"] == pytest.approx(counts["negatives"] / counts["positives"])
    with pytest.raises(ValueError, match="one class"):
        model.fit_logistic(train.filter("label = 0"), COLUMNS)


def brute_stumps(x, y, w, names, rounds, rate, penalty):
    """Every column, every value, no running sums."""
    margin, found = np.zeros(len(y)), []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margin))
        g, h = w * (chance - y), w * chance * (1 - chance)
        best = None
        for place, name in enumerate(names):
            for cut in sorted(set(x[:, place]))[:-1]:
                left = x[:, place] <= cut
                sides = [(g[m].sum(), h[m].sum()) for m in (left, ~left, left | ~left)]
                low, high, whole = (a * a / (b + penalty) for a, b in sides)
                key = (-round(low + high - whole, 9), name, cut)
                if best is None or key < best[0]:
                    best = (key, place, cut, *(-rate * a / (b + penalty) for a, b in sides[:2]))
        if best is None:
            break
        found.append(best[1:])
        margin = margin + np.where(x[:, best[1]] <= best[2], best[3], best[4])
    return found


def test_stumps_against_brute_force(spark, train, validation):
    from panelmill.operators.stumps import boosted_stumps

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 4, 300), rng.integers(0, 2, 300), rng.normal(size=300).round(1)]).astype(float)
    x = np.column_stack([x, 1 - x[:, 1], np.full(300, 7.0)])  # a mirrored column ties, a constant one has no split
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 1.5 + x[:, 1])))).astype(float)
    w = np.where(y == 1, 2.0, 1.0)
    names = ["b", "d", "a", "c", "e"]
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), float(w[i])) for i in range(300)], "x array<double>, y double, w double")
    found = boosted_stumps(df, names, 4, 0.3, 1.0)
    for stump, expected in zip(found, brute_stumps(x, y, w, names, 4, 0.3, 1.0), strict=True):
        assert (stump.place, stump.threshold) == expected[:2] and (stump.low, stump.high) == pytest.approx(expected[2:])
    assert boosted_stumps(df.select(F.array(F.lit(1.0)).alias("x"), "y", "w"), ["one"], 3, 0.3, 1.0) == []
    assert boosted_stumps(df.limit(0), names, 3, 0.3, 1.0) == []

    fitted = model.fit_boosted_stumps(train, COLUMNS, rounds=4)
    after = model.fit_calibration(fitted, validation).raw_scores(validation)
    metrics = evaluation.score_metrics(after.select("label", "score")).first()
    assert metrics["roc_auc"] > 0.7 and after.columns == [*validation.columns, "score"]

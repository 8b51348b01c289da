from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import features
from panelmill.schema import Splits

SPLITS = Splits(train=(3, 5), validation=(6, 6), test=(7, 8))
TARGET = "ind_b_ult1"


@pytest.fixture(scope="module")
def panel_rows():
    rng = random.Random(11)
    rows = []
    for customer in range(1, 61):
        for month in sorted(rng.sample(range(10), rng.randint(5, 10))):
            flags = [int(rng.random() < 0.4) for _ in range(3)]
            rows.append(
                dict(
                    customer_id=customer,
                    month_index=month,
                    ind_a_ult1=flags[0],
                    ind_b_ult1=flags[1],
                    ind_c_ult1=flags[2],
                    is_active=rng.choice([0, 1, None]),
                    seniority_months=rng.choice([None, 5, 50]),
                    is_new_customer=0,
                    segment=rng.choice([None, "x", "y"]),
                    relation_type="A",
                    age=rng.choice([None, 20, 25, 34, 35, 45, 55, 65]),
                    sex=rng.choice([None, "H"]),
                    channel=f"k{customer % 15}",
                    income=rng.choice([None, 0.0, 99.0]),
                )
            )
    return rows


@pytest.fixture(scope="module")
def panel(spark, panel_rows):
    schema = (
        "customer_id bigint, month_index int, ind_a_ult1 tinyint, ind_b_ult1 tinyint, ind_c_ult1 tinyint, is_active tinyint, "
        "seniority_months int, is_new_customer tinyint, segment string, relation_type string, age int, sex string, "
        "channel string, income double"
    )
    rows = [tuple(row.values()) for row in panel_rows]
    return spark.createDataFrame(rows, schema).withColumn("income_missing", F.col("income").isNull()).persist()


@pytest.fixture(scope="module")
def dataset(panel):
    return features.propensity_dataset(panel, TARGET, SPLITS).persist()


def brute_force(rows):
    """Every feature row from the rows up to t (and t + 1 for labels), one customer and month at a time."""
    by_key = {(r["customer_id"], r["month_index"]): r for r in rows}
    flags = ("ind_a_ult1", "ind_b_ult1", "ind_c_ult1")

    def held(row):
        return sum(row[flag] for flag in flags)

    def moved(customer, month, delta):
        now, before = by_key.get((customer, month)), by_key.get((customer, month - 1))
        return sum(now[f] - before[f] == delta for f in flags) if now and before else 0

    out = {}
    for (customer, t), row in by_key.items():
        after = by_key.get((customer, t + 1))
        if not 3 <= t <= 8 or after is None:
            continue
        window = [m for m in (t - 2, t - 1, t) if (customer, m) in by_key]
        p1, p3 = by_key.get((customer, t - 1)), by_key.get((customer, t - 3))
        out[customer, t] = dict(
            split="train" if t <= 5 else "validation" if t == 6 else "test",
            label_month=t + 1,
            adopts_target=int(row[TARGET] == 0 and after[TARGET] == 1),
            adopts_any=int(moved(customer, t + 1, 1) > 0),
            held_target_before_t=int(any(r[TARGET] for (c, m), r in by_key.items() if c == customer and m < t)),
            n_products=held(row),
            n_products_change_1m=held(row) - held(p1) if p1 else None,
            n_products_change_3m=held(row) - held(p3) if p3 else None,
            months_since_first_seen=t - min(m for c, m in by_key if c == customer),
            adoptions_last_3m=sum(moved(customer, m, 1) for m in window),
            attritions_last_3m=sum(moved(customer, m, -1) for m in window),
            active_months_last_3m=sum(by_key[customer, m]["is_active"] or 0 for m in window),
            segment=row["segment"] or "unknown",
            sex=row["sex"] or "unknown",
        )
    return out


def test_against_brute_force(dataset, panel_rows):
    expected = brute_force(panel_rows)
    found = {(r["customer_id"], r["feature_month"]): r for r in dataset.collect()}
    assert set(found) == set(expected)
    for key, values in expected.items():
        assert {name: found[key][name] for name in values} == values


def test_bands_and_income(dataset, panel_rows):
    ages = {(r["customer_id"], r["month_index"]): (r["age"], r["income"]) for r in panel_rows}
    bands = {None: "unknown", 20: "under 25", 25: "25-34", 34: "25-34", 35: "35-44", 45: "45-54", 55: "55-64", 65: "65+"}
    logs = {None: None, 0.0: 0.0, 99.0: pytest.approx(4.605170185988092)}
    for row in dataset.collect():
        age, income = ages[row["customer_id"], row["feature_month"]]
        assert row["age_band"] == bands[age] and row["log_income"] == logs[income]
        assert row["income_missing"] == int(income is None)


def test_income_below_the_logarithm(spark):
    df = spark.createDataFrame([(-1.0,)], "x double")
    assert df.select(features.log_income(F.col("x"))).first()[0] == float("-inf")
    with pytest.raises(Exception, match="below -1"):
        spark.createDataFrame([(-2.0,)], "x double").select(features.log_income(F.col("x"))).collect()


def test_target_and_labels_are_no_features(dataset):
    used = {*features.NUMERIC_FEATURES, *features.BINARY_FEATURES, *features.CATEGORICAL_FEATURES}
    flags = {name for name in dataset.columns if name.startswith("ind_")}
    assert flags == {"ind_a_ult1", "ind_c_ult1"}
    assert set(dataset.columns) == {
        *features.ID_COLUMNS, *features.LABEL_COLUMNS, features.SEGMENT_COLUMN, *used, *flags,
    }
    assert dataset.filter("label_month <> feature_month + 1").isEmpty()


def test_later_periods_are_compared_in_tasks_of_bounded_rows(panel, monkeypatch):
    """The rows per task are fixed, and a row that differs comes once from each side, as often as it is there."""
    monkeypatch.setattr(features, "_ROWS_A_TASK", 10, raising=False)
    earlier = features.scramble_after(panel, 5)
    found = features.leakage_difference(panel, earlier, TARGET, SPLITS, 6)

    def rows(source):
        return features.propensity_dataset(source, TARGET, SPLITS).filter("feature_month <= 6").drop("adopts_target", "adopts_any")

    one, other = rows(panel), rows(earlier)
    expected = one.exceptAll(other).unionByName(other.exceptAll(one))
    assert found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    twice = features.leakage_difference(panel, panel.limit(0), TARGET, SPLITS, 6)
    assert sorted(map(str, twice.collect())) == sorted(map(str, one.collect()))
    assert found.rdd.getNumPartitions() >= panel.count() // 10 > 1


def test_later_periods_do_not_leak(panel):
    scrambled = features.scramble_after(panel, 6)
    assert features.leakage_difference(panel, scrambled, TARGET, SPLITS, 6).isEmpty()
    # The comparison does notice a change inside the feature period.
    earlier = features.scramble_after(panel, 5)
    assert not features.leakage_difference(panel, earlier, TARGET, SPLITS, 6).isEmpty()
    labels = ["customer_id", "feature_month", "adopts_target"]
    at = [
        features.propensity_dataset(p, TARGET, SPLITS).filter("feature_month = 6").select(*labels)
        for p in (panel, scrambled)
    ]
    assert not at[0].exceptAll(at[1]).isEmpty()


def test_sampling_keeps_the_rows_of_whole_customers(panel, dataset):
    part = features.propensity_dataset(panel, TARGET, SPLITS, 0.5)
    assert 0 < part.count() < dataset.count()
    assert part.exceptAll(dataset).isEmpty()
    shared = part.select("customer_id").distinct()
    assert dataset.join(shared, "customer_id", "left_semi").count() == part.count()


def test_splits_and_target(dataset):
    summary = features.require_splits(features.split_summary(dataset))
    rows = {r["split"]: r for r in summary.collect()}
    assert sum(r["rows"] for r in rows.values()) == dataset.count()
    with pytest.raises(ValueError, match="validation"):
        features.require_splits(features.split_summary(dataset.filter("split <> 'validation'")))
    assert features.target_rate(dataset, 0.0).first()["target_mode"] == "product"
    assert features.target_rate(dataset, 0.99).first()["target_mode"] == "any"
    assert features.model_rows(dataset, "product").filter("holds_target_at_t = 1").isEmpty()
    assert features.model_rows(dataset, "any").count() == dataset.count()
    with pytest.raises(ValueError):
        features.model_rows(dataset, "both")


def test_one_exchange_for_all_features(panel, tmp_path, spark):
    path = str(tmp_path / "panel")
    panel.write.parquet(path)
    plan = features.propensity_dataset(spark.read.parquet(path), TARGET, SPLITS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert "LessThanOrEqual(month_index,9)" in text.split("PushedFilters")[1]

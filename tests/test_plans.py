from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import tables
from panelmill.plans.analysis import analyse, write_csv
from panelmill.plans.training import train_and_evaluate
from panelmill.schema import Catalogue
from tests import planted


def test_all_results_and_repeatable_csv(warehouse, tmp_path):
    results = analyse(warehouse)
    assert set(results) == {
        "event_summary", "penetration", "transitions", "ladder_funnel", "time_to_next", "cohort_retention",
        "engagement", "value_proxy", "events_by_product", "penetration_latest", "top_transitions", "ladder_proposal",
        "adopter_share", "cohort_matrix", "value_by_dimension", "engagement_trend_ends",
    }
    for name in ("cohort_retention", "engagement"):
        texts = []
        for run in ("one", "two"):
            write_csv(name, results[name], str(tmp_path / run))
            (part,) = (tmp_path / run / name).glob("part-*.csv")
            texts.append(part.read_text())
        assert texts[0] == texts[1] and texts[0].count("\n") > 5
    assert "2015-01,2,0,2,1.000000," in texts[0] or "month" in texts[0]
    rates = results["engagement"].filter("engagement_rate NOT BETWEEN engagement_rate_ci_lower AND engagement_rate_ci_upper")
    assert rates.isEmpty()


def test_no_funnel_without_a_ladder(warehouse):
    import dataclasses

    bare = dataclasses.replace(warehouse, catalogue=Catalogue(planted.CATALOGUE.products))
    assert "ladder_funnel" not in analyse(bare)


def test_training_flow(spark, monkeypatch):
    from panelmill.operators import order_index

    built = []
    make = order_index.order_index
    monkeypatch.setattr("panelmill.operators.evaluation.order_index", lambda *a, **b: built.append(1) or make(*a, **b))
    panel = tables.stg_panel(spark, "/root/testdata/sf0.01")
    report, fitted = train_and_evaluate(
        panel, tables.TARGET, tables.EV_SPLITS, "ind_signup_ult1", trees=3, resamples=20
    )
    assert report["target"].first()["target_mode"] == "product"
    test = report["test_metrics"].filter("metric = 'roc_auc'").first()
    assert 0 < test["lower"] <= test["estimate"] <= test["upper"] < 1
    assert report["lift"].agg(F.sum("rows")).first()[0] == report["per_month"].agg(F.sum("rows")).first()[0]
    gain = {row["scores"]: row["brier"] for row in report["calibration_gain"].collect()}
    assert gain["after"] <= gain["before"] + 1e-9
    assert report["capacity"].count() == 5 and report["permutation_importance"].count() == 15
    assert fitted.name.endswith("_calibrated")
    assert len(built) == 1  # one order for threshold, lift, calibration, capacity and bootstrap
    beaten = report["against_baselines"].first()
    best = report["baselines_validation"].agg(F.max("pr_auc")).first()[0]
    assert beaten["baseline_pr_auc"] == best and beaten["beats_baselines"] == (beaten["selected_pr_auc"] > best)
    rule = report["baselines_test"].filter("candidate = 'rule'").first()
    assert rule["brier"] is None and 0 <= rule["share_selected"] <= 1
    rates = {row["split"]: row for row in report["population"].collect()}
    assert set(rates) == {"train", "validation", "test"}
    assert rates["test"]["rows"] == report["per_month"].agg(F.sum("rows")).first()[0]


@pytest.mark.parametrize("bad", [(3, 18, 18, 22), (2, 18, 19, 22)])
def test_bad_splits_stop_the_training(spark, bad):
    from panelmill.schema import Splits

    splits = Splits((bad[0], bad[1]), (bad[2], bad[3]), (23, 28))
    with pytest.raises(ValueError):
        train_and_evaluate(spark.range(1), tables.TARGET, splits, "x")


def test_stored_layout_saves_shuffles(warehouse):
    from panelmill.operators.events import flag_changes

    def plan(df):
        return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]

    assert "Exchange" not in plan(flag_changes(warehouse.fact))
    latest = warehouse.by_month.filter(F.col("month_index") == 16)
    assert "PartitionFilters: [isnotnull(month_index" in plan(latest)
    assert warehouse.changes.exceptAll(flag_changes(warehouse.fact)).isEmpty()


def test_a_failed_rebuild_leaves_the_last_one(spark, warehouse, tmp_path):
    from panelmill.plans.star_schema import build_warehouse, open_warehouse

    raw = tables.raw_panel(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "w")
    build_warehouse(spark, raw, tables.EV_CATALOGUE, tables.RAW_FIRST_MONTH, path, buckets=4)
    with pytest.raises(Exception):  # noqa: B017
        build_warehouse(spark, raw.drop("renta"), tables.EV_CATALOGUE, tables.RAW_FIRST_MONTH, path, buckets=4)
    again = open_warehouse(spark, tables.EV_CATALOGUE, tables.RAW_FIRST_MONTH, path)
    assert again.fact.count() == raw.count() == again.by_month.count()


def test_files_follow_counts_and_catalogue(warehouse, tmp_path):
    results = analyse(warehouse)
    for name in ("transitions", "penetration"):
        write_csv(name, results[name], str(tmp_path), warehouse.catalogue)
    lines = {
        name: next((tmp_path / name).glob("part-*.csv")).read_text().splitlines() for name in ("transitions", "penetration")
    }
    at = lines["transitions"][0].split(",").index("transitions")
    counts = [int(line.split(",")[at]) for line in lines["transitions"][1:]]
    assert counts == sorted(counts, reverse=True)
    at = lines["penetration"][0].split(",").index("product_code")
    codes = [product.code for product in warehouse.catalogue.products]
    assert [line.split(",")[at] for line in lines["penetration"][1 : len(codes) + 1]] == codes

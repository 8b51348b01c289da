from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelmill.functions.statistics import with_wilson
from panelmill.operators import events, journeys, portfolio
from panelmill.schema import Catalogue, LadderStep, Product
from tests import planted


@pytest.fixture(scope="module")
def product_events(changes):
    return events.product_events(changes)


@pytest.fixture(scope="module")
def shares(warehouse):
    return portfolio.penetration(warehouse.fact, warehouse.periods, planted.CATALOGUE)


def test_transitions(product_events):
    found = {
        (row["from_product"], row["to_product"]): row
        for row in journeys.transitions(product_events, planted.CATALOGUE).collect()
    }
    assert set(found) == {(planted.E_ACCOUNT, planted.CARD), (planted.E_ACCOUNT, planted.DEBIT)}
    card = found[planted.E_ACCOUNT, planted.CARD]
    assert (card["customers"], card["transitions"], card["median_months_between"], card["share_of_from"]) == (1, 1, 3.0, 0.5)
    assert (card["from_name"], card["to_name"]) == ("E-account", "Credit card")
    assert found[planted.E_ACCOUNT, planted.DEBIT]["median_months_between"] == 2.0


def test_transitions_between_sets_of_products(spark):
    """Two products, then two others: four pairs; the same month is no transition; hot pairs count rows."""
    rows = [(c, m, p, "adoption", "first") for c in (1, 2) for m, p in ((1, "a"), (1, "b"), (4, "c"), (4, "d"))]
    rows += [(3, 2, "a", "adoption", "first"), (3, 3, "a", "adoption", "repeat"), (3, 5, "b", "adoption", "first")]
    df = spark.createDataFrame(
        rows, "customer_id bigint, month_index int, product_code string, event_type string, adoption_kind string"
    )
    catalogue = Catalogue(tuple(Product(code, code.upper(), "f") for code in "abcd"))
    found = {
        (r["from_product"], r["to_product"]): (r["customers"], r["transitions"], r["median_months_between"])
        for r in journeys.transitions(df, catalogue).collect()
    }
    assert found == {
        ("a", "c"): (2, 2, 3.0), ("a", "d"): (2, 2, 3.0), ("b", "c"): (2, 2, 3.0), ("b", "d"): (2, 2, 3.0),
        ("a", "b"): (1, 1, 3.0),
    }


def test_funnel(warehouse):
    funnel = with_wilson(
        journeys.ladder_funnel(warehouse.fact, warehouse.entities, planted.CATALOGUE),
        "reached", "previous_reached", "conversion_rate",
    )
    rows = funnel.collect()
    overall = sorted((r["step"], r["previous_reached"], r["reached"]) for r in rows if r["dimension"] == "all")
    assert overall == [(1, 40, 40), (2, 40, 7), (3, 7, 1)]
    for dimension in ("segment", "channel"):
        for step, _, reached in overall:
            part = [r for r in rows if r["dimension"] == dimension and r["step"] == step]
            assert sum(r["reached"] for r in part) == reached and sum(r["customers"] for r in part) == 40
    groups = {(r["dimension"], r["group_value"]) for r in rows}
    for group in groups:
        counts = [r["reached"] for r in sorted(rows, key=lambda r: r["step"]) if (r["dimension"], r["group_value"]) == group]
        assert counts == sorted(counts, reverse=True)
    for row in rows:
        if row["conversion_rate"] is not None:
            assert row["conversion_rate_ci_lower"] <= row["conversion_rate"] <= row["conversion_rate_ci_upper"]
        else:
            assert row["previous_reached"] == 0
    assert {r["group_value"] for r in rows if r["dimension"] == "channel"} == {"KAT", "KFC", "KHE"}


def test_small_channels_become_other(warehouse):
    groups = journeys.entity_groups(warehouse.entities, 1).filter("dimension = 'channel'")
    assert {row["group_value"]: row["count"] for row in groups.groupBy("group_value").count().collect()} == {
        "KAT": 20, "other": 20,
    }


def test_no_ladder_no_funnel(warehouse):
    assert journeys.ladder_funnel(warehouse.fact, warehouse.entities, Catalogue(planted.CATALOGUE.products)) is None


def test_ladder_reach_against_brute_force(spark):
    rng = random.Random(3)
    catalogue = Catalogue(
        tuple(Product(f"ind_{c}_ult1", c, "f") for c in "abcd"),
        (LadderStep("1", ("ind_a_ult1",)), LadderStep("2", ("ind_b_ult1", "ind_c_ult1")), LadderStep("3", ("ind_d_ult1",))),
    )
    rows = [
        (c, m, *[int(rng.random() < 0.15) for _ in range(4)]) for c in range(80) for m in rng.sample(range(15), 10)
    ]
    df = spark.createDataFrame(
        rows, "customer_id bigint, month_index int, ind_a_ult1 int, ind_b_ult1 int, ind_c_ult1 int, ind_d_ult1 int"
    )
    expected = {}
    for customer in range(80):
        own = sorted(row[1:] for row in rows if row[0] == customer)
        reached, at = [], -1
        for held in (lambda f: f[0], lambda f: f[1] or f[2], lambda f: f[3]):
            at = min((m for m, *f in own if held(f) and at is not None and m >= at), default=None)
            reached.append(at)
        if any(any(f) for _, *f in own):
            expected[customer] = tuple(reached)
    found = {r["customer_id"]: tuple(r)[1:] for r in journeys.ladder_reach(df, catalogue).collect()}
    assert found == expected


def test_time_to_next(product_events, warehouse):
    times = journeys.time_to_next(product_events, warehouse.entities).orderBy("months_to_first_adoption").collect()
    assert [(r["months_to_first_adoption"], r["customers"]) for r in times] == [(1, 3), (2, 2)]
    assert [r["cumulative_share"] for r in times] == pytest.approx([0.6, 1.0])
    assert {(r["median_months"], r["customers_observed"]) for r in times} == {(1.0, 40)}
    share = journeys.adopter_share(journeys.time_to_next(product_events, warehouse.entities)).first()
    assert (share["adopters"], share["observed"], share["adopter_share"]) == (5, 40, 0.125)


def test_cohorts(warehouse):
    retention = journeys.cohort_retention(warehouse.fact, warehouse.entities, warehouse.periods, warehouse.first_month)
    rows = retention.orderBy("join_month", "months_since_join").collect()
    counts = {}
    for row in rows:
        counts.setdefault((row["join_month"], row["cohort_size"]), []).append(row["retained"])
    assert counts == {("2015-01", 2): [2, 2, 2, 2, 1, 1], ("2015-03", 1): [1, 1, 1, 1]}
    matrix = {row["join_month"]: row for row in journeys.cohort_matrix(retention).collect()}
    assert (matrix["2015-01"]["k_0"], matrix["2015-01"]["k_12"]) == (1.0, None)
    assert matrix["2015-03"]["k_3"] == 1.0 and matrix["2015-03"]["k_6"] is None


def test_penetration(shares):
    latest = {row["product_name"]: row for row in portfolio.penetration_latest(shares).collect()}
    holders = {name: row["holders"] for name, row in latest.items() if row["holders"]}
    assert holders == {
        "Current account": 39, "Credit card": 2, "E-account": 3, "Direct debit": 4, "Payroll account": 1, "Payroll": 2,
    }
    assert {row["customers"] for row in latest.values()} == {39} and len(latest) == 24
    assert list(latest)[0] == "Current account"


def test_engagement(warehouse):
    rows = portfolio.engagement(warehouse.fact, warehouse.periods).collect()
    held = {r["group_value"]: (r["customers"], r["active"]) for r in rows if r["dimension"] == "products_held"}
    assert held == {"1": (31, 30), "2": (4, 4), "3": (4, 4)}
    assert sum(r["dimension"] == "month" for r in rows) == 6
    assert {r["month_label"] for r in rows if r["dimension"] != "month"} == {"2015-06"}
    tenure = {r["group_value"]: r["customers"] for r in rows if r["dimension"] == "tenure_band"}
    assert tenure == {"unknown": 1, "12-35 months": 13, "36-119 months": 25}
    ends = portfolio.engagement_trend_ends(portfolio.engagement(warehouse.fact, warehouse.periods)).first()
    assert (ends["first_month"], ends["last_month"]) == ("2015-01", "2015-06")
    assert ends["last_rate"] == pytest.approx(38 / 39)


def test_value_proxy(warehouse):
    values = portfolio.value_proxy(warehouse.fact, warehouse.entities, warehouse.periods, planted.CATALOGUE)
    sums = {(r["dimension"], r["group_value"]): r["customers"] for r in portfolio.value_by_dimension(values).collect()}
    assert {k[1]: n for k, n in sums.items() if k[0] == "families_held"} == {"1": 31, "2": 6, "3+": 2}
    bands = {k[1]: n for k, n in sums.items() if k[0] == "income_band"}
    assert bands == {"missing": 2, "Q1": 10, "Q2": 9, "Q3": 9, "Q4": 9}
    assert values.agg(F.sum("share_of_customers")).first()[0] == pytest.approx(1.0)


def test_greedy_ladder(spark, shares, product_events):
    pen = spark.createDataFrame(
        [("2016-05", code, name, rate) for code, name, rate in (
            ("w", "Wallet", 0.8), ("x", "X", 0.3), ("y", "Y", 0.2), ("z", "Z", 0.8))] + [("2016-04", "y", "Y", 0.99)],
        "month_label string, product_code string, product_name string, penetration double",
    )
    pairs = spark.createDataFrame(
        [("w", "x", 3), ("w", "y", 5), ("y", "x", 3), ("x", "z", 4), ("z", "w", 9)],
        "from_product string, to_product string, transitions bigint",
    )
    found = journeys.ladder_proposal(pen, pairs).orderBy("step").collect()
    assert [(r["product_code"], r["transitions_from_ladder"]) for r in found] == [("w", None), ("y", 5), ("x", 6), ("z", 4)]
    assert journeys.ladder_proposal(pen, pairs, 2).count() == 2
    assert journeys.ladder_proposal(pen.limit(0), pairs).isEmpty()
    planted_ladder = journeys.ladder_proposal(shares, journeys.transitions(product_events, planted.CATALOGUE)).collect()
    assert [r["product_code"] for r in planted_ladder] == [planted.CURRENT]


def test_wilson_against_its_equation(spark):
    """The bounds are the roots p of (rate - p)^2 = z^2 p (1 - p) / n."""
    cases = [(15, 59), (0, 10), (10, 10), (3, 0), (1, 1_000_000)]
    df = spark.createDataFrame([(s, n, s / n if n else None) for s, n in cases], "s int, n int, r double")
    out = with_wilson(df, "s", "n", "r")
    assert out.columns == ["s", "n", "r", "r_ci_lower", "r_ci_upper"]
    z = 1.959963984540054
    for row in out.collect():
        if row["n"] == 0:
            assert row["r_ci_lower"] is None and row["r_ci_upper"] is None
            continue
        for bound in (row["r_ci_lower"], row["r_ci_upper"]):
            assert (row["r"] - bound) ** 2 == pytest.approx(z * z * bound * (1 - bound) / row["n"], abs=1e-12)
        assert 0 <= row["r_ci_lower"] <= row["r"] <= row["r_ci_upper"] <= 1

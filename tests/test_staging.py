from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.functions.columns import clean_text, normal_code, to_date, to_double, to_integer, yes_flag
from panelmill.operators.staging import month_index
from tests import planted

D = dt.date


def evaluate(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_integers(spark):
    texts = ["1", " 7 ", "1.0", "1.6", "2.5", "-2.5", "1e2", "+1", "1.", ".5", "1d", "x", "", None, "3000000000", "nan"]
    assert evaluate(spark, to_integer, texts) == [1, 7, 1, 2, 3, -3, 100, 1, 1, 1, None, None, None, None, None, None]
    assert evaluate(spark, lambda v: to_integer(v, "tinyint"), ["127", "128", "-128", "127.4", "127.6"]) == [
        127, None, -128, 127, None,
    ]


def test_doubles(spark):
    texts = ["1.5", "  2 ", "1e3", "1d", "2f", "         NA", "", None]
    assert evaluate(spark, to_double, texts) == [1.5, 2.0, 1000.0, None, None, None, None, None]
    assert evaluate(spark, to_double, ["inf", "-Infinity"]) == [float("inf"), float("-inf")]


def test_dates(spark):
    texts = ["2015-03-05", " 2015-3-5 ", "2015/03/05", "2015", "2015-03", "2015-02-30", "2015-03-05 10:00:00", ""]
    day = D(2015, 3, 5)
    assert evaluate(spark, to_date, texts) == [day, day, day, None, None, None, day, None]


def test_text_codes_and_flags(spark):
    assert evaluate(spark, clean_text, ["  a b ", "   ", "", None, " x "]) == ["a b", None, None, None, "x"]
    codes = evaluate(spark, lambda v: normal_code(v, ("1", "P")), ["1", "1.0", " p ", "2", "1.00", None])
    assert codes == ["1", "1", "P", None, None, None]
    assert evaluate(spark, lambda v: yes_flag(v, "S"), ["S", " S ", "N", "", None]) == [True, True, False, False, None]


def test_month_index_counts_boundaries(spark):
    df = spark.createDataFrame([(D(2015, 1, 31),), (D(2015, 2, 1),), (D(2016, 1, 1),), (D(2014, 12, 31),)], "d date")
    found = [row[0] for row in df.select(month_index(F.col("d"), D(2015, 1, 31))).collect()]
    assert found == [0, 1, 12, -1]


def test_planted_quirks(warehouse):
    rows = {(r["customer_id"], r["month_index"]): r for r in warehouse.stg.collect()}
    assert len(rows) == 235
    assert [rows[1, month]["customer_type"] for month in range(6)] == planted.TYPE_VALUE
    assert rows[9, 0]["income"] is None and rows[9, 0]["income_missing"] is True
    assert rows[10, 0]["income"] is None and rows[10, 0]["province_name"] == "CORUÑA, A"
    assert rows[20, 0]["income"] == 12000.5 and rows[20, 0]["income_missing"] is False
    assert rows[11, 0]["seniority_months"] is None and rows[12, 0]["seniority_months"] == 32
    assert rows[12, 1]["flags_filled_from_null"] == 2 and rows[12, 1][planted.PAYROLL] == 0
    assert rows[14, 3]["join_date"] is None and rows[7, 2]["join_date"] == D(2015, 3, 5)
    assert rows[15, 0]["is_active"] == 0 and rows[7, 2]["is_new_customer"] == 1
    assert rows[1, 0]["is_resident"] is True and rows[1, 0]["is_employee_spouse"] is None


def test_star_schema(warehouse):
    assert {row["table_name"]: row["row_count"] for row in warehouse.row_counts().collect()} == {
        "stg_holdings": 235,
        "fact_monthly_holdings": 235,
        "dim_customer": 40,
        "dim_product": 24,
        "dim_month": 6,
    }
    people = {row["customer_id"]: row for row in warehouse.entities.collect()}
    assert (people[7]["first_seen_month_index"], people[7]["months_present"]) == (2, 4)
    assert people[7]["join_month"] == D(2015, 3, 1) and people[14]["join_date"] is None
    assert people[8]["last_seen_month_index"] == 3 and people[1]["age_at_first_seen"] == 31
    months = warehouse.periods.orderBy("month_index").collect()
    assert [row["month_label"] for row in months] == planted.MONTHS
    assert [row["customers"] for row in months] == planted.ROWS_PER_MONTH
    steps = warehouse.products.filter("ladder_step IS NOT NULL").orderBy("ladder_step", "product_code").collect()
    assert [(row["product_code"], row["ladder_step"]) for row in steps] == [
        (planted.CURRENT, 1),
        (planted.E_ACCOUNT, 2),
        (planted.DEBIT, 2),
        (planted.CARD, 3),
    ]
    kinds = dict(warehouse.fact.dtypes)
    assert kinds["n_products"] == "tinyint" and kinds[planted.CARD] == "tinyint" and kinds["is_active"] == "tinyint"


def test_latest_and_earliest_attributes_skip_nulls(spark):
    from panelmill.operators.warehouse import dim_entity

    rows = [
        (1, 0, None, "A", None, 30, None, None, 10.0),
        (1, 1, None, "B", "V", 31, "P", "K", None),
        (1, 2, D(2014, 5, 20), None, None, None, None, None, None),
        (2, 5, None, None, None, None, None, None, None),
    ]
    schema = (
        "customer_id bigint, month_index int, join_date date, segment string, sex string, age int, "
        "province_name string, channel string, income double"
    )
    found = {row["customer_id"]: row for row in dim_entity(spark.createDataFrame(rows, schema)).collect()}
    one = found[1]
    assert (one["latest_segment"], one["sex"], one["age_at_first_seen"], one["province"]) == ("B", "V", 30, "P")
    assert (one["income"], one["join_month"], one["months_present"]) == (10.0, D(2014, 5, 1), 3)
    assert found[2]["latest_segment"] is None and found[2]["first_seen_month_index"] == 5


def test_catalogue_guards():
    from panelmill.schema import Catalogue, LadderStep, Product, Splits

    products = (Product("a", "A", "f"), Product("b", "B", "f"))
    for ladder in (
        (LadderStep("only", ("a",)),),
        (LadderStep("x", ("a",)), LadderStep("y", ("a",))),
        (LadderStep("x", ("a",)), LadderStep("y", ("c",))),
        (LadderStep("x", ("a",)), LadderStep("y", ())),
    ):
        with pytest.raises(ValueError):
            Catalogue(products, ladder)
    with pytest.raises(ValueError):
        Catalogue((*products, products[0]))
    for splits in (
        Splits((2, 4), (5, 5), (6, 6)),
        Splits((3, 5), (5, 5), (6, 6)),
        Splits((3, 4), (6, 5), (7, 7)),
    ):
        with pytest.raises(ValueError):
            splits.check()
    with pytest.raises(ValueError):
        Splits((3, 4), (5, 5), (6, 6)).check(last_period=6)
    Splits((3, 4), (5, 5), (6, 6)).check(last_period=7)

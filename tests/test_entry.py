"""The registered queries against their SQL answers on the smallest tables.

A selection runs by default; CHECK_ALL=1 runs every query that has an answer.
"""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry_point

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SELECTION = (
    "stg_clean dim_entity quality_summary product_events_gappy transitions ladder_funnel engagement value_proxy "
    "running_total_window propensity_dataset point_metrics capacity_table ingest_typed_csv preprocess_levels"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def test_every_answer_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns[:3] == ["month_label", "product_code", "product_name"] and result.count() > 0


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()) if os.environ.get("CHECK_ALL") else SELECTION)
def test_answer(spark, duck, name):
    found = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    order = [column[0] for column in cursor.description]
    assert sorted(order) == columns
    expected = sorted(tuple(comparable(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(comparable(v) for v in row) for row in found.select(*columns).collect()) == expected

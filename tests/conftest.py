from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import SparkSession

from panelmill.plans.star_schema import build_warehouse
from panelmill.sources.holdings_file import load_checked
from tests import planted


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("panelmill-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write_csv(tmp_path):
    def write(text: str, name: str = "raw.csv") -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode("utf-8"))
        return str(path)

    return write


@pytest.fixture(scope="session")
def warehouse(spark, tmp_path_factory):
    """The planted file, loaded, staged and stored."""
    folder = tmp_path_factory.mktemp("planted")
    source = folder / "raw.csv"
    source.write_text(planted.csv_text(), encoding="utf-8")
    rows, _ = load_checked(spark, str(source), planted.CATALOGUE, planted.MONTHS)
    return build_warehouse(spark, rows, planted.CATALOGUE, dt.date(2015, 1, 1), str(folder / "warehouse"))


@pytest.fixture(scope="session")
def changes(warehouse):
    from panelmill.operators.events import flag_changes

    return flag_changes(warehouse.fact)

"""The warehouse stage: staged panel, dimensions, fact and changes, stored once as one version.

Which plan reads what: entity windows and joins on the entity read `fact`, which is bucketed and sorted by entity, so
they need no shuffle; results of one period read `by_month`, which has a folder per period; event results read the
stored `changes`. A version is visible once it is committed to the log of builds, so a failed rebuild leaves the
last good warehouse in place, and of two rebuilds at once one fails.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.events import flag_changes
from panelmill.operators.staging import stage_snapshots
from panelmill.operators.warehouse import dim_entity, dim_period, dim_product, fact_panel, table_row_counts
from panelmill.schema import ENTITY, PERIOD, Catalogue
from panelmill.sources import commit_log
from panelmill.sources.publishing import stored_files

#: bytes of the staged panel for each bucket of the fact, and the fewest buckets
BUCKET_BYTES, BUCKETS = 128 << 20, 32


@dataclass(frozen=True)
class Warehouse:
    stg: DataFrame
    fact: DataFrame
    entities: DataFrame
    products: DataFrame
    periods: DataFrame
    catalogue: Catalogue
    first_month: dt.date
    by_month: DataFrame | None = None
    changes: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {
            "stg_holdings": self.stg,
            "fact_monthly_holdings": self.fact,
            "dim_customer": self.entities,
            "dim_product": self.products,
            "dim_month": self.periods,
        }

    def row_counts(self) -> DataFrame:
        return table_row_counts(self.tables())


def star_schema(spark: SparkSession, stg: DataFrame, catalogue: Catalogue, first_month: dt.date) -> Warehouse:
    """The tables as plans over one staged panel; nothing runs yet."""
    return Warehouse(
        stg, fact_panel(stg), dim_entity(stg), dim_product(spark, catalogue), dim_period(stg), catalogue, first_month
    )


def build_warehouse(
    spark: SparkSession, raw: DataFrame, catalogue: Catalogue, first_month: dt.date, path: str, buckets: int | None = None
) -> Warehouse:
    """Stage the raw rows and store every table as a new version below `path`.

    The fact has as many buckets as the staged panel's stored bytes ask for, unless `buckets` says otherwise. The rows
    are shuffled by entity once for the staged panel and once for the bucketed fact; the changes then come from the
    fact without another shuffle. A build that fails leaves neither files nor a table.
    """
    base, version = commit_log.last_number(spark, path), uuid.uuid4().hex
    try:
        buckets = _write_tables(spark, raw, catalogue, first_month, f"{path}/versions/{version}", version, buckets)
        commit_log.commit(spark, path, base, {"version": version, "buckets": buckets})
    except Exception:
        drop_version(spark, path, version)
        raise
    for left_over in commit_log.unnamed_versions(spark, path):
        drop_version(spark, path, left_over)
    return open_warehouse(spark, catalogue, first_month, path)


def drop_version(spark: SparkSession, path: str, version: str) -> None:
    """Remove a version's table and files."""
    spark.sql(f"DROP TABLE IF EXISTS {_fact_name(version)}")
    commit_log.remove_folder(spark, f"{path}/versions/{version}")


def _write_tables(
    spark: SparkSession, raw: DataFrame, catalogue: Catalogue, first_month: dt.date, folder: str, version: str, buckets: int | None
) -> int:
    staged = stage_snapshots(raw, first_month)
    staged.hint("rebalance", ENTITY).sortWithinPartitions(ENTITY, PERIOD).write.parquet(f"{folder}/stg")
    if buckets is None:
        size = stored_files(spark, f"{folder}/stg").agg(F.sum("bytes")).first()[0] or 0
        buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    plan = star_schema(spark, spark.read.parquet(f"{folder}/stg"), catalogue, first_month)
    plan.fact.repartition(buckets, ENTITY).write.bucketBy(buckets, ENTITY).sortBy(ENTITY, PERIOD).option(
        "path", f"{folder}/fact"
    ).saveAsTable(_fact_name(version))
    fact = spark.table(_fact_name(version))
    fact.hint("rebalance", PERIOD).write.partitionBy(PERIOD).parquet(f"{folder}/fact_by_month")
    flag_changes(fact).write.parquet(f"{folder}/changes")
    for name in ("entities", "periods", "products"):
        getattr(plan, name).write.parquet(f"{folder}/{name}")
    return buckets


def open_warehouse(spark: SparkSession, catalogue: Catalogue, first_month: dt.date, path: str) -> Warehouse:
    """The newest complete version below `path`."""
    newest = commit_log.newest(spark, path)
    if newest is None:
        raise FileNotFoundError(f"no warehouse was built in {path}")
    folder, name = f"{path}/versions/{newest['version']}", _fact_name(newest["version"])
    stored = spark.read.parquet(f"{folder}/fact")
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in stored.schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({ENTITY}) SORTED BY ({ENTITY}, {PERIOD}) "
            f"INTO {newest['buckets']} BUCKETS LOCATION '{folder}/fact'"
        )
    return Warehouse(
        spark.read.parquet(f"{folder}/stg"),
        spark.table(name),
        *[spark.read.parquet(f"{folder}/{table}") for table in ("entities", "products", "periods")],
        catalogue,
        first_month,
        spark.read.schema(stored.schema).parquet(f"{folder}/fact_by_month"),
        spark.read.parquet(f"{folder}/changes"),
    )


def _fact_name(version: str) -> str:
    return f"panelmill_fact_{version}"

"""The star schema: entity, product and period dimensions and the wide fact panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.columns import row_sum
from panelmill.schema import ENTITY, FLAG_PATTERN, PERIOD, Catalogue, flag_columns

FACT_MEASURES = ("is_active", "seniority_months", "segment", "relation_type", "is_new_customer")

PRODUCT_SCHEMA = (
    "product_code string, product_name string, family string, "
    "ladder_step int, ladder_step_name string, catalogue_order int"
)


def dim_entity(stg: DataFrame) -> DataFrame:
    """One row per entity: join date, periods seen, latest (for age: earliest) known attributes.

    The value of an attribute travels with the period it was seen in, so that one grouped aggregation,
    combined before the shuffle, finds them all.
    """

    def latest(name: str):
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(PERIOD)))

    joined = F.min("join_date")
    return stg.groupBy(ENTITY).agg(
        joined.alias("join_date"),
        F.trunc(joined, "month").alias("join_month"),
        F.min(PERIOD).alias("first_seen_month_index"),
        F.max(PERIOD).alias("last_seen_month_index"),
        F.count(F.lit(1)).alias("months_present"),
        latest("segment").alias("latest_segment"),
        latest("sex").alias("sex"),
        F.min_by(F.col("age"), F.when(F.col("age").isNotNull(), F.col(PERIOD))).alias("age_at_first_seen"),
        latest("province_name").alias("province"),
        latest("channel").alias("channel"),
        latest("income").alias("income"),
    )


def dim_product(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """The catalogue with ladder steps; NULL off the ladder."""
    rows = []
    for order, product in enumerate(catalogue.products, start=1):
        number, name = catalogue.step_of(product.code) or (None, None)
        rows.append((product.code, product.name, product.family, number, name, order))
    return spark.createDataFrame(rows, PRODUCT_SCHEMA)


def dim_period(stg: DataFrame) -> DataFrame:
    """One row per snapshot present."""
    return (
        stg.groupBy(PERIOD, "snapshot_date")
        .agg(F.count(F.lit(1)).alias("customers"))
        .select(PERIOD, "snapshot_date", F.date_format("snapshot_date", "yyyy-MM").alias("month_label"), "customers")
    )


def fact_panel(stg: DataFrame, pattern: str = FLAG_PATTERN) -> DataFrame:
    """Wide fact: flags, their sum and the measures. A projection; the grain stays entity x period."""
    flags = flag_columns(stg, pattern)
    held = row_sum([F.col(flag).cast("int") for flag in flags]).cast("tinyint")
    return stg.select(ENTITY, PERIOD, *flags, held.alias("n_products"), *FACT_MEASURES)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table, long form."""
    counted = [
        table.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, table in tables.items()
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result

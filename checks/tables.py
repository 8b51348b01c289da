"""Panels derived from the driver's tables.

EV: user x day of `events`, one flag per event type, at most 30 days per user. OR: customer x month of
`orders`, one flag per part type or brand bought. RAW: the EV panel rendered as raw snapshot text with
padding, sentinels and missing cells by fixed rules on (user, day), so that staging has real work to do.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.staging import stage_snapshots
from panelmill.plans.star_schema import Warehouse, star_schema
from panelmill.schema import Catalogue, LadderStep, Product, Splits

EVENT_TYPES = ("view", "click", "signup", "purchase", "error")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
BRANDS = tuple(range(1, 26))

EV_FIRST_DAY = dt.date(2024, 1, 1)
RAW_FIRST_DAY = dt.date(2015, 1, 28)
RAW_FIRST_MONTH = dt.date(2015, 1, 1)
OR_FIRST_MONTH = dt.date(1995, 1, 1)

EV_CATALOGUE = Catalogue(
    products=(
        Product("ind_view_ult1", "Page view", "browsing"),
        Product("ind_click_ult1", "Click", "browsing"),
        Product("ind_signup_ult1", "Sign-up", "account"),
        Product("ind_purchase_ult1", "Purchase", "order"),
        Product("ind_error_ult1", "Error", "support"),
    ),
    ladder=(
        LadderStep("Browse", ("ind_view_ult1", "ind_click_ult1")),
        LadderStep("Sign up", ("ind_signup_ult1",)),
        LadderStep("Buy", ("ind_purchase_ult1",)),
        LadderStep("Complain", ("ind_error_ult1",)),
    ),
)
OR_CATALOGUE = Catalogue(
    products=tuple(Product(f"ind_{t.lower()}_ult1", t.title(), "type") for t in PART_TYPES),
    ladder=(LadderStep("Economy", ("ind_economy_ult1",)), LadderStep("Large", ("ind_large_ult1",)),
            LadderStep("Promo or small", ("ind_promo_ult1", "ind_small_ult1"))),
)
EV_SPLITS = Splits(train=(3, 18), validation=(19, 22), test=(23, 28))
TARGET = "ind_purchase_ult1"
EV_FLAG_FEATURES = tuple(p.code for p in EV_CATALOGUE.products if p.code != TARGET)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("tinyint")


def ev_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, month_index (day number), five flags, n_events."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        F.datediff(F.col("ts").cast("date"), F.lit(EV_FIRST_DAY)).alias("month_index"),
        "event_type",
    )
    return events.groupBy("customer_id", "month_index").agg(
        *[_flag(F.col("event_type") == kind).alias(f"ind_{kind}_ult1") for kind in EVENT_TYPES],
        F.count(F.lit(1)).alias("n_events"),
    )


def _orders_lines(spark: SparkSession, sf_dir: str, attribute: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("customer_id"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("month_index"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", attribute)
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("customer_id", "month_index", attribute)
    )


def or_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, month_index (month number), one flag per part type."""
    lines = _orders_lines(spark, sf_dir, "p_type")
    return lines.groupBy("customer_id", "month_index").agg(
        *[_flag(F.col("p_type") == kind).alias(f"ind_{kind.lower()}_ult1") for kind in PART_TYPES]
    )


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, month_index, 25 flags: the wide case."""
    lines = _orders_lines(spark, sf_dir, "p_brand")
    return lines.groupBy("customer_id", "month_index").agg(
        *[_flag(F.col("p_brand") == f"Brand#{number}").alias(f"ind_brand{number:02d}_ult1") for number in BRANDS]
    )


def or_periods(panel: DataFrame) -> DataFrame:
    month = F.add_months(F.lit(OR_FIRST_MONTH), F.col("month_index"))
    return panel.groupBy("month_index").agg(F.count(F.lit(1)).alias("customers")).select(
        "month_index", month.alias("snapshot_date"), F.date_format(month, "yyyy-MM").alias("month_label"), "customers"
    )


def ev_periods(panel: DataFrame) -> DataFrame:
    day = F.date_add(F.lit(EV_FIRST_DAY), F.col("month_index"))
    return panel.groupBy("month_index").agg(F.count(F.lit(1)).alias("customers")).select(
        "month_index", day.alias("snapshot_date"), F.date_format(day, "yyyy-MM-dd").alias("month_label"), "customers"
    )


def with_products(panel: DataFrame) -> DataFrame:
    flags = [name for name in panel.columns if name.startswith("ind_")]
    return panel.withColumn(
        "n_products", reduce(lambda one, other: one + other, [F.col(flag).cast("int") for flag in flags]).cast("tinyint")
    )


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW: the columns of the snapshot file as text, only date, id and flags typed."""
    people = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name")
    )
    panel = ev_panel(spark, sf_dir).join(people, F.col("customer_id") == F.col("c_custkey"))
    k, m, n = F.col("customer_id"), F.col("month_index"), F.col("n_events")

    def text(column: Column) -> Column:
        return column.cast("string")

    def padded(column: Column, width: int) -> Column:
        return F.lpad(text(column), width, " ")

    def one_of(*cases: tuple[Column, Column | str], otherwise: Column | str) -> Column:
        out = None
        for condition, value in cases:
            value = F.lit(value) if isinstance(value, str) else value
            out = F.when(condition, value) if out is None else out.when(condition, value)
        return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)

    joined = F.date_add(F.lit(dt.date(2014, 3, 5)), ((k % 50) * 15).cast("int"))
    code = (k + m) % 7
    return panel.select(
        F.add_months(F.lit(RAW_FIRST_DAY), m).alias("fecha_dato"),
        k.alias("ncodpers"),
        one_of((k % 23 == 0, ""), (k % 10 == 0, " F "), otherwise="N").alias("ind_empleado"),
        one_of((k % 7 == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit(" "))), otherwise="ES").alias("pais_residencia"),
        one_of((k % 31 == 0, "   "), (k % 2 == 1, "H"), otherwise="V").alias("sexo"),
        one_of((k % 37 == 0, " NA"), otherwise=padded(18 + k % 95 + F.floor(m / 12), 3)).alias("age"),
        one_of((k % 31 == 5, ""), (k % 41 == 3, "2015"), otherwise=text(joined)).alias("fecha_alta"),
        one_of(((m < 6) & (k % 5 == 0), " 1"), otherwise=" 0").alias("ind_nuevo"),
        one_of((k % 19 == 0, "-999999"), otherwise=padded(k % 150 + m, 7)).alias("antiguedad"),
        one_of((k % 11 == 0, "99"), otherwise=" 1.0").alias("indrel"),
        one_of((k % 13 == 0, text(F.date_add(F.lit(dt.date(2015, 7, 1)), m))), otherwise="").alias("ult_fec_cli_1t"),
        one_of(
            (code == 0, "1"), (code == 1, "1.0"), (code == 2, "2"), (code == 3, "p"), (code == 4, "3.0"), (code == 5, "9"),
            otherwise=" P ",
        ).alias("indrel_1mes"),
        one_of(((k + m) % 43 == 0, ""), (n >= 2, "A"), otherwise="I").alias("tiprel_1mes"),
        F.when(k % 47 != 0, F.when(k % 9 == 0, "N").otherwise("S")).alias("indresi"),
        one_of((k % 8 == 0, " S "), otherwise="N").alias("indext"),
        F.when(k % 10 == 0, "N").alias("conyuemp"),
        one_of((k % 29 == 0, ""), otherwise=F.col("n_name")).alias("canal_entrada"),
        one_of((k % 97 == 0, "S"), otherwise="N").alias("indfall"),
        one_of((k % 29 == 1, " "), otherwise=" 1").alias("tipodom"),
        padded(F.col("c_nationkey") + 1, 2).alias("cod_prov"),
        F.concat(F.lit("CITY, "), text(F.col("c_nationkey")), F.lit("  ")).alias("nomprov"),
        one_of(((k + m) % 29 == 0, ""), (n >= 2, " 1"), otherwise=" 0").alias("ind_actividad_cliente"),
        one_of((k % 12 == 0, "         NA"), otherwise=text(F.abs(F.col("c_acctbal")))).alias("renta"),
        one_of((k % 17 == 0, ""), otherwise=F.col("c_mktsegment")).alias("segmento"),
        *[F.col(f"ind_{kind}_ult1") for kind in EVENT_TYPES[:3]],
        F.when((k + 2 * m) % 33 != 0, F.col("ind_purchase_ult1")).alias("ind_purchase_ult1"),
        F.when((3 * k + m) % 25 != 0, F.col("ind_error_ult1")).alias("ind_error_ult1"),
    )


def stg_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_snapshots(raw_panel(spark, sf_dir), RAW_FIRST_MONTH)


def ev_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return star_schema(spark, stg_panel(spark, sf_dir), EV_CATALOGUE, RAW_FIRST_MONTH)


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, score (few distinct values), unique tie, cluster and two groupings, from every event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tie"),
        F.col("user_id").alias("customer_id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        (F.floor(F.col("value") / 50) / 10).alias("score"),
        F.floor(F.datediff(F.col("ts").cast("date"), F.lit(EV_FIRST_DAY)) / 10).cast("int").alias("label_month"),
        F.when(F.col("user_id") % 4 == 0, "held before").otherwise("never held").alias("segment"),
        (F.col("event_id") % 4).cast("double").alias("weight"),
    )

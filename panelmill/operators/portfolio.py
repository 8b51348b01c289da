"""Portfolio views of the panel: penetration, engagement and the value proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import count_where, ratio, row_any, row_sum
from panelmill.operators.ranking import ntile, with_rank
from panelmill.schema import ENTITY, PERIOD, Catalogue


def penetration(fact: DataFrame, periods: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Holders and their share of the entities present, per period and product.

    The panel is summed while it is wide; only the summed rows, one per period, are turned long.
    """
    shown = [product for product in catalogue.products if product.code in fact.columns]
    codes = [product.code for product in shown]
    summed = fact.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("customers"), *[F.sum(F.col(code)).alias(code) for code in codes]
    )
    long = F.array(
        *[
            F.struct(
                F.lit(p.code).alias("product_code"),
                F.lit(p.name).alias("product_name"),
                F.lit(p.family).alias("family"),
                F.col(p.code).alias("holders"),
            )
            for p in shown
        ]
    )
    return (
        summed.select(PERIOD, "customers", F.inline(long))
        .filter("holders IS NOT NULL")
        .join(periods.select(PERIOD, "month_label"), PERIOD)
        .select(
            "month_label",
            "product_code",
            "product_name",
            "family",
            "holders",
            "customers",
            ratio(F.col("holders"), F.col("customers")).alias("penetration"),
        )
    )


def penetration_latest(shares: DataFrame) -> DataFrame:
    """The latest period, most held product first."""
    latest = shares.agg(F.max("month_label").alias("month_label"))
    return (
        shares.join(latest, "month_label")
        .select("month_label", "product_name", "family", "holders", "customers", "penetration")
        .orderBy(F.desc("penetration"), "product_name")
    )


def _tenure_band(months: Column) -> Column:
    # Tenure bands.
    return (
        F.when(months.isNull(), "unknown")
        .when(months < 12, "00-11 months")
        .when(months < 36, "12-35 months")
        .when(months < 120, "36-119 months")
        .otherwise("120+ months")
    )


def engagement(fact: DataFrame, periods: DataFrame) -> DataFrame:
    """Active share per period, and for the latest period by segment, tenure and products held.

    The panel is scanned once into counts per period and band; every breakdown is summed from those.
    """
    held = F.when(F.col("n_products") >= 4, "4+").otherwise(F.col("n_products").cast("string"))
    counts = fact.groupBy(
        PERIOD,
        F.coalesce(F.col("segment"), F.lit("unknown")).alias("segment"),
        _tenure_band(F.col("seniority_months")).alias("tenure_band"),
        held.alias("products_held"),
    ).agg(F.count(F.lit(1)).alias("customers"), count_where(F.col("is_active") == 1).alias("active"))

    latest = F.col(PERIOD) == periods.agg(F.max(PERIOD)).scalar()
    labelled = counts.join(periods.select(PERIOD, "month_label"), PERIOD).withColumn("_latest", latest)

    def view(order: int, dimension: str, value: Column) -> Column:
        return F.struct(
            F.lit(order).alias("dimension_order"), F.lit(dimension).alias("dimension"), value.alias("group_value")
        )

    trend = view(1, "month", F.col("month_label"))
    breakdowns = [view(n, name, F.col(name)) for n, name in enumerate(("segment", "tenure_band", "products_held"), 2)]
    views = F.when(F.col("_latest"), F.array(trend, *breakdowns)).otherwise(F.array(trend))
    return (
        labelled.select("month_label", "customers", "active", F.inline(views))
        .groupBy("dimension_order", "dimension", "group_value", "month_label")
        .agg(F.sum("customers").alias("customers"), F.sum("active").alias("active"))
        .select(
            "dimension",
            "group_value",
            "month_label",
            "customers",
            "active",
            ratio(F.col("active"), F.col("customers")).alias("engagement_rate"),
        )
    )


def engagement_trend_ends(rates: DataFrame) -> DataFrame:
    """First and last point of the trend."""
    return rates.filter("dimension = 'month'").agg(
        F.min("month_label").alias("first_month"),
        F.min_by("engagement_rate", "month_label").alias("first_rate"),
        F.max("month_label").alias("last_month"),
        F.max_by("engagement_rate", "month_label").alias("last_rate"),
    )


def value_proxy(fact: DataFrame, entities: DataFrame, periods: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Latest period by income quartile, activity and product families held.

    Families are counted within the row, because the panel is wide. Quartiles rank the known incomes,
    ties in order of the entity, without a single-task sort.
    """
    families = [row_any([F.col(code) == 1 for code in codes]).cast("int") for codes in catalogue.families.values()]
    activity = F.when(F.col("is_active") == 1, "active").when(F.col("is_active") == 0, "inactive").otherwise("unknown")
    latest = fact.filter(F.col(PERIOD) == periods.agg(F.max(PERIOD)).scalar()).select(
        ENTITY, "n_products", activity.alias("activity"), row_sum(families).alias("families")
    )
    located = latest.join(entities.select(ENTITY, "income"), ENTITY, "left")
    known = with_rank(located.filter("income IS NOT NULL"), [F.asc("income"), F.asc(ENTITY)])
    quartile = ntile(F.col("position"), F.col("position_count"), 4)
    banded = known.withColumn("income_band", F.concat(F.lit("Q"), quartile.cast("string"))).drop(
        "position", "position_count"
    )
    missing = located.filter("income IS NULL").withColumn("income_band", F.lit("missing"))
    held = F.when(F.col("families") >= 3, "3+").otherwise(F.col("families").cast("string"))
    counted = (
        banded.unionByName(missing)
        .groupBy("income_band", "activity", held.alias("families_held"))
        .agg(F.count(F.lit(1)).alias("customers"), F.avg("n_products").alias("avg_products"))
    )
    # At most 5 x 3 x 4 rows are left here.
    return counted.select(
        "income_band",
        "activity",
        "families_held",
        "customers",
        (F.col("customers") / F.sum("customers").over(Window.partitionBy())).alias("share_of_customers"),
        "avg_products",
    )


def value_by_dimension(values: DataFrame) -> DataFrame:
    """Entities and share by families held and by income band, long form."""
    views = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).alias("group_value"))
            for name in ("families_held", "income_band")
        ]
    )
    summed = (
        values.select("customers", F.inline(views))
        .groupBy("dimension", "group_value")
        .agg(F.sum("customers").alias("customers"))
    )
    share = F.col("customers") / F.sum("customers").over(Window.partitionBy("dimension"))
    return summed.withColumn("share", share)

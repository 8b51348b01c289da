"""Flag changes between snapshots, and the adoption and attrition events among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import count_where
from panelmill.schema import ENTITY, FLAG_PATTERN, PERIOD, Catalogue, flag_columns

ADOPTION, ATTRITION = "adoption", "attrition"
EVENT_COUNTS = ("adoptions", "first_adoptions", "repeat_adoptions", "attritions", "changes_across_gaps")


def flag_changes(fact: DataFrame, pattern: str = FLAG_PATTERN) -> DataFrame:
    """Every flag that differs from the entity's previous snapshot, long form.

    The flags cross the shuffle as one byte array, so a row stays narrow however many flags there are,
    and only rows with a change are melted. An entity has one row per period, which bounds the window.
    """
    flags = flag_columns(fact, pattern)
    in_time = Window.partitionBy(ENTITY).orderBy(PERIOD)
    held = fact.select(ENTITY, PERIOD, F.array(*[F.col(flag) for flag in flags]).alias("held"))
    paired = held.select(
        ENTITY,
        PERIOD,
        (F.col(PERIOD) - F.lag(PERIOD).over(in_time)).alias("months_since_previous"),
        "held",
        F.lag("held").over(in_time).alias("before"),
    ).filter(F.col("held") != F.col("before"))
    deltas = F.array(
        *[
            F.struct(
                F.lit(flag).alias("product_code"),
                (F.col("held")[place] - F.col("before")[place]).alias("delta"),
            )
            for place, flag in enumerate(flags)
        ]
    )
    return paired.select(
        ENTITY, PERIOD, "months_since_previous", F.inline(F.filter(deltas, lambda change: change["delta"] != 0))
    )


def classified_changes(changes: DataFrame) -> DataFrame:
    """Changes with their kind. A drop, also one seen across a gap, makes later adoptions repeats.

    Each product of an entity is looked at on its own; the rows already sit together by entity.
    """
    per_product = Window.partitionBy(ENTITY, "product_code")
    delta = F.col("delta")
    first_drop = F.min(F.when(delta == -1, F.col(PERIOD))).over(per_product)
    kind = F.when(delta == -1, None).when(first_drop < F.col(PERIOD), "repeat").otherwise("first")
    return changes.select(
        ENTITY,
        PERIOD,
        "months_since_previous",
        "product_code",
        F.when(delta == 1, ADOPTION).otherwise(ATTRITION).alias("change_type"),
        kind.alias("adoption_kind"),
    )


def product_events(changes: DataFrame) -> DataFrame:
    """Adoptions and attritions between consecutive periods."""
    return (
        classified_changes(changes)
        .filter("months_since_previous = 1")
        .select(ENTITY, PERIOD, "product_code", F.col("change_type").alias("event_type"), "adoption_kind")
    )


def changes_across_gaps(changes: DataFrame) -> DataFrame:
    """Changes whose previous snapshot is more than one period back. Kept, but never counted as events."""
    return changes.filter("months_since_previous > 1").select(
        ENTITY,
        PERIOD,
        "months_since_previous",
        "product_code",
        F.when(F.col("delta") == 1, ADOPTION).otherwise(ATTRITION).alias("change_type"),
    )


def _counts() -> list[Column]:
    event = F.col("months_since_previous") == 1
    adoption = event & (F.col("change_type") == ADOPTION)
    return [
        count_where(adoption).alias("adoptions"),
        count_where(event & (F.col("adoption_kind") == "first")).alias("first_adoptions"),
        count_where(event & (F.col("adoption_kind") == "repeat")).alias("repeat_adoptions"),
        count_where(event & (F.col("change_type") == ATTRITION)).alias("attritions"),
        count_where(F.col("months_since_previous") > 1).alias("changes_across_gaps"),
    ]


def event_summary(changes: DataFrame, periods: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Counts for every period but the first and every product, zero where nothing happened."""
    products = F.array(
        *[F.struct(F.lit(p.code).alias("product_code"), F.lit(p.name).alias("product_name")) for p in catalogue.products]
    )
    grid = periods.filter(F.col(PERIOD) > 0).select(PERIOD, "month_label", F.inline(products))
    counted = classified_changes(changes).groupBy(PERIOD, "product_code").agg(*_counts())
    return grid.join(counted, [PERIOD, "product_code"], "left").select(
        "month_label",
        "product_code",
        "product_name",
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in EVENT_COUNTS],
    )


def event_totals(summary: DataFrame) -> DataFrame:
    """All counts over all periods and products, with the share of adoptions that are repeats."""
    totals = summary.agg(*[F.sum(name).alias(name) for name in EVENT_COUNTS])
    share = F.when(F.col("adoptions") > 0, F.col("repeat_adoptions") / F.col("adoptions")).otherwise(0.0)
    return totals.withColumn("repeat_share", share)


def events_by_product(summary: DataFrame, top: int = 10) -> DataFrame:
    """The products with the most first adoptions."""
    names = [name for name in EVENT_COUNTS if name != "changes_across_gaps"]
    return (
        summary.groupBy("product_name")
        .agg(*[F.sum(name).alias(name) for name in names])
        .orderBy(F.desc("first_adoptions"), "product_name")
        .limit(top)
    )

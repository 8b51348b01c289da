"""What entities do next: transitions, ladder funnel, time to the next product, cohort retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import months_between_labels, ratio, row_any
from panelmill.schema import ENTITY, PERIOD, Catalogue

COHORT_OFFSETS = (0, 1, 3, 6, 12)
TOP_ROWS = 10
PROPOSAL_STEPS = 6


def _names(catalogue: Catalogue) -> Column:
    pairs = [part for p in catalogue.products for part in (F.lit(p.code), F.lit(p.name))]
    return F.create_map(*pairs)


def transitions(events: DataFrame, catalogue: Catalogue) -> DataFrame:
    """First adoptions of B paired with the first adoptions A in the entity's previous adoption period.

    The products of a period are gathered per entity (never more than the catalogue holds) and the
    previous gathering is read with LAG, so no self-join is needed and events keep their partitioning.
    """
    listed = [product.code for product in catalogue.products]
    per_period = (
        events.filter("adoption_kind = 'first'")
        .groupBy(ENTITY, PERIOD)
        .agg(F.collect_list("product_code").alias("adopted"))
    )
    in_time = Window.partitionBy(ENTITY).orderBy(PERIOD)
    steps = per_period.select(
        ENTITY,
        "adopted",
        F.lag("adopted").over(in_time).alias("adopted_before"),
        (F.col(PERIOD) - F.lag(PERIOD).over(in_time)).alias("months_between"),
    ).filter("adopted_before IS NOT NULL")
    pairs = (
        steps.select(ENTITY, "months_between", "adopted", F.explode("adopted_before").alias("from_product"))
        .select(ENTITY, "months_between", "from_product", F.explode("adopted").alias("to_product"))
        .filter("from_product <> to_product")
        .filter(F.col("from_product").isin(listed) & F.col("to_product").isin(listed))
    )
    same_step = Window.partitionBy(ENTITY, "from_product", "to_product").orderBy("months_between")
    counted = (
        pairs.withColumn("first_of_entity", (F.row_number().over(same_step) == 1).cast("int"))
        .groupBy("from_product", "to_product", "months_between")
        .agg(F.count(F.lit(1)).alias("transitions"), F.sum("first_of_entity").alias("customers"))
    )
    per_pair = counted.groupBy("from_product", "to_product").agg(
        F.sum("customers").alias("customers"),
        F.expr("percentile(months_between, 0.5, transitions)").alias("median_months_between"),
        F.sum("transitions").alias("transitions"),
    )
    names = _names(catalogue)
    from_all = F.sum("transitions").over(Window.partitionBy("from_product"))
    return per_pair.select(
        "from_product",
        names[F.col("from_product")].alias("from_name"),
        "to_product",
        names[F.col("to_product")].alias("to_name"),
        "customers",
        "transitions",
        "median_months_between",
        (F.col("transitions") / from_all).alias("share_of_from"),
    )


def top_transitions(pairs: DataFrame, top: int = TOP_ROWS) -> DataFrame:
    return pairs.orderBy(F.desc("transitions"), "from_product", "to_product").limit(top)


def ladder_reach(fact: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Per entity the period each ladder step is reached, in columns `reach_1`, `reach_2`, ...

    A step is reached in the first period, at or after reaching the step before it, in which any of its
    products is held. One exchange by entity serves every step: each is a minimum over the entity's rows.
    """
    numbers = range(1, len(catalogue.ladder) + 1)
    on_step = {
        number: row_any([F.col(code) == 1 for code in step.products])
        for number, step in enumerate(catalogue.ladder, start=1)
    }
    rows = fact.select(ENTITY, PERIOD, *[on_step[n].alias(f"on_{n}") for n in numbers]).filter(
        row_any([F.col(f"on_{n}") for n in numbers])
    )
    of_entity = Window.partitionBy(ENTITY)
    for n in numbers:
        holds = F.col(f"on_{n}") if n == 1 else F.col(f"on_{n}") & (F.col(PERIOD) >= F.col(f"reach_{n - 1}"))
        rows = rows.withColumn(f"reach_{n}", F.min(F.when(holds, F.col(PERIOD))).over(of_entity))
    return rows.groupBy(ENTITY).agg(*[F.min(f"reach_{n}").alias(f"reach_{n}") for n in numbers])


def entity_groups(entities: DataFrame, top_channels: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Group memberships of every entity: all, its latest segment, and its channel (the largest ones by
    name, the rest as `other`). Columns in `carry` ride along."""
    largest = (
        entities.filter("channel IS NOT NULL")
        .groupBy("channel")
        .agg(F.count(F.lit(1)).alias("_size"))
        .orderBy(F.desc("_size"), "channel")
        .limit(top_channels)
        .select("channel", F.lit(True).alias("_large"))
    )
    shown = F.when(F.col("channel").isNull(), "unknown").when(F.col("_large"), F.col("channel")).otherwise("other")

    def member(order: int, dimension: str, value: Column) -> Column:
        return F.struct(
            F.lit(order).alias("dimension_order"), F.lit(dimension).alias("dimension"), value.alias("group_value")
        )

    # At most `top_channels` rows, so this side is broadcast.
    return entities.join(F.broadcast(largest), "channel", "left").select(
        ENTITY,
        *carry,
        F.inline(
            F.array(
                member(1, "all", F.lit("all")),
                member(2, "segment", F.coalesce(F.col("latest_segment"), F.lit("unknown"))),
                member(3, "channel", shown),
            )
        ),
    )


def ladder_funnel(
    fact: DataFrame, entities: DataFrame, catalogue: Catalogue, top_channels: int = 10
) -> DataFrame | None:
    """Reached counts and conversion per ladder step and group; None while there is no ladder."""
    if not catalogue.ladder:
        return None
    reach = ladder_reach(fact, catalogue)
    located = entities.select(ENTITY, "latest_segment", "channel").join(reach, ENTITY, "left")
    reached = tuple(f"reach_{n}" for n in range(1, len(catalogue.ladder) + 1))
    grouped = (
        entity_groups(located, top_channels, reached)
        .groupBy("dimension_order", "dimension", "group_value")
        .agg(F.count(F.lit(1)).alias("customers"), *[F.count(name).alias(name) for name in reached])
    )
    steps = [
        F.struct(
            F.lit(n).alias("step"),
            F.lit(step.name).alias("step_name"),
            F.col("customers" if n == 1 else f"reach_{n - 1}").alias("previous_reached"),
            F.col(f"reach_{n}").alias("reached"),
        )
        for n, step in enumerate(catalogue.ladder, start=1)
    ]
    return (
        grouped.select("dimension", "group_value", "customers", F.inline(F.array(*steps)))
        .withColumn("conversion_rate", ratio(F.col("reached"), F.col("previous_reached")))
        .withColumn("reached_share", ratio(F.col("reached"), F.col("customers")))
    )


def ladder_proposal(penetration: DataFrame, pairs: DataFrame, max_steps: int = PROPOSAL_STEPS) -> DataFrame:
    """Greedy ladder: start at the most held product of the latest period, then keep adding the product
    most often adopted right after any product already on it. A handful of rounds over the small
    product-by-product table; Spark sums, the loop only remembers the chosen codes."""
    spark = penetration.sparkSession
    schema = "step int, product_code string, product_name string, transitions_from_ladder bigint"
    # One row per catalogue product: its name and its share in the latest period it has one.
    latest = penetration.groupBy("product_code", "product_name").agg(
        F.max(F.struct("month_label", "penetration")).alias("_last")
    ).select("product_code", "product_name", F.col("_last.month_label").alias("month_label"), F.col("_last.penetration").alias("penetration")).collect()
    if not latest:
        return spark.createDataFrame([], schema)
    names = {row["product_code"]: row["product_name"] for row in latest}
    month = max(row["month_label"] for row in latest)
    start = sorted((row for row in latest if row["month_label"] == month), key=lambda row: (-row["penetration"], row["product_code"]))
    chosen = [(1, start[0]["product_code"], start[0]["product_name"], None)]
    small = pairs.select("from_product", "to_product", "transitions").persist()
    try:
        while len(chosen) < max_steps:
            codes = [code for _, code, _, _ in chosen]
            best = (
                small.filter(F.col("from_product").isin(codes) & ~F.col("to_product").isin(codes))
                .groupBy("to_product")
                .agg(F.sum("transitions").alias("n"))
                .orderBy(F.desc("n"), "to_product")
                .limit(1)
                .collect()
            )
            if not best:
                break
            code = best[0]["to_product"]
            chosen.append((len(chosen) + 1, code, names.get(code), best[0]["n"]))
    finally:
        small.unpersist()
    return spark.createDataFrame(chosen, schema)


def time_to_next(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Distribution of periods from first seen to the first first-time adoption.

    Entities that never adopt form the NULL group of the same aggregation, which gives the number
    observed without another pass.
    """
    first = events.filter("adoption_kind = 'first'").groupBy(ENTITY).agg(F.min(PERIOD).alias("adopted_at"))
    waited = (
        entities.select(ENTITY, "first_seen_month_index")
        .join(first, ENTITY, "left")
        .groupBy((F.col("adopted_at") - F.col("first_seen_month_index")).alias("months_to_first_adoption"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    # From here on there is one row per waiting time, so an unpartitioned window is small.
    whole = Window.partitionBy()
    observed = waited.withColumn("customers_observed", F.sum("customers").over(whole)).filter(
        "months_to_first_adoption IS NOT NULL"
    )
    so_far = Window.orderBy("months_to_first_adoption")
    adopters = F.sum("customers").over(whole)
    return observed.select(
        "months_to_first_adoption",
        "customers",
        (F.col("customers") / adopters).alias("share_of_adopters"),
        (F.sum("customers").over(so_far) / adopters).alias("cumulative_share"),
        F.expr("percentile(months_to_first_adoption, 0.5, customers) OVER ()").alias("median_months"),
        "customers_observed",
    )


def adopter_share(times: DataFrame) -> DataFrame:
    """Adopters among the observed, with the median wait."""
    return times.agg(
        F.coalesce(F.sum("customers"), F.lit(0)).alias("adopters"),
        F.max("customers_observed").alias("observed"),
        ratio(F.sum("customers"), F.max("customers_observed")).alias("adopter_share"),
        F.max("median_months").alias("median_months"),
    )


def cohort_retention(fact: DataFrame, entities: DataFrame, periods: DataFrame, first_month: dt.date) -> DataFrame:
    """Join-month cohorts: the share present and holding something k periods after joining.

    Cohorts start with the first snapshot month. k runs over the period indexes that exist and can be
    observed, so a snapshot that is missing from the panel is missing from k too.
    """
    first = F.trunc(F.lit(first_month), "month")
    members = entities.filter(F.col("join_month") >= first).select(
        ENTITY, "join_month", months_between_labels(first, F.col("join_month")).alias("joined_at")
    )
    sizes = members.groupBy("join_month", "joined_at").agg(F.count(F.lit(1)).alias("cohort_size"))
    known = periods.agg(F.collect_set(PERIOD)).scalar()  # one small array of period indexes
    grid = sizes.withColumn("_known", known).select(
        "join_month",
        "cohort_size",
        F.explode(
            F.filter("_known", lambda k: F.col("joined_at") + k <= F.array_max("_known"))
        ).alias("months_since_join"),
    )
    retained = (
        fact.filter("n_products >= 1")
        .select(ENTITY, PERIOD)
        .join(members, ENTITY)
        .filter(F.col(PERIOD) >= F.col("joined_at"))
        .groupBy("join_month", (F.col(PERIOD) - F.col("joined_at")).alias("months_since_join"))
        .agg(F.count(F.lit(1)).alias("retained"))
    )
    kept = F.coalesce(F.col("retained"), F.lit(0))
    return grid.join(retained, ["join_month", "months_since_join"], "left").select(
        F.date_format("join_month", "yyyy-MM").alias("join_month"),
        "cohort_size",
        "months_since_join",
        kept.alias("retained"),
        ratio(kept, F.col("cohort_size")).alias("retention_rate"),
    )


def cohort_matrix(retention: DataFrame, offsets: tuple[int, ...] = COHORT_OFFSETS) -> DataFrame:
    """One row per cohort, one column per offset; NULL where it cannot be observed yet."""
    return retention.groupBy("join_month").agg(
        F.max("cohort_size").alias("cohort_size"),
        *[F.max(F.when(F.col("months_since_join") == k, F.col("retention_rate"))).alias(f"k_{k}") for k in offsets],
    )

"""Global order without a single task: running totals, ranks and equal-size bins.

`Window.orderBy` without a partition moves every row to one task. Here the rows are range-partitioned
by the whole order (value and a unique tie-break, so one hot value is split too), each slice is summed on
its own, and the totals of the earlier slices are added. Slices are stored before they are used twice,
because a range partitioning that is computed again may cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import cut_lineage

_SLICE = "_slice"


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    measures: Mapping[str, Column],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add, per measure m, `m_running` (inclusive, in order, within the group) and `m_total` (of the group).

    `order` must be unique within a group and `groups` must not be NULL. A group may span many slices.
    """
    groups = list(groups)
    valued = df.select("*", *[value.alias(f"_m_{name}") for name, value in measures.items()])
    sliced = cut_lineage(
        valued.repartitionByRange(*[F.col(group) for group in groups], *order).withColumn(
            _SLICE, F.spark_partition_id()
        )
    )

    per_slice = sliced.groupBy(*groups, _SLICE).agg(
        *[F.sum(f"_m_{name}").alias(f"_m_{name}") for name in measures]
    )
    earlier = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = per_slice.select(
        *groups,
        _SLICE,
        *[F.sum(f"_m_{name}").over(earlier).alias(f"_b_{name}") for name in measures],
        *[F.sum(f"_m_{name}").over(whole).alias(f"{name}_total") for name in measures],
    )

    within = Window.partitionBy(*groups, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(
        *df.columns, _SLICE, *[F.sum(f"_m_{name}").over(within).alias(f"_r_{name}") for name in measures]
    )
    return local.join(offsets, [*groups, _SLICE]).select(
        *df.columns,
        *[
            column
            for name in measures
            for column in (
                (F.col(f"_r_{name}") + F.coalesce(F.col(f"_b_{name}"), F.lit(0))).alias(f"{name}_running"),
                F.col(f"{name}_total"),
            )
        ],
    )


def with_rank(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """Add `position` (1 for the first row of its group) and `position_count` (rows of the group)."""
    ranked = running_totals(df, order, {"position": F.lit(1).cast("bigint")}, groups)
    return ranked.withColumnsRenamed({"position_running": "position", "position_total": "position_count"})


def ntile(position: Column, count: Column, tiles: int) -> Column:
    """Tile of a rank; the first `count mod tiles` tiles get one row more, as NTILE does."""
    size, longer = F.floor(count / F.lit(tiles)), count % F.lit(tiles)
    in_longer = longer * (size + 1)
    return (
        F.when(position <= in_longer, F.floor((position - 1) / (size + 1)) + 1)
        .otherwise(longer + F.floor((position - 1 - in_longer) / F.nullif(size, F.lit(0).cast("bigint"))) + 1)
        .cast("int")
    )


def quantile_bin(position: Column, count: Column, bins: int) -> Column:
    """Bin of a rank when its range 1..count is cut at equal quantiles, each cut closed on the right."""
    used = F.least(F.lit(bins).cast("bigint"), count)
    step = F.ceil(((position - 1) * used).cast("double") / F.nullif(count - 1, F.lit(0).cast("bigint")))
    return F.greatest(F.lit(1), F.coalesce(step, F.lit(1)).cast("int"))

"""A stored order of scored rows, from which bins, shares, thresholds and resamples are read.

The rows are put in order once, by one range exchange over the whole order (score and a unique tie-break, so one hot score
is split as well), sorted within their slice and stored together with their place in it. A second, small table holds
the rows of all earlier slices. Whatever needs the rank of a row adds the two; nothing is sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import cut_lineage

#: slices (a few numbers each) up to which their table is broadcast
BROADCAST_SLICES = 100_000
_ORDINAL = (1 << 33) - 1  # the low bits of a monotonically increasing id number the rows of a partition


@dataclass(frozen=True)
class OrderIndex:
    """rows: the indexed columns, `_slice` and `_ordinal` (both rise with the order); slices: per group and slice the
    first ordinal, the rows before it in the group (`_before`) and all rows of the group (`position_count`)."""

    rows: DataFrame
    slices: DataFrame
    groups: tuple[str, ...] = ()

    def only(self, **group: object) -> OrderIndex:
        """The part of one group; its ranks start at 1."""
        chosen = [F.col(name) == value for name, value in group.items()]
        rows, slices = self.rows, self.slices
        for one in chosen:
            rows, slices = rows.filter(one), slices.filter(one)
        return replace(self, rows=rows, slices=slices)

    def ranked(self) -> DataFrame:
        """The rows with `position` (1 for the first of its group) and `position_count`."""
        keys = [*self.groups, "_slice"]
        side = F.broadcast(self.slices) if self.slices.count() <= BROADCAST_SLICES else self.slices
        position = F.col("_ordinal") - F.col("_first") + F.col("_before") + 1
        return self.rows.join(side, keys).select(
            *[name for name in self.rows.columns if name != "_ordinal"], position.alias("position"), "position_count"
        )


def order_index(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = ()) -> OrderIndex:
    """Index the rows of `df` in `order`, which must be unique within a group; groups must not be NULL.

    Stores rows and slices when called. There are as many slices as the session has shuffle partitions.
    """
    groups = tuple(groups)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(name) for name in groups]
    rows = cut_lineage(
        df.repartitionByRange(slices, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select("*", F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ORDINAL)).alias("_ordinal"))
    )
    sizes = rows.groupBy(*groups, "_slice").agg(F.min("_ordinal").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.select(
        *groups,
        "_slice",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*groups)).alias("position_count"),
    )
    return OrderIndex(rows, cut_lineage(numbered), groups)

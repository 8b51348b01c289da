"""Balanced shards by vector bin packing of groups of equal texts.

Every group is an item with a size in several dimensions (bytes, tokens, rows). Items are dealt by hash into slices
of a bounded number of documents. Within a slice they are placed largest first, each in the shard whose residual
capacity has the highest dot product with the item's size, all sizes taken as shares of the slice's totals. Slices
are balanced one by one, so the whole is balanced as well, and no task or driver ever sees more than a slice.

A group that is large for a slice is placed before the slices, as one item without its rows; such groups are dealt
into slices of groups, and the slices of rows start from the capacity they leave. Only a group of more than a quarter
of a shard of the whole corpus is salted into parts. Both kinds are bounded in number, by slices and by shards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import positional, stored

SHARDS = 16
SLICE_ROWS = 8_000
#: large groups (some 60 bytes each) up to this many are broadcast, more are joined by a shuffle
BROADCAST_GROUPS = 100_000


def place(sizes: np.ndarray, shards: int, emphasis: Sequence[float], capacity: np.ndarray | None = None) -> np.ndarray:
    """A shard for each row of `sizes` (items x dimensions); emphasis: how much each dimension counts in the product;
    capacity: the part of the items' totals that each shard is to get (shards x dimensions), equal parts by default."""
    totals = sizes.sum(axis=0)
    share = sizes / np.where(totals > 0, totals, 1)
    residual = np.full((shards, sizes.shape[1]), 1.0 / shards) if capacity is None else capacity.copy()
    found = np.empty(len(sizes), dtype=np.int32)
    for item in np.lexsort((-share[:, 0], -share.max(axis=1))):
        best = found[item] = int((residual @ (share[item] * emphasis)).argmax())
        residual[best] -= share[item]
    return found


def _capacity(totals: np.ndarray, load: np.ndarray) -> np.ndarray:
    """What each shard is to get of the items still to place, as parts of their totals."""
    left = totals - load.sum(axis=0)
    return np.where(left > 0, (totals / len(load) - load) / np.where(left > 0, left, 1), 1.0 / len(load))


def _turned(sizes: np.ndarray, shards: int, emphasis: Sequence[float], capacity: np.ndarray, turn: int) -> np.ndarray:
    """As `place`, but ties go to another first shard for each `turn`."""
    order = (np.arange(shards) + turn) % shards
    return order[place(sizes, shards, emphasis, capacity[order])].astype(np.int32)


def _place_groups(items: DataFrame, sizes_of: list[str], shards: int, emphasis: Sequence[float], capacity: np.ndarray, slices: int) -> DataFrame:
    """_item and shard of rows with _item, _order (a hash) and sizes; each slice is placed by one task."""

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", *sizes_of], kind="stable", ignore_index=True)
        shard = _turned(part[sizes_of].to_numpy(float), shards, emphasis, capacity, int(part["_order"].iloc[0]) % slices)
        return pd.DataFrame({"_item": part["_item"], "shard": shard})

    dealt = items.select("_item", "_order", *sizes_of, F.pmod("_order", F.lit(slices)).alias("_deal"))
    return stored(dealt.groupBy("_deal").applyInPandas(placed, "_item long, shard int"), "shard-placed-groups")


def _load(placed: DataFrame, items: DataFrame, sizes_of: list[str], shards: int) -> np.ndarray:
    load = np.zeros((shards, len(sizes_of)))
    for row in placed.join(items, "_item").groupBy("shard").agg(*[F.sum(name) for name in sizes_of]).collect():
        load[row[0]] = row[1:]
    return load


def shard_rows(
    rows: DataFrame,
    key: str,
    group: list[str],
    dimensions: dict[str, float],
    shards: int = SHARDS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 within the shard) to `rows`.

    `dimensions` are non-negative numbers of each row with their emphasis, `group` names the columns that rows placed together share
    (their nulls are equal); a group of more than a quarter of a shard, in rows or a dimension, is parted. Repeated rows
    stay apart and are parted like any others, null keys are allowed, an empty table gives an empty result. Columns of
    the input named shard or slot are replaced.
    """
    columns = rows.columns
    rows, at = positional(rows)
    names = rows.columns
    # stored with the rows, so that equal rows have numbers of their own and keep them
    rows = stored(rows.withColumn("_number", F.monotonically_increasing_id()), "shard-rows")
    key, group, sizes_of = at[key], [at[name] for name in group], [at[name] for name in dimensions]
    totals = rows.agg(F.count(F.lit(1)), *[F.sum(name) for name in sizes_of]).first()
    slices = max(1, -(-totals[0] // slice_rows))
    emphasis = list(dimensions.values())
    measures = {"_rows": F.count(F.lit(1))} | {f"_sum_{name}": F.sum(name) for name in sizes_of}

    def quarters(of: int) -> Column:
        """How many parts of at most a quarter of a shard of one of `of` slices a group takes, by its largest measure."""
        shares = [F.ceil(F.col(name) * 4 * shards * of / total) for name, total in zip(measures, totals) if total]
        return F.greatest(*shares, F.lit(1), F.lit(1))

    # the number of groups beyond a quarter of what a shard gets from a slice is bounded by shards, slices and dimensions
    large = stored(
        rows.groupBy(*group).agg(*[measure.alias(name) for name, measure in measures.items()]).where(quarters(slices) > 1)
        .select(F.struct(*group).alias("_large"), F.least(quarters(1), F.col("_rows")).alias("_parts")),
        "shard-large-groups",
    )
    n_large = large.count()
    side = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
    salted = rows.join(side, F.struct(*group).eqNullSafe(F.col("_large")), "left").select(
        *names, "_number", F.pmod(F.xxhash64("_number"), F.col("_parts")).alias("_part")
    )
    load, whole = np.zeros((shards, len(sizes_of))), np.array([float(total or 0) for total in totals[1:]])
    if n_large:
        items = stored(
            salted.where(F.col("_part").isNotNull()).groupBy(*group, "_part").agg(*[measure.alias(name) for name, measure in measures.items()])
            .select(
                F.monotonically_increasing_id().alias("_item"), F.xxhash64(*group, "_part").alias("_order"),
                F.struct(*group, "_part").alias("_whole"), *[F.col(f"_sum_{name}").alias(name) for name in sizes_of],
                quarters(max(1, -(-n_large // slice_rows))).alias("_quarters"),
            ),
            "shard-large-items",
        )
        # where the groups take several slices, those that are large for one of these go first, all in one slice
        deals = max(1, -(-n_large // slice_rows))
        first, later = items.where(F.col("_quarters") > 1), items.where(F.col("_quarters") <= 1)
        if deals == 1:
            first, later = items, None
        found = _place_groups(first, sizes_of, shards, emphasis, _capacity(whole, load), 1)
        load = load + _load(found, items, sizes_of, shards)
        if later is not None:
            rest = _place_groups(later, sizes_of, shards, emphasis, _capacity(whole, load), deals)
            load, found = load + _load(rest, items, sizes_of, shards), found.unionByName(rest)
        given = found.withColumnRenamed("shard", "_given").join(items.select("_item", "_whole"), "_item").select("_whole", "_given")
        side = F.broadcast(given) if n_large <= BROADCAST_GROUPS else given
        salted = salted.join(side, F.struct(*group, "_part").eqNullSafe(F.col("_whole")), "left").select(*names, "_number", "_given")
    else:
        salted = salted.select(*names, "_number", F.lit(None).cast("int").alias("_given"))
    capacity = _capacity(whole, load)
    # rows whose shard is given are dealt singly, only to be counted
    dealt = salted.select(
        *names, F.coalesce("_given", F.lit(-1)).alias("_given"),
        F.pmod(F.when(F.col("_given").isNull(), F.xxhash64(*group)).otherwise(F.xxhash64("_number")), F.lit(slices)).cast("int").alias("_slice"),
    )
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.select(*names).schema)

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*group, key], kind="stable", ignore_index=True)
        shard, free = part["_given"].to_numpy(np.int32).copy(), part["_given"].to_numpy() < 0
        if free.any():
            open_rows = part[free]
            item = open_rows.groupby(group, dropna=False, sort=False).ngroup().to_numpy()
            sizes = np.stack([np.bincount(item, weights=open_rows[name].to_numpy(float)) for name in sizes_of], axis=1)
            shard[free] = _turned(sizes, shards, emphasis, capacity, int(part["_slice"].iloc[0]))[item]
        part["shard"] = shard
        part["_local"] = part.groupby("shard").cumcount().astype("int64")
        return part[[*names, "_slice", "shard", "_local"]].astype({"shard": "int32"})

    local = stored(
        dealt.groupBy("_slice").applyInPandas(placed, f"{kinds}, _slice int, shard int, _local long"), "shard-slices"
    )
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    kept = [name for name in columns if name not in ("shard", "slot")]
    return local.join(offsets, ["shard", "_slice"]).select(
        *[at[name] for name in kept], "shard", (F.col("_before") + F.col("_local")).alias("slot")
    ).toDF(*kept, "shard", "slot")


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes and one more), tokens (words parted by single spaces, at least 1), rows (1), text_crc32
    and text_hash; a null text counts as empty."""
    body: Column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        (F.length(body) - F.length(F.replace(body, F.lit(" "))) + 1).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
    )

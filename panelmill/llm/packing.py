"""Packing token sequences of bounded length: a configuration program over the length histogram.

Texts are tokenised, longer ones cut, and only the histogram of piece lengths (at most `capacity` bins, whatever
the corpus holds) comes to the driver. There a covering program over sequence configurations is solved by
multiplicative weights: every length has a weight, the best configurations for the weights come from a knapsack solved
by dynamic programming, and the weights of the lengths they cover fall. Amounts are whole numbers from the start; the
few lengths left over are packed by best fit, whole runs of equal lengths at a time. The plan says for
each length which ranks of its pieces go to which sequences; pieces are ranked within their length by a two-level
count, so neither a common length nor the table ever meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.bpe import word_end
from panelmill.llm.storage import positional, stored, tidy

CAPACITY = 4096
#: rounds of the covering program, how fast weights fall, and what a configuration may be worth less than the best
ROUNDS, RATE, SLACK = 16, 0.02, 0.002
#: lengths without a good configuration after which a round ends
MISSES = 50
#: pieces ranked together in one task, on average
SLICE_ROWS = 50_000
_OUT_ROWS = 2_000


@dataclass(frozen=True)
class Configuration:
    """`count` sequences, each holding `lengths` from its start on."""

    count: int
    lengths: tuple[int, ...]


def tokenised_pieces(
    docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece; a null text is empty and gives the end id alone."""
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_end(tokenizer_file)
        for batch in batches:
            keys, texts = batch.column(0), [value.as_py() for value in batch.column(1)]
            rows: list[tuple[int, int, int, int]] = []
            for row, raw in enumerate(ids_of.encode(texts)):
                raw += end
                rows.extend((row, at, min(step, len(raw) - at), zlib.crc32(raw[at : at + step])) for at in range(0, len(raw), step))
            row, at, size, crc = (np.array(column, dtype=np.int64) for column in (zip(*rows) if rows else [()] * 4))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array((at // step).astype(np.int32)), pa.array(at // 4), pa.array(size // 4), pa.array(crc)],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(tidy(cut), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def _values(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: the highest price that each room can hold."""
    value = np.zeros(capacity + 1)
    for room in range(int(lengths[0]), capacity + 1):
        fitting = np.searchsorted(lengths, room, side="right")
        value[room] = max(value[room - 1], (value[room - lengths[:fitting]] + prices[:fitting]).max())
    return value


def _fill(lengths: np.ndarray, prices: np.ndarray, value: np.ndarray, left: np.ndarray, room: int) -> tuple[Counter[int], float]:
    """The items that the table of values puts into `room`, the longest of equal ones first, as far as pieces are left."""
    counts: Counter[int] = Counter()
    total = 0.0
    while fitting := int(np.searchsorted(lengths, room, side="right")):
        offered = np.where(left[:fitting] > 0, value[room - lengths[:fitting]] + prices[:fitting], -1.0)
        best = offered.max()
        if best < 0:
            break
        item = fitting - 1 - int((offered[::-1] >= best - 1e-9).argmax())
        counts[item] += 1
        left[item] -= 1
        room -= int(lengths[item])
        total += float(prices[item])
    return counts, total


def covering_configurations(
    histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE, slack: float = SLACK
) -> tuple[list[Configuration], dict[int, int]]:
    """Configurations in whole numbers, and the pieces of each length that they leave over.

    In each round the weights price the lengths and one dynamic program prices every room. From the heaviest and
    longest length on, the best configuration that holds it is read off the table; while it is worth `slack` less
    than the best at most, it is taken for half of what its scarcest length has left, rounded up. Then the
    weights of the lengths fall by the share of them that the round covered, so that the next one favours what lags.
    """
    lengths = np.array(sorted(histogram))
    wanted = np.array([histogram[length] for length in lengths.tolist()])
    left, weights = wanted.copy(), np.ones(len(lengths))
    used: Counter[tuple[int, ...]] = Counter()
    for _ in range(rounds):
        live = np.flatnonzero(left)
        if not len(live):
            break
        sizes, rest = lengths[live], left[live]
        prices = sizes * weights[live] / capacity
        value = _values(sizes, prices, capacity)
        found = missed = 0
        for item in np.lexsort((-sizes, -weights[live])).tolist():
            while rest[item] and found < capacity:
                trial = rest.copy()
                trial[item] -= 1
                counts, total = _fill(sizes, prices, value, trial, capacity - int(sizes[item]))
                if total + prices[item] < (1 - slack) * value[capacity]:
                    missed += 1
                    break
                counts[item] += 1
                times = -(-min(int(rest[k]) // count for k, count in counts.items()) // 2)
                for k, count in counts.items():
                    rest[k] -= times * count
                used[tuple(sorted((int(sizes[k]) for k in counts.elements()), reverse=True))] += times
                found += 1
            if missed > MISSES:
                break
        if not found:
            break
        weights[live] *= np.exp(-rate * (left[live] - rest) / wanted[live])
        left[live] = rest
    return [Configuration(count, held) for held, count in used.items()], {
        int(length): int(count) for length, count in zip(lengths, left) if count
    }


def _best_fit(left: dict[int, int], capacity: int) -> list[Configuration]:
    """Best fit, longest first; equal pieces are placed in runs, so the work follows the distinct lengths."""
    open_rooms: list[int] = []
    bins: dict[int, Counter[tuple[int, ...]]] = {}

    def put(room: int, held: tuple[int, ...], count: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            insort(open_rooms, room)
        bins[room][held] += count

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = open_rooms[at]
            held, count = next(iter(bins[room].items()))
            each = min(room // length, todo)
            filled = min(count, todo // each)
            if filled == count:
                del bins[room][held]
                if not bins[room]:
                    del bins[room]
                    open_rooms.pop(at)
            else:
                bins[room][held] -= filled
            put(room - each * length, held + (length,) * each, filled)
            todo -= filled * each
    return [Configuration(count, held) for group in bins.values() for held, count in group.items()]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Configuration]:
    """Configurations that hold every piece of the histogram exactly once.

    The covering program's come first, and best fit packs what they leave over. Best fit of everything is the plan
    only where it takes fewer sequences, which happens with few pieces.
    """
    whole = [Configuration(histogram[capacity], (capacity,))] if histogram.get(capacity) else []
    small = {length: count for length, count in histogram.items() if count and length != capacity}
    if not small:
        return whole
    covered, left = covering_configurations(small, capacity, rounds)
    plans = covered + _best_fit(left, capacity), _best_fit(small, capacity)
    return whole + min(plans, key=lambda plan: sum(one.count for one in plan))


def _slots(plan: list[Configuration]) -> pd.DataFrame:
    """For each length, ranges of ranks and where they go: rank r of a range of k a sequence goes to sequence
    `first + (r - low) // k`, offset `offset + (r - low) % k * length`."""
    used: Counter[int] = Counter()
    rows, first = [], 0
    for one in plan:
        offset = 0
        for length, each in sorted(Counter(one.lengths).items(), reverse=True):
            rows.append((length, used[length], each, first, offset))
            used[length] += one.count * each
            offset += each * length
        first += one.count
    return pd.DataFrame(rows, columns=["length", "low", "each", "first", "offset"]).sort_values(["length", "low"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add sequence_id and offset to the rows of `pieces`, which must have a `length` from 1 to `capacity`.

    Repeated rows are pieces of their own; an empty table gives an empty result. Every other column passes through
    and takes part in the order of the ranks; columns named sequence_id or offset are replaced. The broadcast plan has a
    few rows for each configuration, of which there are at most `capacity` a round, besides the runs of best fit.
    """
    columns = pieces.columns
    pieces, named = positional(stored(pieces, "pieces"))
    size = named["length"]
    counts = {row[0]: row[1] for row in pieces.groupBy(size).count().collect()}
    slots = _slots(plan_sequences(counts, capacity, rounds))
    table = {
        length: tuple(part[name].to_numpy(np.int64) for name in ("low", "each", "first", "offset"))
        for length, part in slots.groupby("length")
    }
    plan = pieces.sparkSession.sparkContext.broadcast(table)

    slices = max(1, sum(counts.values()) // slice_rows)
    names = pieces.columns
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*names), F.lit(slices)).cast("int"))
    earlier = Window.partitionBy(size).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(size, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        size, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(size, "_slice").orderBy(*names)
    ranked = sliced.withColumn("_local", F.row_number().over(within) - 1).join(offsets, [size, "_slice"]).select(
        *names, (F.col("_before") + F.col("_local")).alias("_rank")
    )
    at = columns.index("length")

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                low, each, first, start = plan.value[int(one)]
                k = np.searchsorted(low, rank[rows], side="right") - 1
                sequence[rows] = first[k] + (rank[rows] - low[k]) // each[k]
                offset[rows] = start[k] + (rank[rows] - low[k]) % each[k] * one
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in pieces.schema)
    found = ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")
    kept = [name for name in columns if name not in ("sequence_id", "offset")]
    return found.select(*[named[name] for name in kept], "sequence_id", "offset").toDF(*kept, "sequence_id", "offset")

"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words; each level names the stretches that occur at least twice in their text by
pairs of names of the level below. A run of period q holds at least three periods, so with 2^(k-1) < q <= 2^k the factor
of 2^k words at its start fits twice, q apart. Occurrences of a factor that start at most its own length apart form an
arithmetic progression whose step is the factor's smallest period, so the distance to the successor is q and nothing
smaller. Such distances propose (start, period). Proposals of one period at consecutive starts belong to one run, and
extend each other to its ends: the first cannot be preceded and the last cannot be followed by a word that keeps the
period, because the factor there would propose it too. A period belongs to one level only, so no run is found twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: words handled at once; a longer text is a slice of its own
SLICE_WORDS = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = ArrayType(StructType([StructField(name, LongType()) for name in ("start", "length", "period")]))


def _proposals(symbols: np.ndarray, longest: int, times: int) -> tuple[np.ndarray, ...]:
    """start, period and factor length of every proposal; equal symbols never belong to different texts."""
    starts, periods, factors = [], [], []
    place = np.arange(len(symbols), dtype=np.int64)
    name, size = symbols, 1
    dense = np.empty(len(symbols), dtype=np.int64)
    while len(place) and (size // 2 + 1) * times <= longest:
        order = np.argsort(name, kind="stable")
        at, sorted_name = place[order], name[order]
        same = sorted_name[1:] == sorted_name[:-1]
        gap = at[1:] - at[:-1]
        near = same & (gap <= size) & (2 * gap > size)
        starts.append(at[:-1][near])
        periods.append(gap[near])
        factors.append(np.full(int(near.sum()), size, dtype=np.int64))
        # only factors that occur again can be the halves of one that does
        again = np.zeros(len(at), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        number = np.zeros(len(at), dtype=np.int64)
        np.cumsum(~same, out=number[1:])
        dense.fill(-1)
        dense[at[again]] = number[again]
        place = np.flatnonzero(dense[: max(0, len(dense) - size)] >= 0)
        place = place[dense[place + size] >= 0]
        name = dense[place] * len(dense) + dense[place + size]
        size *= 2
    if not starts:
        return (np.empty(0, dtype=np.int64),) * 3
    return np.concatenate(starts), np.concatenate(periods), np.concatenate(factors)


def runs_of(symbols: np.ndarray, longest: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of every run of at least `least` words and `times` periods, by start, then period.

    symbols: the texts one after another, as numbers that no two texts share; longest: words of the longest text.
    """
    start, period, factor = _proposals(symbols, longest, times)
    order = np.lexsort((start, period))
    start, period, factor = start[order], period[order], factor[order]
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    length = start[last] - start[first] + factor[first] + period[first]
    start, period = start[first], period[first]
    long_enough = (length >= least) & (length >= times * period)
    start, period, length = start[long_enough], period[long_enough], length[long_enough]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` words each."""
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield begin, row
            begin, held = row, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _found(words: pa.ListArray, least: int, times: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of every list."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = words.flatten()
    begins = np.concatenate(([0], np.cumsum(sizes)))
    code = flat.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    symbols = text * (int(code.max()) + 1 if len(code) else 1) + code
    start, length, period = runs_of(symbols, int(sizes.max(initial=0)), least, times)
    edges = np.zeros(len(code) + 1, dtype=np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = (np.cumsum(edges[:-1]) == 0) & flat.is_valid().to_numpy(zero_copy_only=False)
    left = np.concatenate(([0], np.cumsum(np.bincount(text[kept], minlength=len(sizes))))).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(left, flat.filter(pa.array(kept))), " ")
    holder = text[start]
    runs = pa.StructArray.from_arrays(
        [pa.array(start - begins[holder]), pa.array(length), pa.array(period)], names=["start", "length", "period"]
    )
    per_text = np.concatenate(([0], np.cumsum(np.bincount(holder, minlength=len(sizes))))).astype(np.int32)
    return pa.ListArray.from_arrays(per_text, runs).cast(pa.list_(RUN)), collapsed


def periodic_runs(
    docs: DataFrame,
    words: str = "words",
    runs: str = "runs",
    collapsed: str = "collapsed",
    least: int = 24,
    times: int = 3,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """The rows, with the periodic runs of their words in place of the words.

    A run is a stretch of at least `least` words and `times` (3 or more) whole periods that has the smallest period q
    and that no neighbouring word extends. `runs` lists (start, length, period), words numbered from 0, by start, then
    period; `collapsed` is the text of the words, joined by one space, without those that lie in a run after its first
    q words. Input columns of these names are replaced; every other column is kept.

    Rows stay where they are: nothing is shuffled. Texts are handled some at a time, about `slice_words` words
    together; one longer text is taken alone, at about 100 bytes a word. Null and empty lists have no runs and collapse
    to the empty text. Null words equal each other and add nothing to the text. Repeated rows and null keys keep
    their rows; an empty table gives an empty result.
    """
    if times < 3:
        raise ValueError(f"a run holds three periods at least, not {times}")
    plain = [name for name in docs.columns if name not in (words, runs, collapsed)]
    schema = StructType([*[docs.schema[name] for name in plain], StructField(runs, RUN_TYPE), StructField(collapsed, StringType())])
    names = [field.name for field in schema]

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for begin, end in _slices(sizes, slice_words):
                part = batch.slice(begin, end - begin)
                columns = [part.column(at) for at in range(1, len(plain) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, *_found(part.column(0), least, times)], names=names)

    return docs.select(words, *plain).mapInArrow(found, schema)

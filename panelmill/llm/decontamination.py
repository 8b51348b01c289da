"""Benchmark passages inside documents: multi-pattern search over words with shift tables.

Patterns are runs of `window` consecutive words of a benchmark text (a shorter text is one pattern). Patterns of one
length form a matcher. A block is the last two words of the current alignment; its shift says how far the alignment
can move before any pattern could end there, so most positions are never looked at. At shift 0 the hash of the last
words selects a bucket, and the words of its patterns are compared directly.

The benchmark is a stated query set. Its tables are broadcast in blocks of a bounded number of bytes, one pass over
the documents for each block, each adding to what the one before has found.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.storage import positional

WINDOW = 10
#: benchmark text per broadcast
BLOCK_BYTES = 8 << 20
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes above 127, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


class Matcher:
    """All patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int]) -> None:
        self.length = len(next(iter(patterns)))
        self._block = min(2, self.length)
        self._far = self.length - self._block + 1
        self._shift: dict[bytes | tuple[bytes, ...], int] = {}
        self._bucket: dict[bytes | tuple[bytes, ...], list[tuple[list[bytes], int]]] = defaultdict(list)
        for pattern, number in patterns.items():
            for end in range(self._block, self.length + 1):
                block = pattern[end - self._block : end]
                away = self.length - end
                self._shift[block] = min(away, self._shift.get(block, away))
            self._bucket[pattern[self.length - self._block :]].append((list(pattern), number))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        shift, far, length, at = self._shift.get, self._far, self.length, self.length - 1
        last, block = len(words) - 1, self._block
        while at <= last:
            key = (words[at - 1], words[at]) if block == 2 else (words[at],)
            move = shift(key, far)
            if move:
                at += move
                continue
            start = at - length + 1
            found = words[start : at + 1]
            for pattern, number in self._bucket[key]:
                if pattern == found:
                    yield start, number
            at += 1


def _matchers(items: Sequence[tuple[str | None, bytes]], window: int) -> tuple[list[Matcher], list[list[str]]]:
    """One matcher for each pattern length, and the item ids of each pattern number."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for start in range(max(len(words) - window, 0) + 1 if words else 0):
            owners[tuple(words[start : start + window])].update([] if item is None else [item])
    numbered = {pattern: number for number, pattern in enumerate(owners)}
    by_length = defaultdict(dict)
    for pattern, number in numbered.items():
        by_length[len(pattern)][pattern] = number
    return [Matcher(group) for group in by_length.values()], [sorted(owners[pattern]) for pattern in numbered]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    held, size = [], 0
    rows = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string").cast("binary")).where(F.col(text).isNotNull())
    for name, raw in rows.toLocalIterator():
        held.append((name, bytes(raw)))
        size += len(raw)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _covered(starts_and_lengths: list[tuple[int, int]]) -> list[int]:
    """Bounds of the merged spans: start, end, start, end, ..."""
    bounds: list[int] = []
    for start, length in sorted(starts_and_lengths):
        if bounds and start <= bounds[-1]:
            bounds[-1] = max(bounds[-1], start + length)
        else:
            bounds += [start, start + length]
    return bounds


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """key, the columns of `keep`, n_words, spans (word positions from and to, merged) and items (sorted as strings).

    A null or empty text has no words and no spans. Items without words match nothing; items that share an id are
    one item; an item whose id is null marks words but is not listed. Repeated document rows each get a row. With an
    empty benchmark nothing is hit. Columns of `keep` that are named like a result are left out, a key so named is refused.
    """
    results_named = ["n_words", "spans", "items"]
    if key in results_named:
        raise ValueError(f"the key is named like a result: {key}")
    given = [key, *(name for name in keep if name not in results_named)]
    plain, named = positional(docs)
    columns = [named[name] for name in given]
    source = plain.select(*columns, F.col(named[text]).cast("string").cast("binary").alias("_text"))
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in source.schema[: len(columns)])
    at, width = len(columns), len(columns) + 1

    def searching(block: list[tuple[str | None, bytes]], last: bool):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers, owners = _matchers(shared.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for row in range(batch.num_rows):
                    words = words_of(batch.column(at)[row].as_py() or b"")
                    hits = [(start, one.length, number) for one in matchers for start, number in one.find(words)]
                    found = set(itertools.chain.from_iterable(owners[hit[2]] for hit in hits))
                    marked = [hit[:2] for hit in hits]
                    if batch.num_columns > width:  # what the passes before have found
                        bounds = batch.column(width + 1)[row].as_py()
                        marked += [(a, b - a) for a, b in zip(bounds[::2], bounds[1::2])]
                        found.update(batch.column(width + 2)[row].as_py())
                    counts.append(len(words))
                    spans.append(_covered(marked))
                    items.append(sorted(found))
                results = [
                    pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(at if last else width)] + results,
                    names=[*columns, *([] if last else ["_text"]), *results_named],
                )

        return search

    blocks = list(_blocks(benchmark, item, item_text, block_bytes)) or [[]]
    for number, block in enumerate(blocks, 1):
        last = number == len(blocks)
        carried = "" if last else ", _text binary"
        schema = f"{kinds}{carried}, n_words long, spans array<int>, items array<string>"
        source = source.mapInArrow(searching(block, last), schema)
    return source.toDF(*given, *results_named)

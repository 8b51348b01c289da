"""Repeated passages of at least `window` words, by prefix-partitioned sparse suffix trees.

A passage that occurs twice contains, in both places, the same anchor: of the short runs of words that start in its
first part the one with the smallest hash. So only suffixes that start at anchors can be deep inner nodes of the
suffix tree of the corpus, and only those whose anchor occurs more than once are taken:

1. Every text lists its anchors. Texts with the same words are one text from here on.
2. Anchors are counted over the corpus; each text learns which of its anchors are shared.
3. Suffixes at shared anchors are dealt out by prefix. The prefix is the anchor's run, or for anchors that occur
   very often a whole window, so that the suffixes of one group fit into memory; repeats within a batch of texts are
   settled before, so that even a passage in a third of all texts sends one suffix per batch.
4. Each group's tree is its sorted suffixes with the lengths of common prefixes between neighbours. An inner node
   whose depth completes a window gives a repeat; the windows' 64-bit fingerprints, which also cover the words
   before the anchor, confirm it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.storage import stored

WINDOW = 35
ANCHOR_WORDS = 12
#: suffixes whose trees are built in one task, about, and occurrences from which an anchor gets a longer prefix
GROUP_SUFFIXES, LONG_PREFIX_FROM = 60_000, 4_096
#: rows (two longs) up to which a side is broadcast, to read only the texts that matter
BROADCAST_ROWS = 500_000
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_ID = ["r1", "r2"]


def _mixed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = (one * _K1) ^ ((other ^ (other >> np.uint64(29))) * _K2)
    return (out ^ (out >> np.uint64(32))) * _K3


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive word hashes, put together from runs of powers of two."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found, done, power, size = None, 0, words, 1
    while True:
        if length & size:
            part = power[done : done + count]
            found = part if found is None else _mixed(found, part)
            done += size
        if size * 2 > length:
            return found
        power, size = _mixed(power[:-size], power[size:]), size * 2


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors_of(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, hashes of their runs, and for each the first and last window that it anchors."""
    runs = run_hashes(hashes, anchor)
    if len(hashes) < window:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    span = window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(hashes) - window + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], runs[at[first]], first, np.append(first[1:], len(at)) - 1


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(
        F.col(key).alias("_key"), F.xxhash64(F.col(key), body).alias("r1"), F.xxhash64(F.lit(1), F.col(key), body).alias("r2"),
        body.cast("binary").alias("_text"),
    )


def _listed(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """_key, r1, r2, n_words, words_sha256, anchors (a hash for each occurrence)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, anchors = [], [], []
            for raw in batch.column(3):
                words = (raw.as_py() or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(anchors_of(_word_hashes(words), window, anchor)[1].view(np.int64) if len(words) >= window else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(anchors, pa.list_(pa.int64())),
                ],
                names=["_key", *_ID, "n_words", "words_sha256", "anchors"],
            )

    kind = texts.schema["_key"].dataType.simpleString()
    return texts.mapInArrow(read, f"_key {kind}, r1 long, r2 long, n_words long, words_sha256 string, anchors array<long>")


def _joined_texts(texts: DataFrame, side: DataFrame) -> DataFrame:
    """Texts with the columns of `side`; where its ids are few enough, others are left out before the shuffle."""
    ids = side.select(*_ID)
    if ids.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), _ID, "left_semi")
    return texts.join(side, _ID)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])


def _suffixes(chosen: DataFrame, window: int, anchor: int, groups: int) -> DataFrame:
    """slot, r1, r2, first (window), lead (words from it to the anchor), words (from the anchor on), prints (of its
    windows); rows without words name windows in `prints` that are known to repeat, from `first` on."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = []
            for row in range(batch.num_rows):
                words = (batch.column(2)[row].as_py() or b"").split()
                hashes = _word_hashes(words)
                at, runs, first, last = anchors_of(hashes, window, anchor)
                shared = np.asarray(batch.column(3)[row].as_py(), np.int64).view(np.uint64)
                use = np.isin(runs, shared)
                if use.any():
                    taken.append((row, hashes, at[use], runs[use], first[use], last[use]))
            if not taken:
                continue
            # windows of the shared anchors, text after text
            prints, rows, starts, owners, count = [], [], [], [], 0
            for row, hashes, at, _, first, last in taken:
                sizes = last - first + 1
                own = np.repeat(first - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
                prints.append(run_hashes(hashes, window)[own])
                starts.append(own)
                rows.append(np.full(len(own), row))
                owners.append(np.repeat(np.arange(len(at)) + count, sizes))
                count += len(at)
            prints, rows, starts, owners = (np.concatenate(x) for x in (prints, rows, starts, owners))
            _, kept, inverse, times = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
            sent = np.zeros(count, bool)
            sent[owners[kept]] = True
            known = np.flatnonzero(times[inverse] > 1)

            codes, slots, places, firsts, lines, often = [], [], [], [], [], []
            for row, hashes, at, runs, first, _ in taken:
                padded = np.concatenate([hashes.astype(np.uint32), np.zeros(window, np.uint32)])
                codes.append(np.lib.stride_tricks.sliding_window_view(padded, window)[at])
                slots.append(runs), places.append(at), firsts.append(first), lines.append(np.full(len(at), row))
                often.append(np.isin(runs.view(np.int64), np.asarray(batch.column(4)[row].as_py(), np.int64)))
            codes, slots, places, firsts, lines, often = (np.concatenate(x) for x in (codes, slots, places, firsts, lines, often))
            # a suffix for each rare anchor; for each window of a frequent one, whose prefix is then the whole window
            plain = np.flatnonzero(sent & ~often)
            single = kept[often[owners[kept]]]
            of_single = owners[single]
            widths = np.append(np.bincount(owners, minlength=count)[plain], np.ones(len(single), np.int64))
            slot = (np.append(slots[plain], prints[single]) % np.uint64(groups)).astype(np.int64)
            whose = np.append(lines[plain], lines[of_single])
            begins = np.append(firsts[plain], starts[single])
            leads = np.append(places[plain], places[of_single]) - begins
            suffixes = np.concatenate([codes[plain], codes[of_single]])
            marks = np.append(prints[(sent & ~often)[owners]], prints[single])
            ids = [batch.column(i).to_numpy() for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slot), *(pa.array(x[whose]) for x in ids), pa.array(begins), pa.array(leads),
                    _binary(suffixes, np.arange(len(suffixes) + 1) * 4 * window), _binary(marks, np.append(0, np.cumsum(widths)) * 8),
                ],
                names=["slot", *_ID, "first", "lead", "words", "prints"],
            )
            if len(known):
                texts, sizes = np.unique(rows[known], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.abs(ids[0][texts]) % groups), *(pa.array(x[texts]) for x in ids), pa.array(np.zeros(len(texts), np.int64)),
                        pa.array(np.zeros(len(texts), np.int64)), pa.nulls(len(texts), pa.binary()),
                        _binary(starts[known].astype(np.int64), np.append(0, np.cumsum(sizes)) * 8),
                    ],
                    names=["slot", *_ID, "first", "lead", "words", "prints"],
                )

    return chosen.select(*_ID, "_text", "shared", "often").mapInArrow(
        send, "slot long, r1 long, r2 long, first long, lead long, words binary, prints binary"
    )


def _tree_repeats(words: np.ndarray, row: np.ndarray, depth: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which windows share an inner node at least `depth` deep, and the fingerprint, with another window.

    words: a suffix in each row; row: the suffix of each window.
    """
    order = np.lexsort(words.T[::-1])
    ranked = words[order]
    differs = ranked[1:] != ranked[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    repeats = np.zeros(len(row), bool)
    for d in np.unique(depth):
        node = np.append(0, np.cumsum(common < d))
        own = np.flatnonzero(depth == d)
        nodes, marks = node[rank[row[own]]], prints[own]
        by = np.lexsort((nodes, marks))
        same = (nodes[by][1:] == nodes[by][:-1]) & (marks[by][1:] == marks[by][:-1])
        repeats[own[by[1:][same]]] = True
        repeats[own[by[:-1][same]]] = True
    return repeats


def find_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR_WORDS, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """What repeats, as two tables whose r1, r2 are the hash of a row's key and text.

    Of every row: _key, r1, r2, n_words, words_sha256, copies (rows with the same words, itself included). Of rows
    without copies that repeat in part: r1, r2, starts (the windows whose words also start elsewhere).

    Words are runs of bytes other than ASCII white space. A null text has none. Texts shorter than the window repeat
    nothing. Repeated rows are copies of each other. Empty tables give empty tables; other columns are ignored.
    """
    texts = _identified(docs, key, text)
    listed = stored(_listed(texts, window, anchor), "repeat-anchors")
    groups_of = listed.groupBy("words_sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*_ID)).alias("_first"))
    narrow = listed.drop("anchors")
    rows = narrow.join(groups_of, "words_sha256")
    first = groups_of.select(F.col("_first.r1").alias("r1"), F.col("_first.r2").alias("r2"), "copies")
    anchors = listed.where(F.size("anchors") > 0).join(first, _ID).select(*_ID, F.explode("anchors").alias("anchor"))

    shared = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1), "repeat-shared")
    total = shared.agg(F.sum("times")).first()[0] or 0
    groups = max(1, -(-total // GROUP_SUFFIXES))
    often = F.when(F.col("times") > LONG_PREFIX_FROM, F.col("anchor"))
    side = stored(
        anchors.join(shared, "anchor").groupBy(*_ID).agg(F.collect_set("anchor").alias("shared"), F.collect_set(often).alias("often")),
        "repeat-shared-by-text",
    )

    def build(part: pd.DataFrame) -> pd.DataFrame:
        trees, known = part[part["words"].notna()], part[part["words"].isna()]
        ids = [part[name].to_numpy(np.int64) for name in _ID]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(trees):
            words = np.frombuffer(b"".join(trees["words"]), "<u4").reshape(-1, window)
            widths = trees["prints"].map(len).to_numpy() // 8
            row = np.repeat(np.arange(len(trees)), widths)
            step = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(widths)[:-1]), widths)
            depth = window - (trees["lead"].to_numpy()[row] - step)
            repeats = _tree_repeats(words, row, depth, np.frombuffer(b"".join(trees["prints"]), np.uint64))
            starts = trees["first"].to_numpy()[row] + step
            found.append((*(trees[name].to_numpy()[row][repeats] for name in _ID), starts[repeats]))
        if len(known):
            widths = known["prints"].map(len).to_numpy() // 8
            found.append((*(np.repeat(known[name].to_numpy(), widths) for name in _ID), np.frombuffer(b"".join(known["prints"]), np.int64)))
        r1, r2, starts = (np.concatenate(x) for x in zip(*found)) if found else ids + [np.empty(0, np.int64)]
        order = np.lexsort((starts, r2, r1))
        r1, r2, starts = r1[order], r2[order], starts[order]
        cuts = np.flatnonzero(np.append(True, (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]))) if len(r1) else np.empty(0, np.int64)
        return pd.DataFrame({"r1": r1[cuts], "r2": r2[cuts], "starts": np.split(starts, cuts[1:]) if len(cuts) else []})

    suffixes = _suffixes(_joined_texts(texts, side), window, anchor, groups)
    pieces = suffixes.groupBy("slot").applyInPandas(build, "r1 long, r2 long, starts array<long>")
    starts = pieces.groupBy(*_ID).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    alone = rows.where(F.col("copies") == 1).select(*_ID)
    return rows.drop("_first"), starts.join(alone, _ID, "left_semi")


def kept_words(docs: DataFrame, starts: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """r1, r2, n_removed and kept_text (the other words, parted by spaces) of the rows that `starts` names."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for raw, starts in zip(batch.column(2), batch.column(3)):
                words = (raw.as_py() or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                begin = np.unique(np.asarray(starts.as_py(), np.int64))
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed.append(int(covered.sum()))
                texts.append(b" ".join(word for word, gone in zip(words, covered.tolist()) if not gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*_ID, "n_removed", "kept_text"],
            )

    joined = _joined_texts(_identified(docs, key, text), starts)
    return joined.select(*_ID, "_text", "starts").mapInArrow(cut, "r1 long, r2 long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row; see `find_repeats` for what repeats."""
    rows, starts = find_repeats(docs, window, anchor, key, text)
    starts = stored(starts, "repeat-starts")
    kept = kept_words(docs, starts, window, key, text).select(
        *_ID, F.col("n_removed").alias("_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("_kept")
    )
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return rows.join(kept, _ID, "left").select(
        F.col("_key").alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_kept", "words_sha256")).alias("kept_sha256"),
    )

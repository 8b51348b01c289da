"""Cluster bootstrap of ranking metrics by prefix sums over blocks of resamples.

The rows are ranked once. A slice of the ranking and the resamples form a matrix of weights that is never stored: a first
pass leaves its sums per slice and resample, their running totals over the slices say what lies above each slice,
and a second pass walks down every slice for all resamples at once and returns its share of AUC, average precision,
Brier score and captures. Stored rows number slices times resamples, however many rows and distinct scores there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.order_index import OrderIndex
from panelmill.session import cut_lineage

# floor(2^32 * P(X <= w)) of a Poisson variable with mean 1, for w = 0, 1, 2, ... 12.
POISSON_ONE = (
    1580030168,
    3160060337,
    3950075421,
    4213413783,
    4279248373,
    4292415291,
    4294609777,
    4294923276,
    4294962463,
    4294966817,
    4294967252,
    4294967292,
    4294967295,
)
_SLOTS = 4  # 32-bit draws in one digest
_CELLS = 1 << 19  # weights held at once
_KEPT = 1 << 24  # weights of one slice's clusters that are kept for all of its rows
_TASKS_A_SLICE = 2  # so that two slices seldom meet in a task
_DIGESTS = 1 << 13  # digests computed at once
_ONE_BLOCK = 55  # bytes up to which a message is one block of MD5
_SINES = [np.uint32(int(abs(math.sin(at + 1)) * 2**32)) for at in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _one_block_md5(heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """The four words of the digest of every tail behind every head, each an array (tails, heads). Rows are bytes."""
    length = heads.shape[1] + tails.shape[1]
    front, back = np.zeros((len(heads), 64), np.uint8), np.zeros((len(tails), 64), np.uint8)
    front[:, : heads.shape[1]] = heads
    back[:, heads.shape[1] : length] = tails
    back[:, length] = 0x80
    front, back = front.view("<u4").T[:, None, :], back.view("<u4").T[:, :, None]
    words = [
        back[at] if 4 * at >= heads.shape[1] else front[at] if 4 * at + 4 <= heads.shape[1] else front[at] | back[at] for at in range(16)
    ]
    words[14] = np.full((1, 1), 8 * length, np.uint32)
    shape = (len(tails), len(heads))
    a, b, c, d = (np.full(shape, word, np.uint32) for word in _BEGIN)
    mixed, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for at in range(64):
        if at < 16:
            word = at
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif at < 32:
            word = (5 * at + 1) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif at < 48:
            word = (3 * at + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            word = 7 * at % 16
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        mixed += a
        mixed += words[word] + _SINES[at]
        turn = _TURNS[at // 16][at % 4]
        np.left_shift(mixed, np.uint32(turn), out=turned)
        mixed >>= np.uint32(32 - turn)
        mixed |= turned
        np.add(mixed, b, out=a)
        a, b, c, d = d, a, b, c
    return [word + np.uint32(begin) for word, begin in zip((a, b, c, d), _BEGIN, strict=True)]


def _draws_of(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """Draws (tails, slots, heads): quarters of the MD5 digest of every tail behind every head, which are of one length each
    and together one block of MD5, or else are hashed one by one."""
    out = np.empty((len(tails), _SLOTS, len(heads)), np.uint32)
    if len(heads[0]) + len(tails[0]) > _ONE_BLOCK:
        for at, tail in enumerate(tails):
            digests = b"".join(hashlib.md5(head + tail, usedforsecurity=False).digest() for head in heads)
            out[at] = np.frombuffer(digests, ">u4").reshape(len(heads), _SLOTS).T
        return out
    front, back = (np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1) for part in (heads, tails))
    step = max(1, _DIGESTS // len(tails))
    for begin in range(0, len(heads), step):
        for slot, word in enumerate(_one_block_md5(front[begin : begin + step], back)):
            out[:, slot, begin : begin + step] = word.byteswap()
    return out


def _by_length(texts: Sequence[bytes]) -> list[np.ndarray]:
    lengths = np.array([len(text) for text in texts])
    return [np.flatnonzero(lengths == length) for length in np.unique(lengths)]


def _weights_of(resamples: int, seed: int):
    """A function from clusters (texts) to their Poisson(1) weights: a row for every resample, and a last row of 1 that
    stands for the rows as they are. A draw is a quarter of a digest of cluster, block of resamples and seed, so no
    resample needs another, and a task that is run again draws the same. The digests of many clusters and blocks are
    computed together, step by step of MD5."""
    bounds = np.asarray(POISSON_ONE, dtype=np.uint32)
    tails = [f"{block}|{seed}".encode() for block in range(-(-resamples // _SLOTS))]
    # The upper 16 bits say the weight, except where a bound lies among the draws that share them.
    low, high = (np.searchsorted(bounds, (np.arange(1 << 16) << 16 | end).astype(np.uint32), side="right") for end in (0, 0xFFFF))
    coarse = np.where(low == high, low, 255).astype(np.uint8)

    def weights(clusters: Sequence[str | None]) -> np.ndarray:
        heads = [b"" if cluster is None else f"{cluster}|".encode() for cluster in clusters]
        out = np.ones((resamples + 1, len(heads)), np.uint8)
        for some in _by_length(heads):
            for blocks in _by_length(tails):
                draws = _draws_of([heads[at] for at in some], [tails[at] for at in blocks]).reshape(-1, len(some))
                weight = coarse[draws >> np.uint32(16)]
                unclear = weight == 255
                weight[unclear] = np.searchsorted(bounds, draws[unclear], side="right")
                drawn = (blocks[:, None] * _SLOTS + np.arange(_SLOTS)).ravel()
                wanted = drawn < resamples
                out[drawn[wanted][:, None], some] = weight[wanted]
        return out

    return weights


def _slice_sums(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Weight and positives of each slice in each resample."""
    weights = _weights_of(resamples, seed)
    at_once = max(1, _CELLS // (resamples + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows and positives of a cluster in a slice first, so that it is drawn once for each slice
        held: list[pa.Table] = []
        for batch in batches:
            held.append(_per_cluster(pa.Table.from_batches([batch]).append_column("rows", pa.array(np.ones(batch.num_rows, np.int64)))))
            if len(held) > 1 and held[-2].num_rows <= 2 * held[-1].num_rows:
                held = [*held[:-2], _per_cluster(pa.concat_tables(held[-2:]))]
        if not held:
            return
        whole = _per_cluster(pa.concat_tables(held)).sort_by("_slice")
        part = whole["_slice"].to_numpy()
        counts = np.stack((whole["rows"].to_numpy(), whole["label"].to_numpy())).astype(np.float64)
        names = whole["cluster"].to_pylist()
        for which in np.unique(part):
            sums = np.zeros((2, resamples + 1))
            begin, end = np.searchsorted(part, [which, which + 1])
            for at in range(begin, end, at_once):
                upto = min(at + at_once, end)
                sums += counts[:, at:upto] @ weights(names[at:upto]).T.astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(resamples + 1, which), pa.int32()),
                    pa.array(np.arange(resamples + 1), pa.int32()),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                ],
                names=["_slice", "resample", "weight", "pos"],
            )

    narrow = rows.select("_slice", F.col("label").cast("bigint").alias("label"), "cluster")
    found = narrow.mapInArrow(run, "_slice int, resample int, weight double, pos double")
    # a slice of several tasks is still one slice
    return found.groupBy("_slice", "resample").agg(F.sum("weight").alias("weight"), F.sum("pos").alias("pos"))


def _per_cluster(some: pa.Table) -> pa.Table:
    summed = some.group_by(["_slice", "cluster"]).aggregate([("label", "sum"), ("rows", "sum")])
    return summed.select(["_slice", "label_sum", "cluster", "rows_sum"]).rename_columns(["_slice", "label", "cluster", "rows"])


PARTS = (
    "resample int, score double, pos double, weight double, pos_above double, weight_above double, auc double, ap double, "
    "squared_error double, hits array<double>"
)


def _slice_parts(
    rows: DataFrame, above: DataFrame, slices: int, resamples: int, seed: int, shares: Sequence[float]
) -> DataFrame:
    """What every slice adds to each resample: one row of sums over the levels that lie within the slice, and one for
    each of its first and last level, which may go on in its neighbours."""
    weights = _weights_of(resamples, seed)
    width = resamples + 1
    at_once = max(1, _CELLS // width)
    share = np.asarray(shares, dtype=np.float64)

    def run(own: pa.Table, totals: pa.Table) -> pa.Table:
        names = [part.split(" ")[0] for part in PARTS.split(", ")]
        if own.num_rows == 0:
            return pa.table([pa.array([], kind) for kind in (pa.int32(), *[pa.float64()] * 8, pa.list_(pa.float64()))], names=names)
        order = np.argsort(own["position"].to_numpy(), kind="stable")
        score, y = own["score"].to_numpy()[order], own["label"].to_numpy()[order].astype(np.float64)
        clusters = own["cluster"].combine_chunks().dictionary_encode(null_encoding="encode")
        names_of, code = clusters.dictionary.to_pylist(), clusters.indices.to_numpy()[order]
        kept = weights(names_of) if len(names_of) * width <= _KEPT else None
        totals = totals.sort_by("resample")
        weight_above, pos_above, weight_total = (totals[name].to_numpy() for name in ("weight_above", "pos_above", "weight_total"))
        limits = share[:, None] * weight_total
        # Neighbouring levels without a positive count as one, but for the first and the last.
        begins = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        has = np.add.reduceat(y, begins) > 0
        alone = has.copy()
        alone[[0, -1]] = True
        joined = np.append(~alone[:-1] & ~alone[1:], False)
        ends = np.append(begins[1:], len(score))[~joined] - 1  # the last row of each of these
        closes = np.zeros(len(score), dtype=bool)
        closes[ends] = True
        auc, ap, error, hits = np.zeros(width), np.zeros(width), np.zeros(width), np.zeros((len(share), width))
        edges = []
        running_w, running_p = weight_above.copy(), pos_above.copy()
        level_w, level_p = running_w, running_p
        for begin in range(0, len(score), at_once):
            rows_here = slice(begin, begin + at_once)
            if kept is None:
                used, place = np.unique(code[rows_here], return_inverse=True)
                w = weights([names_of[at] for at in used])[:, place]
            else:
                w = kept[:, code[rows_here]]
            here = y[rows_here]
            positive = np.flatnonzero(here)
            w_pos = w[:, positive]
            so_far_w, so_far_p = (np.cumsum(some, axis=1, dtype=np.int64) for some in (w, w_pos))
            end_of_w, end_of_p = running_w + so_far_w[:, -1], running_p + w_pos.sum(axis=1, dtype=np.int64)
            error += w.astype(np.float64) @ ((score[rows_here] - here) ** 2)
            for at in range(len(share)):
                inside = end_of_w <= limits[at]
                hits[at] += np.where(inside, end_of_p - running_p, 0.0)
                cut = np.flatnonzero(~inside & (running_w <= limits[at]))  # the share ends among these rows
                if len(cut) and len(positive):
                    down_w = running_w[cut, None] + so_far_w[cut[:, None], positive]
                    hits[at, cut] += (w_pos[cut] * (down_w <= limits[at, cut, None])).sum(axis=1)
            closing = np.flatnonzero(closes[rows_here])
            if len(closing):
                seen = np.searchsorted(positive, closing, side="right")
                end_w = running_w[:, None] + so_far_w[:, closing]
                end_p = running_p[:, None] + np.concatenate((np.zeros((width, 1), np.int64), so_far_p), axis=1)[:, seen]
                start_w, start_p = np.column_stack((level_w, end_w[:, :-1])), np.column_stack((level_p, end_p[:, :-1]))
                level_w, level_p = end_w[:, -1], end_p[:, -1]
                pos, weight = end_p - start_p, end_w - start_w
                inner = np.ones(len(closing))
                for at, row in enumerate(closing + begin):
                    if row in (ends[0], ends[-1]):
                        inner[at] = 0.0
                        edges.append((float(score[row]), pos[:, at], weight[:, at], start_p[:, at], start_w[:, at]))
                auc += ((weight - pos) * (start_p + 0.5 * pos)) @ inner
                precision = np.divide(end_p, end_w, out=np.zeros_like(end_p), where=end_w > 0)
                ap += (pos * precision) @ inner
            running_w, running_p = end_of_w, end_of_p
        number = pa.array(np.arange(width), pa.int32())
        nothing = pa.nulls(width, pa.float64())
        listed = pa.ListArray.from_arrays(np.arange(width + 1, dtype=np.int32) * len(share), pa.array(hits.T.ravel()))
        parts = [[number, *[nothing] * 5, pa.array(auc), pa.array(ap), pa.array(error), listed]]
        for value, *sums in edges:
            parts.append(
                [number, pa.array(np.full(width, value)), *map(pa.array, sums), *[nothing] * 3, pa.nulls(width, pa.list_(pa.float64()))]
            )
        return pa.concat_tables([pa.table(part, names=names) for part in parts])

    own = rows.select("_slice", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), "cluster", "position")
    # A number of partitions keeps small slices, whose work is large, from being put together in few tasks.
    tasks = max(1, _TASKS_A_SLICE * slices)
    own, above = own.repartition(tasks, "_slice"), above.repartition(tasks, "_slice")
    return own.groupBy("_slice").cogroup(above.groupBy("_slice")).applyInArrow(run, PARTS)


def resampled_metrics(
    index: OrderIndex, cluster: str, resamples: int, seed: int, shares: Sequence[float]
) -> DataFrame:
    """resample, positives, weight, roc_auc, pr_auc, brier and captures (an array in the order of `shares`) of every
    resample; the resample numbered `resamples` is the rows as they are. Metrics are NULL where a class is missing.

    `index` orders `label` and `score` with the best first; the cluster column must be among its rows. A cluster is in
    a resample with a Poisson(1) weight. Stores slices times resamples rows, twice, when called.
    """
    rows = index.ranked().withColumn("cluster", F.col(cluster).cast("string"))
    sums = cut_lineage(_slice_sums(rows, resamples, seed))
    earlier = Window.partitionBy("resample").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0.0)).alias(f"{name}_above")

    whole = F.sum("weight").over(Window.partitionBy("resample")).alias("weight_total")
    above = sums.select("_slice", "resample", before("weight"), before("pos"), whole)
    slices = index.slices.count()
    parts = cut_lineage(_slice_parts(rows, above, slices, resamples, seed, shares))

    inner = parts.filter("score IS NULL").groupBy("resample").agg(
        *[F.sum(name).alias(name) for name in ("auc", "ap", "squared_error")],
        F.array(*[F.sum(F.col("hits")[at]) for at in range(len(shares))]).alias("hits"),
    )
    level = parts.filter("score IS NOT NULL").groupBy("resample", "score").agg(
        F.sum("pos").alias("pos"), F.sum("weight").alias("weight"), F.min("pos_above").alias("p"), F.min("weight_above").alias("w")
    )
    reached = F.when(F.col("w") + F.col("weight") > 0, (F.col("p") + F.col("pos")) / (F.col("w") + F.col("weight"))).otherwise(0.0)
    edge = level.groupBy("resample").agg(
        F.sum((F.col("weight") - F.col("pos")) * (F.col("p") + 0.5 * F.col("pos"))).alias("edge_auc"),
        F.sum(F.col("pos") * reached).alias("edge_ap"),
    )
    total = sums.groupBy("resample").agg(F.sum("pos").alias("positives"), F.sum("weight").alias("weight"))
    p, n = F.col("positives"), F.col("weight") - F.col("positives")
    both = (p > 0) & (n > 0)
    return (
        total.join(inner, "resample")
        .join(edge, "resample")
        .select(
            "resample",
            "positives",
            "weight",
            F.when(both, (F.col("auc") + F.col("edge_auc")) / (p * n)).alias("roc_auc"),
            F.when(both, (F.col("ap") + F.col("edge_ap")) / p).alias("pr_auc"),
            F.when(both, F.col("squared_error") / F.col("weight")).alias("brier"),
            F.when(both, F.transform("hits", lambda hit: hit / p)).alias("captures"),
        )
    )

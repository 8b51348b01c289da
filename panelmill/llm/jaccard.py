"""Near-duplicate texts by exact Jaccard similarity of their word shingles: a grouped prefix join.

1. Shingles are counted over all documents. Those in many documents (a bounded number of them) are known to every
   task, and shingles are ordered by count, then hash: rare ones first. Two sets as similar as the threshold share a
   shingle within their prefixes, the first n - ceil(t n) + 1 of each.
2. Equal sets are one node. Nodes with identical prefix and size are one group; only groups are joined.
3. Group pairs must pass the size filter, the position filter (what comes before the first common shingle is not
   common) and the prefix filter: whichever prefix ends first, each of its shingles
   that the other prefix lacks is lacking in the whole other set.
4. Surviving pairs are expanded to their members, which are verified on their whole sets.

Only connectivity is asked for, so no group of copies is expanded into all its pairs. In a first round every group is
compared with the first group of each shingle's list, which already connects most copies. In a second round only
pairs from different components are compared, all of them, so that no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.components import connected
from panelmill.llm.storage import positional, stored, tidy

WORDS = 5
SIMILARITY = (80, 100)
#: shingles known by count to every task, and the least count that makes one of them
KNOWN_SHINGLES, KNOWN_FROM = 1 << 20, 16
#: shingles counted in one task, about, and texts whose shingles are counted before the shuffle
_COUNTED_TOGETHER, _COUNTED_ROWS = 2_000_000, 2_500
#: texts whose prefixes are sent to Spark together
_DESCRIBED_ROWS = 1_000
#: rows of a (key, id) pair up to which a side is broadcast
BROADCAST_ROWS = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words (A-Z in lower case, parted by ASCII white space);
    the whole text is one run if it has fewer, and a text without words has none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    runs = max(len(found) - words + 1, 1)
    out = np.full(runs, min(len(found), words), np.uint64)
    for k in range(min(words, len(found))):
        out = (out ^ hashes[k : k + runs]) * _MIX[k % 4]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def common_shingles(texts: DataFrame, words: int, known: int = KNOWN_SHINGLES, least: int = KNOWN_FROM) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the most documents, at most `known`: sorted keys and their numbers of documents.

    Counts are exact but for shingles whose upper 32 bits and bucket agree, which only affects the order. A task
    sends each shingle once for each of its batches, so a frequent one is counted before the shuffle.
    """
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = 1
    while buckets * _COUNTED_TOGETHER * 6 < size:
        buckets *= 2
    mask = np.uint64(buckets - 1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(at, _COUNTED_ROWS) for batch in batches for at in range(0, batch.num_rows, _COUNTED_ROWS)):
            sets = [shingle_set(raw.as_py() or b"", words) for raw in batch.column(0)]
            shingles, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            bucket = shingles & mask
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            upper, counts = (shingles[order] >> np.uint64(32)).astype("<u4"), counts[order].astype("<u4")
            rows = []
            for k in range(buckets):
                part, times = upper[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]]
                if len(part):
                    rows.append((k, part[times == 1].tobytes(), part[times > 1].tobytes(), times[times > 1].tobytes()))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "once", "more", "times"]
            )

    def total(part: pd.DataFrame) -> pd.DataFrame:
        once, more, times = (np.frombuffer(b"".join(part[name]), "<u4") for name in ("once", "more", "times"))
        # key and count in one number, so that sorting in place brings equal keys together
        packed = np.empty(len(once) + len(more), np.uint64)
        packed[: len(once)], packed[len(once) :] = once, more
        packed <<= np.uint64(32)
        packed[: len(once)] |= np.uint64(1)
        packed[len(once) :] |= times
        del once, more, times
        packed.sort()
        keys = (packed >> np.uint64(32)).astype("<u4")
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys = keys[starts]
        packed &= np.uint64(0xFFFFFFFF)
        sums = np.add.reduceat(packed, starts).astype(np.int64)
        kept = sums >= least
        return pd.DataFrame({"key": keys[kept].astype(np.int64) * buckets + int(part["bucket"].iloc[0]), "docs": sums[kept]})

    counted = stored(
        texts.mapInArrow(tidy(count), "bucket int, once binary, more binary, times binary").groupBy("bucket").applyInPandas(total, "key long, docs long"),
        "shingle-counts",
    )
    # the least count so that at most `known` shingles have it or more
    tally = sorted(((row["docs"], row["count"]) for row in counted.groupBy("docs").count().collect()), reverse=True)
    from_count, held = None, 0
    for docs, shingles in tally:
        held += shingles
        if held > known:
            break
        from_count = docs
    if from_count is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), buckets
    found = counted.where(F.col("docs") >= from_count).toPandas().sort_values("key")
    return found["key"].to_numpy(np.uint64), found["docs"].to_numpy(np.int64), buckets


def _prefix_length(n: int, similarity: tuple[int, int]) -> int:
    return n - -(-similarity[0] * n // similarity[1]) + 1


def _described(texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """_key, _hash, n, node (hash of the set), bunch (hash of prefix and size), prefix; node is null without words."""
    keys, docs, buckets = common_shingles(texts.select("_text"), words)
    shared = texts.sparkSession.sparkContext.broadcast((keys, docs))
    mask, shift = np.uint64(buckets - 1), np.uint64(buckets.bit_length() - 1)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in (batch.slice(at, _DESCRIBED_ROWS) for batch in batches for at in range(0, batch.num_rows, _DESCRIBED_ROWS)):
            sizes, nodes, bunches, prefixes = [], [], [], []
            for raw in batch.column(1):
                found = shingle_set(raw.as_py() or b"", words)
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None), bunches.append(None), prefixes.append(None)
                    continue
                if len(known):
                    key = ((found >> np.uint64(32)) << shift) | (found & mask)
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    order = np.lexsort((found, np.where(known[at] == key, counts[at], 0)))
                else:
                    order = np.arange(len(found))
                prefix = found[order[: _prefix_length(len(found), similarity)]].view(np.int64)
                nodes.append(_digest(found.tobytes()))
                bunches.append(_digest(prefix.tobytes() + len(found).to_bytes(8, "little")))
                prefixes.append(prefix)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bunches, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                names=["_key", "_hash", "n", "node", "bunch", "prefix"],
            )

    kind = texts.schema["_key"].dataType.simpleString()
    return texts.mapInArrow(tidy(describe), f"_key {kind}, _hash long, n long, node long, bunch long, prefix array<long>")


def _may_link(n: Column, at: Column, m: Column, by: Column, similarity: tuple[int, int]) -> Column:
    """Size and position filter for sets of n and m shingles whose first common one is number `at` and `by` of them."""
    part, whole = similarity
    sizes = F.least(n, m) * whole >= F.greatest(n, m) * part
    return sizes & (F.least(n - at, m - by) * (whole + part) >= (n + m) * part)


def _filtered(pairs: DataFrame, bunches: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of groups that the prefix filter cannot rule out."""
    part, whole = similarity
    sides = [bunches.select(F.col("bunch").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("p_a", "p_b"))
    most = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b")) + common
    return both.where(most * (whole + part) >= (F.col("n_a") + F.col("n_b")) * part).select("a", "b")


def _verified(pairs: DataFrame, sources: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) of nodes whose whole sets are similar enough; sources: a key for each node."""
    pairs = stored(pairs, "jaccard-pairs")
    wanted = stored(
        sources.join(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct(), "node"),
        "jaccard-wanted",
    )
    side = wanted.select(F.col("_key").alias("_wanted"), "node")
    side = F.broadcast(side) if wanted.count() <= BROADCAST_ROWS else side
    chosen = texts.join(side, F.col("_key").eqNullSafe(F.col("_wanted"))).select("node", "_text")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(raw.as_py() or b"", words) for raw in batch.column(1)]
            kept = [k for k, (node, own) in enumerate(zip(batch.column(0).to_pylist(), found)) if node == _digest(own.tobytes())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array([found[k].tobytes() for k in kept], pa.binary())],
                names=["node", "shingles"],
            )

    sets = stored(chosen.mapInArrow(tidy(extract), "node long, shingles binary").dropDuplicates(["node"]), "jaccard-sets")
    first, second = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "xy")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                one, other = (np.frombuffer(batch.column(i)[k].as_buffer(), np.uint64) for i in (2, 3))
                common = len(one) + len(other) - len(np.union1d(one, other))
                kept.append(common * similarity[1] >= (len(one) + len(other) - common) * similarity[0])
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(kept, pa.bool_())) for i in (0, 1)], names=["u", "v"])

    return pairs.join(first, "x").join(second, "y").select("x", "y", "s_x", "s_y").mapInArrow(tidy(verify), "u long, v long")


def _ordered(one: Column, other: Column) -> tuple[Column, Column]:
    return F.least(one, other), F.greatest(one, other)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row, and class_id (a number
    for the component, null without words) and text_hash (xxhash64), by which repeated keys can be told apart.

    Two texts link when part of `similarity` times the union of their shingle sets is at most whole times their
    intersection. Null, empty and blank texts have no shingles, link with nothing and are their own component, equal
    ones too. Repeated rows stay, and equal texts always link. Null keys are allowed; a component of only such rows
    has a null id. An empty table gives an empty result; other columns are ignored.
    """
    body = F.col(text).cast("string")
    texts = docs.select(F.col(key).alias("_key"), body.cast("binary").alias("_text"), F.xxhash64(body).alias("_hash"))
    described = stored(_described(texts, words, similarity), "jaccard-prefixes")
    rows = described.select("_key", "_hash", "n", "node")
    filled = described.where(F.col("node").isNotNull())
    sources = filled.groupBy("node").agg(F.min("_key").alias("_key"), F.first("bunch").alias("bunch"))
    members = stored(sources, "jaccard-nodes")
    # in a group every row has the same prefix
    bunches = stored(filled.select("bunch", "n", "prefix").dropDuplicates(["bunch"]), "jaccard-groups")

    # a list's first group is the one with the fewest rarer shingles: the least edited of a group of copies
    postings = bunches.select("bunch", "n", F.posexplode("prefix").alias("at", "shingle"))
    lists = postings.groupBy("shingle").agg(
        F.min(F.struct("at", "n", "bunch")).alias("head"), F.min("bunch").alias("low"), F.max("bunch").alias("high")
    )
    shared = stored(
        postings.join(lists.where(F.col("low") != F.col("high")).select("shingle", "head"), "shingle").select(
            "shingle", "bunch", "n", "at", F.col("head.bunch").alias("first"), F.col("head.n").alias("n_first"), F.col("head.at").alias("at_first")
        ),
        "jaccard-lists",
    )

    # first round: every group with the first of each of its lists, and every node with the first of its group
    starred = (
        shared.where(
            (F.col("bunch") != F.col("first"))
            & _may_link(F.col("n"), F.col("at"), F.col("n_first"), F.col("at_first"), similarity)
        )
        .select(F.col("first").alias("a"), F.col("bunch").alias("b")).distinct()
    )
    leaders = members.groupBy("bunch").agg(F.min("node").alias("lead"))
    lead = [leaders.select(F.col("bunch").alias(x), F.col("lead").alias(y)) for x, y in ("ax", "by")]
    across = _filtered(starred, bunches, similarity).join(lead[0], "a").join(lead[1], "b").select("x", "y")
    inside = members.join(leaders, "bunch").where(F.col("node") != F.col("lead")).select(F.col("lead").alias("x"), F.col("node").alias("y"))
    links = stored(_verified(across.unionByName(inside), members, texts, words, similarity), "jaccard-links")

    # second round: what different components still share
    found = connected(links)
    placed = stored(
        members.join(found, "node", "left").select("node", "bunch", F.coalesce("root", F.col("node")).alias("part")), "jaccard-parts"
    )
    owner = placed.groupBy("bunch").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    whole = stored(
        owner.select("bunch", F.when(F.col("low") == F.col("high"), F.col("low")).alias("part")), "jaccard-group-parts"
    )
    entries = shared.join(whole, "bunch").join(whole.select(F.col("bunch").alias("first"), F.col("part").alias("main")), "first")
    apart = entries.where(F.col("part").isNull() | F.col("main").isNull() | (F.col("part") != F.col("main")))
    apart = apart.select(
        "shingle", F.col("bunch").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("part").alias("part_a")
    )
    mixed_lists = apart.select("shingle").distinct()
    others = entries.join(mixed_lists, "shingle", "left_semi").select(
        "shingle", F.col("bunch").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("part").alias("part_b")
    )
    small, large = _ordered(F.col("a"), F.col("b"))
    crossing = (
        apart.join(others, "shingle")
        .where(
            (F.col("a") != F.col("b")) & _may_link(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), similarity)
            & ~F.coalesce(F.col("part_a") == F.col("part_b"), F.lit(False))
        )
        .select(small.alias("a"), large.alias("b")).distinct()
    )
    sides = [placed.select(F.col("bunch").alias(x), F.col("node").alias(y), F.col("part").alias(f"part_{y}")) for x, y in ("ax", "by")]
    left = _filtered(crossing, bunches, similarity).join(sides[0], "a").join(sides[1], "b").where(F.col("part_x") != F.col("part_y"))
    mixed = whole.where(F.col("part").isNull()).select("bunch")
    within = [placed.join(mixed, "bunch", "left_semi").select("bunch", F.col("node").alias(y), F.col("part").alias(f"part_{y}")) for y in "xy"]
    inner = within[0].join(within[1], "bunch").where((F.col("x") < F.col("y")) & (F.col("part_x") != F.col("part_y")))
    more = _verified(
        left.select("x", "y").unionByName(inner.select("x", "y")).distinct(), members, texts, words, similarity
    )
    ends = connected(links.unionByName(more))
    named = rows.join(ends, "node", "left").withColumn("_part", F.coalesce("root", "node")).select("_key", "_hash", "n", "_part")
    smallest = named.where(F.col("_part").isNotNull()).groupBy("_part").agg(F.min("_key").alias("_least"))
    return named.join(smallest, "_part", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("_part").isNull(), F.col("_key")).otherwise(F.col("_least")).alias("component_id"),
        F.col("_part").alias("class_id"), F.col("_hash").alias("text_hash"),
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with one row of each class of near duplicates: the one with the smallest key.

    Texts without words are in no class and all stay. Every column passes through.
    """
    columns = docs.columns
    docs, at = positional(docs)
    key, text = at[key], at[text]
    found = stored(near_duplicates(docs, words, similarity, key, text).where(F.col("class_id").isNotNull()), "jaccard-classes")
    row = F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))
    chosen = found.groupBy("class_id").agg(F.min(row).alias("_chosen"), F.count(F.lit(1)).alias("_rows"))
    gone = stored(
        found.join(chosen.where(F.col("_rows") > 1), "class_id").where(~row.eqNullSafe(F.col("_chosen")))
        .select(F.col(key).alias("_k"), F.col("text_hash").alias("_h")).distinct(),
        "jaccard-dropped",
    )
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    hashed = F.xxhash64(F.col(text).cast("string"))
    kept = docs.withColumn("_hash", hashed).join(side, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_anti")
    if found.groupBy(key, "text_hash").count().where(F.col("count") > 1).isEmpty():
        return kept.select(*docs.columns).toDF(*columns)
    # rows repeated as a whole: one of each, but for those without words
    apart = F.when(F.col(text).rlike(r"[^\x09-\x0D ]"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return kept.withColumn("_apart", apart).dropDuplicates([key, "_hash", "_apart"]).select(*docs.columns).toDF(*columns)

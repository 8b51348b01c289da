"""Exact ranked lexical search in sparse ball trees.

A document is a vector of integer term contributions, a query the set of its terms: the score is their inner product.
Every task groups the documents it holds into trees. A node keeps the centroid c of its vectors and their radius. One
radius over thousands of terms says little about a query of thirty, so terms are put into groups that occur in the same
part of the tree, and a node keeps a radius r_g for each: no document below it scores more than the sum over the groups
of <q_g, c_g> + |q_g| r_g. Rounding is kept on the safe side: squared distances are raised by more than all rounding of
their sums, and radii and bounds by more than that of their products. For each query the nodes are visited best bound
first until no bound reaches the k-th score found so far; a tie is still looked at, because the smaller key wins it.
Leaves are scored in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from panelmill.llm.storage import stored
from panelmill.operators.ranking import running_totals

#: letters and digits of ASCII, and everything beyond it
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: terms of the queries that are searched for at once, and queries (a query with more terms is a block of its own)
BLOCK_TERMS, BLOCK_QUERIES = 8192, 512
#: documents of a leaf, groups of terms, and numbers that the centroids of one tree may hold
LEAF_ROWS, TERM_GROUPS, CENTROID_CELLS = 32, 512, 1 << 22
#: unit of the contributions, and the share of a document's length in its damping
UNIT, LENGTH_PERCENT = 1_000_000_000, 90
_SAFE = 1e-9


def terms_of(text: str) -> F.Column:
    """All terms of a text in order, upper case kept; null texts have none."""
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(TERM), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


@dataclass
class Tree:
    """Rows in leaf order; nodes in order of creation, children after their parent. Group g holds the columns
    by_group[edges[g] : edges[g + 1]]; radii are per node and group."""

    order: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    centroids: np.ndarray
    children: list[tuple[int, int] | None]
    rows: list[tuple[int, int]]
    by_group: np.ndarray
    edges: np.ndarray
    radii: np.ndarray


def _slack(width: int) -> float:
    """More than the relative rounding error of a sum of `width` squares or products."""
    return (width + 64) * 2.0**-50


def _distances(c: np.ndarray, row: np.ndarray, terms: np.ndarray, values: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Distances of the rows from c, about."""
    product = np.bincount(row, weights=values * c[terms], minlength=len(squares))
    own = float(c @ c)
    return np.sqrt(np.maximum(squares - 2 * product + own, 0))


def _group_radii(tree: Tree) -> np.ndarray:
    """The greatest distance of a row below each node from its centroid, within each group, never too small: for leaves
    from their rows, above them by the distance to the children's centroids and their radii."""
    width, groups = tree.centroids.shape[1], len(tree.edges) - 1
    group = np.empty(width, dtype=np.int64)
    group[tree.by_group] = np.repeat(np.arange(groups), np.diff(tree.edges))
    radii = np.zeros((len(tree.children), groups))
    for node in range(len(tree.children) - 1, -1, -1):
        c, pair = tree.centroids[node], tree.children[node]
        if pair is None:
            first, last = tree.rows[node]
            at = slice(tree.starts[first], tree.starts[last])
            terms, x = tree.terms[at], tree.values[at].astype(np.float64)
            row = np.repeat(np.arange(last - first), np.diff(tree.starts[first : last + 1]))
            cell, size = row * groups + group[terms], (last - first) * groups
            own = np.add.reduceat((c * c)[tree.by_group], tree.edges[:-1])
            # (x - c)^2 = x^2 - 2 x c + c^2 at a row's terms, c^2 at all others
            squares = np.bincount(cell, weights=x * (x - 2 * c[terms]), minlength=size).reshape(-1, groups) + own
            parts = np.bincount(cell, weights=x * (x + 2 * c[terms]), minlength=size).reshape(-1, groups) + own
            radii[node] = np.sqrt(np.maximum(squares, 0) + _slack(width) * parts).max(axis=0)
        else:
            for child in pair:
                step = tree.centroids[child] - c
                apart = np.sqrt(np.add.reduceat((step * step)[tree.by_group], tree.edges[:-1]))
                radii[node] = np.maximum(radii[node], apart + radii[child])
        radii[node] *= 1 + _SAFE
    return radii


def build(
    starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF_ROWS, groups: int = TERM_GROUPS
) -> Tree:
    """A ball tree over sparse rows, none of them empty: row i has `values` at the columns `terms` from starts[i] to
    starts[i + 1].

    A node is split by the nearer of two far-apart rows; where that leaves a side small (equal rows, say), in the middle
    of the order that it gives. Columns are grouped by their mean place among the leaves.
    """
    centroids, children, spans, order = [], [], [], []
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    weights = values.astype(np.float64)
    squares = np.bincount(row, weights=weights * weights, minlength=len(sizes))
    waiting = [(np.arange(len(sizes)), row, terms, weights, squares, -1, 0)]
    done = 0
    while waiting:
        members, row, own_terms, own, square, parent, side = waiting.pop()
        node = len(centroids)
        if parent >= 0:
            children[parent] = (node, children[parent][1]) if side == 0 else (children[parent][0], node)
        c = np.bincount(own_terms, weights=own, minlength=width) / len(members)
        away = _distances(c, row, own_terms, own, square)
        centroids.append(c)
        if len(members) <= leaf:
            children.append(None)
            spans.append((done, done + len(members)))
            order.append(members)
            done += len(members)
            continue
        children.append((-1, -1))
        spans.append((-1, -1))

        def dense(at: int) -> np.ndarray:
            out = np.zeros(width)
            mine = row == at
            out[own_terms[mine]] = own[mine]
            return out

        one = int(away.argmax())
        first = dense(one)
        other = int(_distances(first, row, own_terms, own, square).argmax())
        second = dense(other)
        lean = np.bincount(row, weights=own * (first - second)[own_terms], minlength=len(members)) - (square[one] - square[other]) / 2
        nearer = lean > 0
        if not len(members) // 16 < nearer.sum() < len(members) - len(members) // 16:
            nearer = np.zeros(len(members), dtype=bool)
            nearer[np.argsort(-lean, kind="stable")[: len(members) // 2]] = True
        # the second half waits longer, so leaves come in order of their nodes
        for chosen, side in ((~nearer, 1), (nearer, 0)):
            number = np.cumsum(chosen) - 1
            mine = chosen[row]
            waiting.append((members[chosen], number[row[mine]], own_terms[mine], own[mine], square[chosen], node, side))
    order = np.concatenate(order)
    lengths = sizes[order]
    new_starts = np.concatenate(([0], np.cumsum(lengths)))
    pick = np.repeat(starts[:-1][order] - new_starts[:-1], lengths) + np.arange(new_starts[-1])
    terms, values = terms[pick], values[pick]
    place = np.repeat(np.arange(len(order)), lengths)
    mean = np.bincount(terms, weights=place, minlength=width) / np.maximum(np.bincount(terms, minlength=width), 1)
    edges = np.unique(np.arange(groups + 1) * width // groups)
    tree = Tree(
        order, new_starts, terms, values, np.asarray(centroids), children, spans, np.argsort(mean), edges, np.empty(0)
    )
    tree.radii = _group_radii(tree)
    return tree


class Search:
    """The best k rows of each query over any number of trees."""

    def __init__(self, queries: list[np.ndarray], width: int, k: int) -> None:
        self._masks = np.zeros((width, len(queries)))
        for at, terms in enumerate(queries):
            self._masks[terms, at] = 1
        self._has = np.ascontiguousarray(self._masks.T.astype(bool))
        self._k = k
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.leaves_seen = self.leaves = 0

    def add(self, tree: Tree, keys: list) -> None:
        """keys: of the tree's rows, before they were put in its order."""
        norms = np.sqrt(np.add.reduceat(self._masks[tree.by_group], tree.edges[:-1], axis=0))
        bounds = (tree.centroids @ self._masks + tree.radii @ norms) * (1 + _SAFE)
        self.leaves += sum(pair is None for pair in tree.children) * len(self.best)
        for query, best in enumerate(self.best):
            bound = bounds[:, query].tolist()
            waiting = [(-bound[0], 0)]
            while waiting:
                most, node = heappop(waiting)
                if -most < (best[-1][0] if len(best) == self._k else 1):
                    break
                pair = tree.children[node]
                if pair is None:
                    self._score(tree, node, query, keys)
                    best = self.best[query]
                else:
                    for child in pair:
                        heappush(waiting, (max(most, -bound[child]), child))

    def _score(self, tree: Tree, node: int, query: int, keys: list) -> None:
        self.leaves_seen += 1
        first, last = tree.rows[node]
        begin, end = tree.starts[first], tree.starts[last]
        hit = np.where(self._has[query][tree.terms[begin:end]], tree.values[begin:end], 0)
        scores = np.add.reduceat(hit, tree.starts[first:last] - begin)
        best = self.best[query]
        least = best[-1][0] if len(best) == self._k else 1
        new = [(int(scores[at]), keys[tree.order[first + at]]) for at in np.flatnonzero(scores >= least)]
        if new:
            found = sorted([*best, *new], key=lambda pair: (-pair[0], pair[1] is None, pair[1]))
            self.best[query] = found[: self._k]


def _slices(sizes: np.ndarray, rows: int, entries: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows, and of about `entries` entries."""
    begin, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at - begin == rows or held and held + size > entries:
            yield begin, at
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """key, n (all terms), terms (numbers in the vocabulary, each once) and counts of the rows that have terms."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    integers = ArrayType(IntegerType())
    schema = StructType(
        [StructField("key", docs.schema["key"].dataType), StructField("n", LongType()), StructField("terms", integers), StructField("counts", integers)]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.string())
        width = len(known)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            number = pc.index_in(pc.ascii_lower(lists.flatten()), known)
            there = number.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[there]
            pair, count = np.unique(row * width + number.drop_null().to_numpy(), return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(pair // width, minlength=len(sizes))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % width, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *lists], names=schema.names)

    return docs.mapInArrow(run, schema).where("n > 0")


def _searched(
    vectors: DataFrame, weights: list[int], queries: list[list[int]], rows: int, total: int, k: int, leaf: int
) -> DataFrame:
    """query (its number), key and score of the best k rows of each query in each task."""
    held = vectors.sparkSession.sparkContext.broadcast((weights, queries))
    schema = StructType(
        [StructField("query", IntegerType()), StructField("key", vectors.schema["key"].dataType), StructField("score", LongType())]
    )
    damping = F.expr(f"{100 - LENGTH_PERCENT} + cast((cast(n as decimal(20, 0)) * {LENGTH_PERCENT * rows}) div {total} as long)")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.asarray(held.value[0], dtype=np.int64)
        own = [np.asarray(terms, dtype=np.int64) for terms in held.value[1]]
        search = Search(own, len(weight), k)
        rows_at_once = max(4 * leaf, CENTROID_CELLS * leaf // (4 * len(weight)))
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for begin, end in _slices(sizes, rows_at_once, CENTROID_CELLS):
                part = batch.slice(begin, end - begin)
                size = sizes[begin:end]
                terms = part.column(2).flatten().to_numpy().astype(np.int64)
                count = part.column(3).flatten().to_numpy().astype(np.int64)
                damp = np.repeat(part.column(1).to_numpy(), size)
                value = weight[terms] * (UNIT * count // (1000 * count + 8 * damp))
                some = np.flatnonzero(size)  # rows without any term of a query score nothing
                if len(some):
                    starts = np.concatenate(([0], np.cumsum(size[some])))
                    search.add(build(starts, terms, value, len(weight), leaf), part.column(0).take(pa.array(some)).to_pylist())
        found = [(query, row, score) for query, best in enumerate(search.best) for score, row in best]
        for at in range(0, len(found), 10_000):
            columns = zip(*found[at : at + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, (pa.int32(), part.schema.field(0).type, pa.int64()))],
                names=schema.names,
            )

    return vectors.select("key", damping.alias("m"), "terms", "counts").mapInArrow(run, schema)


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    query: str = "item_id",
    query_text: str = "text",
    block_terms: int = BLOCK_TERMS,
    block_queries: int = BLOCK_QUERIES,
    leaf: int = LEAF_ROWS,
) -> DataFrame:
    """query, rank (from 1), key and score of the best k rows of `docs` for every query: most score first, of equal
    scores the smaller key (null last). Rows that score nothing are left out.

    Terms are the longest stretches of letters, digits and characters beyond ASCII, with A-Z in lower case. With N rows
    that have terms, L terms in all, n in a row, df rows that hold a term and tf times in a row, a term
    weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a row scores the sum over the query's terms, each once,
    of w * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L.

    Queries are taken in blocks of at most about `block_terms` different terms and `block_queries` queries, which are
    sent to the tasks; the documents are read once a block and otherwise stay where they are. A task holds one tree at
    a time, of at most some thousand rows, and k rows a query.

    Rows of one query id are one query with all their terms; a null id is one like any other. Repeated rows of `docs`
    are rows of their own. Null and empty texts have no terms; queries without terms have no result. A very long text
    is counted by one task, at some 60 bytes a word. Empty tables give an empty result, and other columns are ignored.
    Stores the queries and a block's vectors when called.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("key"), terms_of(text).alias("words"))
    lower = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = queries.select(F.col(query).alias("query"), terms_of(query_text).alias("words"))
    each = asked.select("query", F.explode("words").alias("term")).select("query", lower.alias("term")).distinct()
    sized = stored(each.groupBy("query").agg(F.collect_list("term").alias("terms")), "lexical-queries")
    share = math.ceil(block_terms / block_queries)
    order = [F.asc_nulls_first("query")]
    running = running_totals(sized, order, {"size": F.size("terms") + share})
    before = F.col("size_running") - F.size("terms") - share
    blocks = stored(running.select("query", "terms", F.floor(before / block_terms).alias("block")), "lexical-blocks")
    kinds = StructType([sized.schema["query"], plain.schema["key"], StructField("score", LongType())])
    best = spark.createDataFrame([], kinds)
    for (block,) in blocks.select("block").distinct().orderBy("block").collect():
        own = blocks.where(F.col("block") == block).orderBy(*order).collect()
        vocabulary = sorted({term for row in own for term in row["terms"]})
        number = {term: at for at, term in enumerate(vocabulary)}
        vectors = stored(_vectors(plain, vocabulary), "lexical-vectors")
        rows, total = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not rows:
            break
        holding = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        rare = [(2 * rows + 2) / (2 * holding.get(at, 0) + 1) for at in range(len(vocabulary))]
        weights = [math.floor(1000 * math.log(ratio)) for ratio in rare]
        found = _searched(vectors, weights, [[number[term] for term in row["terms"]] for row in own], rows, total, k, leaf)
        numbered = [(at, row["query"]) for at, row in enumerate(own)]
        ids = spark.createDataFrame(numbered, StructType([StructField("at", IntegerType()), kinds[0]]))
        named = found.join(F.broadcast(ids), found["query"] == ids["at"]).select(ids["query"], "key", "score")
        best = best.unionByName(named)
    within = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = best.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query), "rank", F.col("key").alias(key), "score")

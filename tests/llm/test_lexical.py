"""Ball-tree search against scoring every document by definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from panelmill.llm import lexical, queries
from tests.llm.conftest import rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [term.translate(LOWER) for term in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    """docs, items: (id, text) rows."""
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(term for _, c in counts for term in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for key, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in own if t in c
            )
            if score > 0:
                scored.append((score, key))
        scored.sort(key=lambda pair: (-pair[0], pair[1] is None, pair[1]))
        out += [(item, rank, key, score) for rank, (score, key) in enumerate(scored[:k], start=1)]
    return sorted(out, key=repr)


def prose(rng, words, size):
    return " ".join(rng.choice(words) for _ in range(size))


def corpus(seed):
    rng = random.Random(seed)
    groups = [[f"{g}w{i}" for i in range(30)] for g in "abc"]
    docs = [(i, prose(rng, rng.choice(groups), rng.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i % 3, docs[7][1]) for i in range(200)]  # a third are copies, under three ids
    docs += [(None, docs[9][1]), (None, None), (5000, ""), (5001, "!? -"), (5002, "Aw1 AW1 éw É ß 1 \x00 aw1"), (5003, "x " * 5000)]
    items = [(i, prose(rng, rng.choice(groups), rng.randint(1, 12))) for i in range(30)]
    items += [(3, "bw1 bw2"), (None, "cw3 É"), (100, None), (101, "--"), (102, "nowhere"), (103, "AW1 X éw"), (104, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_ranking_in_blocks(spark, seed):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*row, 1, "k") for row in docs], "doc_id long, text string, score int, key string").repartition(3)
    asked = spark.createDataFrame([(*row, 1) for row in items], "item_id long, text string, query int")
    expected = plain_search(docs, items)
    for options in ({}, {"block_terms": 40, "block_queries": 5, "leaf": 4}, {"leaf": 1}):
        out = lexical.ranked_search(df, asked, **options)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert rows_of(out, "item_id", "rank", "doc_id", "score") == expected
    assert lexical.ranked_search(df.limit(0), asked).count() == 0
    assert lexical.ranked_search(df, asked.limit(0)).count() == 0


def test_trees_keep_every_row_and_bound_every_score():
    rng = np.random.default_rng(3)
    rows, width = 900, 50
    sizes = rng.integers(1, 9, rows)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    columns = np.concatenate([np.sort(rng.choice(width, size, replace=False)) for size in sizes])
    values = rng.integers(1, 10**10, len(columns))
    values[starts[100] : starts[400]] = 10**10  # many nearly equal rows
    tree = lexical.build(starts, columns, values, width, leaf=8, groups=7)
    group = np.empty(width, dtype=int)
    group[tree.by_group] = np.repeat(np.arange(7), np.diff(tree.edges))
    assert sorted(tree.order.tolist()) == list(range(rows))
    dense = np.zeros((rows, width), dtype=object)
    for row in range(rows):
        at = slice(tree.starts[row], tree.starts[row + 1])
        dense[row, tree.terms[at]] = [int(v) for v in tree.values[at]]

    def below(node):
        pair = tree.children[node]
        return list(range(*tree.rows[node])) if pair is None else below(pair[0]) + below(pair[1])

    for node in range(len(tree.children)):
        held = below(node)
        for chosen in (rng.choice(width, 5, replace=False), rng.choice(width, 30, replace=False)):
            most = max(int(dense[row, chosen].sum()) for row in held)
            norms = np.sqrt(np.bincount(group[chosen], minlength=7))
            assert (tree.centroids[node, chosen].sum() + tree.radii[node] @ norms) * (1 + 1e-9) >= most


def test_groups_are_pruned():
    """Documents of other groups than the query's are not scored."""
    rng = random.Random(8)
    width, rows, columns = 80, 2000, []
    for row in range(rows):
        columns.append(sorted(rng.sample(range(20 * (row % 4), 20 * (row % 4) + 20), 3)))
    starts = np.arange(0, 3 * rows + 1, 3)
    flat = np.array(columns).reshape(-1)
    tree = lexical.build(starts, flat, np.full(len(flat), 10**6), width, leaf=16)
    search = lexical.Search([np.array([1, 2, 3]), np.array([41, 45, 59])], width, 5)
    search.add(tree, list(range(rows)))
    assert search.leaves_seen < 0.3 * search.leaves
    for own, best in zip(([1, 2, 3], [41, 45, 59]), search.best):
        plain = sorted((-(10**6) * len(set(own) & set(c)), row) for row, c in enumerate(columns))[:5]
        assert [(-s, row) for s, row in plain] == best


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = connection.execute(queries.ORACLES["op13_ball_tree_search"]).fetchall()
    out = queries.QUERIES["op13_ball_tree_search"](spark, folder)
    got = rows_of(out, "item_id", "rank", "doc_id", "score")
    assert got == sorted(found, key=repr)
    docs, items = ([tuple(r) for r in queries.table(spark, folder, n).select(i, "text").collect()] for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == plain_search(docs, items)

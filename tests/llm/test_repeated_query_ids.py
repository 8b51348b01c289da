from __future__ import annotations

import numpy as np
import pytest

from panelmill.llm import voronoi
from tests.llm.conftest import rows_of


def joined(vectors, queries, k):
    """The k best pairs of each query id, as a join and a rank over it give them."""
    out = []
    for query in {key for key, _ in queries}:
        pairs = sorted((-sum(a * b for a, b in zip(q, v)), key) for own, q in queries if own == query for key, v in vectors if key != query)[:k]
        out += [(query, rank, key, -score) for rank, (score, key) in enumerate(pairs, 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 6])
def test_own_rows_take_no_places(spark, monkeypatch, pivots):
    monkeypatch.setattr(voronoi, "DATA_PER_PIVOT", 240 // pivots)
    monkeypatch.setattr(voronoi, "QUERIES_PER_PIVOT", 100 // pivots)
    draw = np.random.default_rng(3)
    point = lambda size: draw.integers(-size, size, 6).tolist()
    shared, long = [50] * 6, [90] * 6
    vectors = [(k, point(60)) for k in range(1, 120) if k % 50]
    vectors += [(50, shared)] * 8 + [(k, shared) for k in (51, 52, 100, 53, 54, 55, 7)] + [(56, shared)] * 7
    vectors += [(100, [80 + k, *long[1:]]) for k in range(40)] + [(103, [85, *long[1:]]), (99, [85, *long[1:]])]
    vectors += [(150, long)] * 9 + [(200, long), (200, long), (200, point(30)), (250, long)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = [(key, v) for key, v in vectors if key % 50 == 0]
    found = voronoi.top_k(frame(vectors), frame(queries), 5, repeats=True)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(joined(vectors, queries, 5), key=repr)
    single = sorted({(key, tuple(v)) for key, v in queries})
    found = voronoi.top_k(frame(vectors), frame(queries), 5)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(joined(vectors, single, 5), key=repr)

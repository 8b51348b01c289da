from __future__ import annotations

import random
from collections import defaultdict

import pytest

from panelmill.llm import sharding

DIMS = {"size": 1024, "tokens": 1, "rows": 1}
GROUP = ["text_hash", "text_crc32", "size"]


@pytest.mark.parametrize("slice_rows", [500, 150])
def test_groups_below_a_quarter_of_a_shard_stay_whole(documents, monkeypatch, slice_rows):
    """Groups far beyond a slice's share are whole, one of a third of all rows is parted, and all dimensions are level."""
    chance = random.Random(12)
    prose = lambda n: " ".join("x" * chance.randint(1, 9) for _ in range(n))
    texts = [f"a copied text {prose(20)}" for _ in range(30)] * 30
    texts += [prose(1500) for _ in range(4)] * 2 + ["the copy that is everywhere"] * 2500
    texts += [prose(int(chance.lognormvariate(4, 0.8))) for _ in range(4200)] + [None, ""]
    found = sharding.shard_rows(sharding.document_sizes(documents(texts)), "doc_id", GROUP, DIMS, slice_rows=slice_rows).collect()
    assert len(found) == len(texts) and len({r["doc_id"] for r in found}) == len(texts)
    places, totals = defaultdict(set), {name: sum(r[name] for r in found) for name in DIMS}
    groups = defaultdict(list)
    for r in found:
        groups[r["text_hash"]].append(r)
        places[r["text_hash"]].add(r["shard"])
    for key, held in groups.items():
        if all(sum(r[name] for r in held) * 64 <= totals[name] for name in DIMS):
            assert len(places[key]) == 1
    assert max(map(len, places.values())) > 4
    for shard in range(16):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    level = {name: max(sum(r[name] for r in found if r["shard"] == s) for s in range(16)) * 16 / totals[name] for name in DIMS}
    assert level["size"] < 1.02 and level["tokens"] < 1.05 and level["rows"] < 1.3


def test_equal_rows_are_parted(spark, documents):
    """A third of the table is one row, id included: every shard takes its share of it."""
    chance = random.Random(4)
    texts = [" ".join("x" * chance.randint(1, 9) for _ in range(30)) for _ in range(2000)]
    docs = documents(texts + ["the very same row " * 10] * 1000, ids=[*range(2000), *[7] * 1000])
    sizes = sharding.document_sizes(docs).selectExpr("*", "1 AS shard", "2 AS slot")
    found = sharding.shard_rows(sizes, "doc_id", GROUP, DIMS)
    assert found.columns == [*sizes.columns[:-2], "shard", "slot"]
    rows = found.collect()
    assert len(rows) == 3000
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(loads) * 16 < 1.02 * sum(loads) and min(loads) * 16 > 0.98 * sum(loads)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))

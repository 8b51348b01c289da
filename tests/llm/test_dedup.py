from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelmill.llm import components, jaccard, line_spread, substrings
from tests.llm.conftest import rows_of


def prose(chance, words, vocabulary=400):
    return " ".join(f"w{chance.randint(0, vocabulary)}" for _ in range(words))


def edited(chance, text, share):
    return " ".join("new" + str(chance.randint(0, 10**6)) if chance.random() < share else word for word in text.split())


# ---- repeated passages


def brute_repeats(texts, window):
    words = [(text or "").encode().split() for text in texts]
    seen = Counter(tuple(own[k : k + window]) for own in words for k in range(len(own) - window + 1))
    out = []
    for own in words:
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if seen[tuple(own[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(word for word, cut in zip(own, gone) if not cut)
        out.append((len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("often", [4096, 2])
def test_repeats_equal_brute_force(documents, monkeypatch, often):
    monkeypatch.setattr(substrings, "LONG_PREFIX_FROM", often)
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", 50)
    chance = random.Random(3)
    passage, base = prose(chance, 60), prose(chance, 200)
    texts = [
        None, "", " \t\n", "one two", passage, passage, prose(chance, 34), prose(chance, 35),
        *[f"{prose(chance, 30)} {passage[: 6 * k]} {prose(chance, 50)} {passage}\n{prose(chance, 10)}" for k in range(12)],
        *[edited(chance, base, 0.02) for _ in range(40)], "same " * 300, "a b " * 40, prose(chance, 3000, 3),
    ]
    ids = [None, *range(1, len(texts))]
    ids[5] = 4
    found = substrings.remove_repeats(documents(texts, ids=ids, extra=["r1", "words", "anchor"]))
    expected = sorted(((i, *row) for i, row in zip(ids, brute_repeats(texts, 35))), key=repr)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_repeats_of_nothing(documents):
    assert substrings.remove_repeats(documents(["a"]).limit(0)).count() == 0


def test_run_hashes_depend_on_the_run_alone():
    words = np.arange(200, dtype=np.uint64) % np.uint64(50)
    for length in (1, 2, 7, 12, 35):
        runs = substrings.run_hashes(words, length)
        assert len(runs) == 201 - length and np.array_equal(runs[:50], runs[50:100]) and len(set(runs[:50].tolist())) == 50


# ---- lines


def test_lines_on_many_sites_go(documents):
    texts = [f"Own line {k} of some length.\nFooter of all\n\nShared by few" if k < 9 else f"Own {k} text here and more.\nFooter of all" for k in range(14)]
    texts += [None, "", "Footer of all", "Rare\nFooter of all\nRare and long enough to stay here"]
    sources = [f"site{k}" for k in range(16)] + ["site0", None]
    docs = documents(texts, sources=sources, extra=["_key", "_cut", "n_removed", "c1"])
    found = {r["doc_id"]: r for r in line_spread.remove_boilerplate(docs, min_sites=10, report=True).collect()}
    assert found[0]["text"] == "Own line 0 of some length.\n\nShared by few" and found[0]["n_removed"] == 1
    assert found[12]["text"] == "Own 12 text here and more." and found[12]["_key"] == 7 and found[12]["c1"] == 7
    # a text that would lose more than half of itself keeps it; a null site still loses lines
    assert found[16]["text"] == "Footer of all" and found[16]["n_removed"] == 0
    assert found[17]["text"] == "Rare\nRare and long enough to stay here"
    assert found[14]["text"] is None and found[14]["n_lines"] == 0 and found[15]["text"] == ""
    # the line on nine sites is near the threshold and counted exactly
    assert line_spread.boilerplate_lines(docs, min_sites=10).count() == 1
    assert line_spread.boilerplate_lines(docs, min_sites=9).count() == 2
    assert line_spread.remove_boilerplate(docs.limit(0)).count() == 0


def test_lines_run_no_python(documents):
    plan = line_spread.remove_boilerplate(documents(["a\nb"] * 3))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_repeated_rows_lose_the_same_lines(documents):
    texts = [f"text number {k} with words\nfoot" for k in range(10)] * 2
    docs = documents(texts, ids=[*range(10), *range(9), None], sources=[f"s{k % 10}" for k in range(20)])
    assert {r["text"].endswith("foot") for r in line_spread.remove_boilerplate(docs).collect()} == {False}


# ---- near duplicates


def brute_components(texts, ids, words, part, whole):
    sets = []
    for text in texts:
        own = (text or "").encode().lower().split()
        sets.append({tuple(own[k : k + words]) for k in range(max(len(own) - words + 1, 1))} if own else set())
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and whole * common >= part * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k in range(len(sets)):
        least[root(k)] = min([x for x in (least.get(root(k)), ids[k]) if x is not None], default=None)
    return sorted(((ids[k], len(sets[k]), least[root(k)]) for k in range(len(sets))), key=repr)


@pytest.mark.parametrize("known, least", [(1 << 20, 16), (1 << 20, 2), (0, 16)])
def test_near_duplicates_equal_brute_force(documents, monkeypatch, known, least):
    monkeypatch.setattr(jaccard.common_shingles, "__defaults__", (known, least))
    chance = random.Random(8)
    passage = prose(chance, 40)
    texts = [None, "", "  ", "one", "One", "one two", "one two", prose(chance, 4)]
    for size in (12, 40, 150):
        base = prose(chance, size, 10**6)
        texts += [edited(chance, base, share) for share in (0, 0, 0.005, 0.01, 0.01, 0.02, 0.02, 0.03, 0.05)]
    texts += [edited(chance, prose(random.Random(1), 120, 10**6), 0.015) for _ in range(60)]
    texts += [f"{prose(chance, 60)} {passage}" for _ in range(20)]
    ids = [None, *range(500, 500 + len(texts) - 1)]
    ids[6] = ids[5]
    found = jaccard.near_duplicates(documents(texts, ids=ids, extra=["node", "bunch"]), words=4, similarity=(85, 100))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute_components(texts, ids, 4, 85, 100)


def test_one_of_each_class_stays(documents):
    chance = random.Random(4)
    base, other = prose(chance, 100, 10**6), prose(chance, 100, 10**6)
    texts = [base, base, edited(chance, base, 0.005), other, other, None, None, " ", " "]
    docs = documents(texts, ids=[3, 2, 9, 5, 5, 6, 6, 7, 7], extra=["_hash", "_k"])
    assert rows_of(jaccard.keep_one(docs), "doc_id", "_hash") == [(2, 7), (5, 7), (6, 7), (6, 7), (7, 7), (7, 7)]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (1, 5)]
    found = dict(rows_of(components.connected(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 1 for k in [5, *range(200, 260)])
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_common_shingles_are_counted_exactly(documents, monkeypatch):
    """Shingles of many texts, in several buckets and batches, against a plain count."""
    monkeypatch.setattr(jaccard, "_COUNTED_TOGETHER", 50)
    monkeypatch.setattr(jaccard, "_COUNTED_ROWS", 7)
    texts = [f"a b c d e f{k % 5} g{k % 3} " + "x y z u v w " * (k % 4) for k in range(200)] + [None, "", "one"]
    frame = documents(texts).selectExpr("cast(text as binary) AS _text")
    plain = Counter(int(one) for text in texts for one in jaccard.shingle_set((text or "").encode(), 3))
    keys, docs, buckets = jaccard.common_shingles(frame, 3, 1 << 20, 2)
    assert buckets > 1
    shift = buckets.bit_length() - 1
    want = Counter()
    for one, count in plain.items():
        want[(one >> 32 << shift) | (one & (buckets - 1))] += count
    assert dict(zip(keys.tolist(), docs.tolist())) == {one: count for one, count in want.items() if count >= 2}


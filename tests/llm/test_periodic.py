"""Periodic runs against a search by definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from panelmill.llm import queries
from panelmill.llm.periodic import periodic_runs, runs_of
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words, least=24, times=3):
    """For each period, the longest stretches that keep it, if it is their smallest."""
    found = []
    for q in range(1, len(words) // times + 1):
        begin = 0
        while begin + q < len(words):
            end = begin
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end + q - begin
            if end > begin and length >= max(least, times * q) and smallest_period(words[begin : begin + length]) == q:
                found.append((begin, length, q))
            begin = max(end, begin) + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def texts(seed, count):
    """Random words of a small alphabet with planted repetitions, some nested or overlapping."""
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            base = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3:
                base = (base * rng.randint(2, 4) + [rng.choice("abcd")])
            long = base * rng.randint(1, 9)
            words += long[: rng.randint(0, len(long))]
            words += [rng.choice("ab") for _ in range(rng.randint(0, 4))]
        yield words


@pytest.mark.parametrize("seed", range(6))
def test_every_run_and_no_other(seed):
    for least, times in ((24, 3), (3, 3), (5, 4)):
        for words in texts(seed, 60):
            code = {word: at for at, word in enumerate(sorted(set(words)))}
            found = runs_of(np.array([code[w] for w in words], dtype=np.int64), len(words), least, times)
            assert list(zip(*(part.tolist() for part in found))) == plain_runs(words, least, times), words


def test_all_short_words_over_two_letters():
    """Every text of up to 11 words of two kinds."""
    for size in range(12):
        for bits in range(1 << size):
            words = [bits >> i & 1 for i in range(size)]
            found = runs_of(np.array(words, dtype=np.int64), size, 3, 3)
            assert list(zip(*(part.tolist() for part in found))) == plain_runs(words, 3, 3)


def test_rows_nulls_ties_and_names(spark):
    lists = [*texts(9, 40), None, [], ["x"], ["a", None] * 20, ["w"] * 50, ["w"] * 50]
    rows = [(None if i == 3 else i % 7, words, f"r{i}", 5) for i, words in enumerate(lists)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>, runs string, _slice int")
    for slice_words in (10, 1000):
        out = periodic_runs(df, slice_words=slice_words)
        assert out.columns == ["doc_id", "_slice", "runs", "collapsed"]
        expected = []
        for key, words, _, extra in rows:
            words = words or []
            found = plain_runs(words)
            text = plain_collapsed(words, found) if None not in words else "a"
            expected.append((key, extra, found, text))
        got = [(r["doc_id"], r["_slice"], [tuple(run) for run in r["runs"]], r["collapsed"]) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, times=2)


def test_one_very_long_text(spark):
    """200,000 words: a repetition inside another, each found once."""
    words = [f"w{i}" for i in range(70_000)] + ["p", "q", "r"] * 30_000 + [f"v{i}" for i in range(4_000)] * 10
    df = spark.createDataFrame([(1, words)], "doc_id long, words array<string>")
    row = periodic_runs(df).first()
    assert [tuple(run) for run in row["runs"]] == [(70_000, 90_000, 3), (160_000, 40_000, 4_000)]
    assert len(row["collapsed"].split(" ")) == 70_000 + 3 + 4_000


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    collapsed = hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, digest, collapsed)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_on_odd_rows(spark, documents, tmp_path):
    odd = [None, "", "  \t\n ", "a", "x y z", "a\x0bb a\x0cb " * 30, "é " * 100, "one two three " * 9, "Q\x1cq " * 40]
    bodies = odd + [" ".join(words) for words in texts(4, 60)]
    ids = [None, *range(-3, len(bodies) - 4)]
    documents(bodies + bodies[:5], ids + ids[:5], extra=["words", "runs"]).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    expected = [plain_row(i, text) for i, text in zip(ids + ids[:5], bodies + bodies[:5])]
    assert rows_of(out, *COLUMNS) == sorted(expected, key=repr)
    assert sum(row[1] for row in expected) > 20


def test_query_on_the_table(spark):
    """All rows; those of fewer than 3,000 words against the search by definition."""
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents").select("doc_id", "text").collect()
    got = {row[0]: row for row in rows_of(queries.QUERIES["op12_periodic_runs"](spark, folder), *COLUMNS)}
    assert len(got) == len(docs)
    for row in docs:
        if len(WORD.findall(row["text"])) < 3_000:
            assert got[row["doc_id"]] == plain_row(row["doc_id"], row["text"])

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelmill.llm import bpe, packing
from panelmill.llm.queries import tokenizer_file
from panelmill.llm.segments import segments
from panelmill.llm.token_counts import count_tokens
from tests.llm.conftest import rows_of

ODD = [
    "", None, " ", "a", " a", "a  b", "a \n b\n", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>z. q", "don't it's I'll",
    "\x1c a\x1db \x85 c", "é ≠ ́x", "ΑΣ ΑΣ. Σ'σ", "日本語 テキスト。", "😀 a😀b!", "İstanbul'S İ!!", "½ ²3 x2.y", "...'s 'S ' s",
    "a" * 3000, "a b " * 2000, "tab\tx\t\ty", "\r\n a \r\n", "a_b-c!? ((x)) <|x|>", "가각가", "<|startoftext|>hi.", "É. ÀÇ! ñ--",
]


def mixtures(count):
    chance = random.Random(5)
    parts = ["a", "B", "é", " ", "  ", "\n", "'", "s", ".", "!!", "<|endoftext|>", "1", "½", "́", "\x1d", "日", "Σ", "\t", "=", "̸", "İ"]
    return ["".join(chance.choice(parts) for _ in range(chance.randint(1, 30))) for _ in range(count)]


def test_counts_are_those_of_the_library(monkeypatch):
    path = tokenizer_file("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ODD + mixtures(1500)
    expected = [len(library.encode(text or "", add_special_tokens=False).ids) for text in texts]
    assert bpe.ByteLevelCounts(path).count(texts, len(texts)).tolist() == expected
    # with short slices and a memo that is emptied all the time
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "MEMO_UNITS", 5)
    monkeypatch.setattr(bpe, "MEMO_PARTS", 5)
    assert bpe.ByteLevelCounts(path).count(texts, len(texts)).tolist() == expected


def test_ids_are_those_of_the_library(monkeypatch):
    path = tokenizer_file("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), ODD + mixtures(1500)
    expected = [np.asarray(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert list(bpe.WordEndIds(path).encode(texts)) == expected
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "MEMO_UNITS", 5)
    assert list(bpe.WordEndIds(path).encode(texts)) == expected


def test_segments_give_the_text_back():
    text = "ab  cd e\n f " * 50
    found = list(segments(text, 20))
    assert len(found) > 5 and "".join(found) == text and all(one[0] == " " and one[1] != " " for one in found[1:])
    assert list(segments("x" * 100, 20)) == ["x" * 100]


def test_token_counts_of_odd_rows(documents):
    docs = documents([None, "", "a b", "a b"], ids=[None, 1, 2, 2], extra=["n_tokens", "n_bytes"])
    found = count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens") == [(1, 0, 0), (2, 3, 2), (2, 3, 2), (None, 0, 0)]
    assert count_tokens(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed, count", [(1, 3), (2, 400), (3, 5000)])
def test_a_plan_holds_every_piece_once(seed, count):
    lengths = np.clip(np.random.default_rng(seed).lognormal(6.3, 1.1, count).astype(int), 1, 4096)
    plan = packing.plan_sequences(dict(Counter(lengths.tolist())))
    held = Counter()
    for one in plan:
        assert sum(one.lengths) <= 4096
        for length in one.lengths:
            held[length] += one.count
    assert held == Counter(lengths.tolist())
    least = -(-int(lengths.sum()) // 4096)
    assert sum(one.count for one in plan) <= least * 1.01 + 1


def test_one_length_and_none():
    assert sum(one.count for one in packing.plan_sequences({1500: 100001}, 4096)) == 50001
    assert packing.plan_sequences({4096: 3}) == [packing.Configuration(3, (4096,))]
    assert packing.plan_sequences({}) == []


def test_packing_round_trip(documents):
    """Every id of every text is found again at its place, and sequences have no gaps."""
    texts = [None, "", "a b c", "a b c", "word " * 9000, "Ünïcode! x", *[f"some words {k} " * (k % 40 + 1) for k in range(300)]]
    docs = documents(texts, ids=[None, 1, 2, 2, *range(3, len(texts) - 1)])
    path = tokenizer_file("word_bpe_49k.json")
    found = packing.pack(packing.tokenised_pieces(docs, path), slice_rows=50).collect()
    library = Tokenizer.from_file(path)
    expected = Counter()
    for row in docs.collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected[row["doc_id"], piece, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    places = defaultdict(list)
    for row in found:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= -(-sum(row["length"] for row in found) // 4096) + 1


def test_packing_nothing_and_clashing_names(spark, documents):
    path = tokenizer_file("word_bpe_49k.json")
    assert packing.pack(packing.tokenised_pieces(documents(["a"]).limit(0), path)).count() == 0
    pieces = spark.createDataFrame([(5, 1, 2, 3), (5, 1, 2, 3)], "length long, _rank int, _slice int, c0 int")
    assert rows_of(packing.pack(pieces, 16), "_rank", "_slice", "c0", "offset") == [(1, 2, 3, 0), (1, 2, 3, 5)]
    named = spark.createDataFrame([(5, 1, 2)], "length long, offset int, sequence_id string")
    assert packing.pack(named, 16).columns == ["length", "sequence_id", "offset"]
    assert rows_of(packing.pack(named, 16), "length", "offset") == [(5, 0)]


def _lengths(values):
    return dict(Counter(np.clip(values.astype(int), 1, 4095).tolist()))


def test_sequences_come_from_configurations():
    """Short and long texts mixed: the covering program makes nearly all sequences and reaches the lower bound."""
    histogram = _lengths(np.exp(np.random.default_rng(1).normal(5.4, 1, 50_000)))
    covered, left = packing.covering_configurations(histogram, 4096)
    plan = packing.plan_sequences(histogram, 4096)
    total = sum(one.count for one in plan)
    assert sum(one.count for one in covered) >= 0.9 * total
    assert total == -(-sum(length * count for length, count in histogram.items()) // 4096)
    held = Counter(left)
    for one in covered:
        assert sum(one.lengths) <= 4096
        for length in one.lengths:
            held[length] += one.count
    assert held == histogram


def test_configurations_beat_best_fit_where_pieces_are_hard_to_combine():
    histogram = _lengths(np.random.default_rng(2).integers(900, 2500, 50_000))
    total = sum(one.count for one in packing.plan_sequences(histogram, 4096))
    assert total < sum(one.count for one in packing._best_fit(histogram, 4096))


def test_plan_is_never_above_best_fit():
    for seed in range(5):
        histogram = _lengths(np.random.default_rng(seed).integers(1, 4000, 150))
        plan = packing.plan_sequences(histogram, 4096)
        held = Counter()
        for one in plan:
            for length in one.lengths:
                held[length] += one.count
        assert held == histogram
        assert sum(one.count for one in plan) <= sum(one.count for one in packing._best_fit(histogram, 4096))


def test_words_of_plain_texts_are_those_of_the_library():
    """Every character of the plain range between letters, digits, marks and apostrophes, and upper case that leaves it."""
    path = tokenizer_file("word_bpe_49k.json")
    texts = [f"{chr(c)}{d}a {chr(c)}'S{chr(c)}" for c in range(1, 0x260) for d in "'a 1!\u00c9\u023a"]
    texts += ["<|ENDOFTEXT|> a<|b", "I'LL'd ''ve", "\u00bd\u00b212 \u00aa\u00b5\u00df", None, "", "word " * 50_000]
    library = bpe._load(path)
    for text, raw in zip(texts, bpe.word_end(path).encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text[:40]

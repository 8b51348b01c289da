"""Tree encoding against the library on whole texts."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from panelmill.llm import queries
from panelmill.llm.tree_bpe import TreeEncoder, decode_ids, encode_texts
from tests.llm.conftest import rows_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


FIXED = [
    "", " ", "\n", "a", "a" * 5000, "ab" * 3000, "é" * 3000, "你好世界" * 700, "!" * 3000, "'s" * 900, "it's we'll they'RE " * 90,
    " " * 4000, " \n" * 2000, "   x" * 500, "9" * 3000, "1a2b3c" * 500, "a'" * 900, "'" * 999 + "s" * 999,
    "don" + "'t" * 500, "\x1c\x1d x\x1c" * 400, "𝒳𝓎" * 900, "🙂🙂 " * 600, "̀á" * 800, "tab\t\ttab\r\n" * 300,
    "<|endoftext|>" * 300, "the quick brown fox " * 300, "supercalifragilistic" * 400, "ſ'ſ" * 300, "Ᲊᲊ" * 500,
]


def odd_texts(seed, count):
    rng = random.Random(seed)
    alphabet = ["a", "b", "th", "ing", " ", "  ", "\n", "'s", "'", "ll", "é", "你", "9", ",", "!", "\t", " ", "🙂", "The", "ñ"]
    for _ in range(count):
        some = rng.sample(alphabet, rng.randint(1, 6))
        yield "".join(rng.choice(some) for _ in range(rng.randint(0, 400)))


@pytest.mark.parametrize("leaf", [1, 2, 7, 50, 700])
def test_ids_and_bytes_of_the_library(library, leaf):
    own = TreeEncoder(RANKS, PATTERN, leaf)
    for text in [*FIXED, *odd_texts(leaf, 400)]:
        if leaf < 7 and len(text) > 1500:
            text = text[:1500]
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text[:60]
        assert own.decode(ids) == text.encode()


def test_joins_touch_the_boundary_only(library):
    """In prose and inside one endless word, only a few characters or tokens beside a boundary are encoded again."""
    own = TreeEncoder(RANKS, PATTERN, 1 << 12)
    asked = []
    whole, merged = own._whole, own._merged
    own._whole = lambda text: asked.append(len(text)) or whole(text)
    own._merged = lambda ids: asked.append(len(ids)) or merged(ids)
    rng = random.Random(5)
    for text in ("some words in a row, " * 20_000, "".join(rng.choice("etaoinshr") for _ in range(400_000))):
        asked.clear()
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert sum(asked) < 1.05 * len(text)


def test_rows_in_parts(spark, library):
    """Long texts go through several rounds; null, repeated and clashing columns change nothing."""
    bodies = [None, *FIXED, *odd_texts(3, 60)]
    rows = [(None if i == 2 else i % 20, body, i, "x") for i, body in enumerate(bodies + bodies[5:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, part string")
    expected = sorted(((row[0], library.encode_ordinary(row[1] or "")) for row in rows), key=repr)
    for part_chars in (90, 1 << 20):
        out = encode_texts(df, RANKS, PATTERN, leaf_chars=40, part_chars=part_chars)
        assert out.columns == ["doc_id", "ids"]
        assert rows_of(out, "doc_id", "ids") == expected
    decoded = decode_ids(encode_texts(df, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted((bytes(r["decoded"]) for r in decoded.collect())) == sorted((row[1] or "").encode() for row in rows)
    assert encode_texts(df.limit(0), RANKS, PATTERN).count() == 0


def test_one_very_long_text(library):
    text = " ".join(str(i) for i in range(1_500_000))
    own = TreeEncoder(RANKS, PATTERN)
    ids = own.encode(text)
    assert np.array_equal(ids, library.encode_ordinary(text)) and own.decode(ids) == text.encode()


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    expected = []
    for row in queries.table(spark, folder, "documents").select("doc_id", "text").collect():
        ids = library.encode_ordinary(row["text"] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (row["text"] or "").encode())]
        expected.append((row["doc_id"], len(ids), *digests))
    out = queries.QUERIES["op11_tree_bpe"](spark, folder)
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)

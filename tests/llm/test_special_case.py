from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from panelmill.llm import bpe
from panelmill.llm.queries import tokenizer_file


def test_special_strings_in_other_case_are_text():
    path = tokenizer_file("word_bpe_49k.json")
    library, chance = Tokenizer.from_file(path), random.Random(7)
    marks = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|StartOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>"]
    texts = [*marks, *[f"Some{mark}. {mark}!Word x{mark}{mark.upper()} é{mark}" for mark in marks]]
    parts = [*marks, "A", "b", " ", ".", "\n", "é", "'S", "<|"]
    texts += ["".join(chance.choice(parts) for _ in range(chance.randint(1, 12))) for _ in range(500)]
    expected = [np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert list(bpe.WordEndIds(path).encode(texts)) == expected
    counts = bpe.ByteLevelCounts(tokenizer_file("byte_bpe_50k.json")).count(texts, len(texts)).tolist()
    other = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    assert counts == [len(other.encode(text, add_special_tokens=False).ids) for text in texts]

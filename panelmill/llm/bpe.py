"""Public tokenizers inside tasks: each distinct unit of text is encoded once per worker, in batches.

A unit is a stretch of text between boundaries that no token can cross, so a text's tokens are those of its units
in order. Both classes keep a bounded memo of units and hand unknown ones to the library in batches balanced by
bytes. Units that are one plain word are joined into longer strings first, because the library's cost per call
exceeds its cost per word; where each word's tokens begin or end can be read from the token ids.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

from panelmill.llm.segments import SAFE_SPACE, balanced

MEMO_UNITS = 300_000
MEMO_PARTS = 1_000_000
MEMO_WORDS = 400_000
SLICE_CHARS = 1 << 20
_JOIN_CHARS = 1 << 13
#: ASCII marks that never form one token with a letter before them (an apostrophe and the parts of special strings may)
_TAIL = "".join(c for c in string.punctuation if c not in "'<|>")
_ODD_WHITE = re.compile(r"[^\S \n]")
_SPACE_OR_LINE = re.compile(r"[ \n]+")


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _words_as_bytes():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])


#: letters that stay one letter in lower case
_LATIN = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
_WORD = re.compile("[" + "".join(sorted(_LATIN)) + "]+").fullmatch
#: text whose lower case is that of its characters one by one, and composed already
_SIMPLE_CASE = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch
#: text of such characters with plain white space only
_PLAIN = re.compile("[\t\n\r -\x7e\xa1-\u012f\u0131-\u024f]*").fullmatch


def _class_of(kind: str) -> str:
    """The characters of the plain range, in lower case, whose Unicode category begins with `kind`, for a pattern."""
    found = {low for c in map(chr, range(0x250)) for low in c.lower() if unicodedata.category(low).startswith(kind)}
    return re.escape("".join(sorted(found)))


#: the words of a plain text in lower case, as the vocabulary parts them
_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^\\s{0}{1}]+".format(_class_of("L"), _class_of("N"))
).findall


def _core_and_tail(unit: str) -> tuple[str, str]:
    """A word and the marks after it, if a token boundary certainly lies between them."""
    core = unit.rstrip(_TAIL)
    return (core, unit[len(core) :]) if core and len(core) < len(unit) and core[-1] in _LATIN else (unit, "")


class Memo:
    """Values by text in two generations: when the younger one is full it becomes the older, and what is asked for again
    moves back. Rare texts are forgotten, frequent ones are not."""

    def __init__(self, limit: int) -> None:
        self._limit = limit
        self.young: dict = {}
        self._old: dict = {}

    def unknown(self, texts: set[str]) -> set[str]:
        """Those of the texts without a value; the others are in `young` from here on, until the next call."""
        if len(self.young) > self._limit:
            self._old, self.young = self.young, {}
        new = texts.difference(self.young)
        if self._old:
            back = [text for text in new if text in self._old]
            self.young.update((text, self._old[text]) for text in back)
            new.difference_update(back)
        return new


def _odd_spaces(text: str) -> bool:
    """Whether some space may have white space beside it, or the text begins or ends with any."""
    return (
        "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace()
        or _ODD_WHITE.search(text) is not None
    )


def _joined(units: Iterable[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for unit in units:
        held.append(unit)
        size += len(unit)
        if size >= _JOIN_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_bytes(texts: list[str]) -> Iterator[list[str]]:
    """Batches for the library of about SLICE_CHARS characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS // 4:
            yield held
            held, size = [], 0
    if held:
        yield held


class ByteLevelCounts:
    """Token counts under a byte-level vocabulary without a normaliser."""

    def __init__(self, path: str) -> None:
        self._tokenizer = _load(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self._starts[number] = token.startswith("Ġ")
        self._units, self._cores, self._bare = Memo(MEMO_UNITS), Memo(MEMO_PARTS), Memo(MEMO_UNITS)

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for batch in _by_bytes(texts):
            for encoding in self._tokenizer.encode_batch(batch, add_special_tokens=False):
                yield encoding.ids

    def _learn_bare(self, units: set[str]) -> None:
        todo = list(self._bare.unknown(units))
        self._bare.young.update(zip(todo, map(len, self._encode(todo))))

    def _learn_after_space(self, units: set[str], odd: bool) -> None:
        """Token counts of each unit with one space before it; odd: some unit may have white space at an end."""
        split = [(unit, *_core_and_tail(unit)) for unit in self._units.unknown(units)]
        self._learn_bare({tail for _, _, tail in split if tail})
        cores = list(self._cores.unknown({core for _, core, _ in split}))
        known, of_core = self._units.young, self._cores.young
        groups = list(_joined(cores if not odd else (core for core in cores if not _odd_spaces(core) and " " not in core)))
        for group, ids in zip(groups, self._encode([" " + " ".join(group) for group in groups])):
            starts = np.flatnonzero(self._starts[np.asarray(ids)])
            if len(starts) == len(group) and starts[0] == 0:
                of_core.update(zip(group, np.diff(starts, append=len(ids)).tolist()))
        rest = [core for core in cores if core not in of_core]
        of_core.update(zip(rest, map(len, self._encode([" " + core for core in rest]))))
        for unit, core, tail in split:
            known[unit] = of_core[core] + (self._bare.young[tail] if tail else 0)

    def count(self, texts: Iterable[str | None], rows: int) -> np.ndarray:
        totals = np.zeros(rows, dtype=np.int64)
        for held in balanced(texts, SLICE_CHARS):
            parted, any_odd = [], False
            for row, first, segment in held:
                body = segment if first else segment[1:]
                odd = _odd_spaces(body)
                any_odd |= odd
                parts = SAFE_SPACE.split(body) if odd else body.split(" ")
                parted.append((row, first, parts))
            bare = {parts[0] for _, first, parts in parted if first}
            self._learn_after_space(set().union(*(parts[1:] if first else parts for _, first, parts in parted)), any_odd)
            self._learn_bare(bare)
            for row, first, parts in parted:
                spaced = parts[1:] if first else parts
                totals[row] += sum(map(self._units.young.__getitem__, spaced)) + (self._bare.young[parts[0]] if first else 0)
        return totals


class WordEndIds:
    """Token ids under a vocabulary that drops white space and marks the ends of words."""

    def __init__(self, path: str) -> None:
        self._tokenizer = _load(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self._ends[number] = token.endswith("</w>")
        # these are looked for in the raw text, so lower case must not bring one about
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._special_begin = {text[0] for text in self._special}
        if any("<|" not in text for text in self._special):
            raise ValueError("special strings without <| are not looked for")
        # for words that are parted and in lower case already
        self._words_only = _load(path)
        self._words_only.normalizer = None
        self._words_only.pre_tokenizer = _words_as_bytes()
        self._words, self._units, self._parts = Memo(MEMO_WORDS), Memo(MEMO_UNITS), Memo(MEMO_UNITS)

    def _folded(self, core: str) -> str:
        """The core in lower case, if it has the same ids then."""
        if not core.isascii():
            return core
        low = core.lower()
        if self._special_begin.isdisjoint(core):
            return low
        return core if any(one in low for one in self._special) else low

    def _plain_words(self, text: str) -> list[str] | None:
        """The words of a text in which neither special strings nor odd characters need care."""
        return None if "<|" in text or not _PLAIN(text) else _WORDS(text.lower())

    def _encode(self, texts: list[str], tokenizer=None) -> Iterator[np.ndarray]:
        for batch in _by_bytes(texts):
            for encoding in (tokenizer or self._tokenizer).encode_batch(batch, add_special_tokens=False):
                yield np.asarray(encoding.ids, dtype="<u4")

    def _learn_words(self, words: set[str]) -> None:
        groups = list(_joined(self._words.unknown(words)))
        known = self._words.young
        for group, ids in zip(groups, self._encode([" ".join(group) for group in groups], self._words_only)):
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(group):
                raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                known.update((word, raw[a:b]) for word, a, b in zip(group, bounds, bounds[1:]))
            else:
                known.update(zip(group, (one.tobytes() for one in self._encode(group, self._words_only))))

    def _learn(self, units: set[str]) -> None:
        split = []
        for unit in self._units.unknown(units):
            core, tail = _core_and_tail(unit)
            split.append((unit, self._folded(core), tail))
        parts = self._parts.unknown({core for _, core, _ in split}.union(tail for _, _, tail in split))
        known, of_part = self._units.young, self._parts.young
        of_part[""] = b""
        parts.discard("")
        groups = list(_joined(part for part in parts if _WORD(part)))
        for group, ids in zip(groups, self._encode([" ".join(group) for group in groups])):
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(group):
                raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                of_part.update((part, raw[a:b]) for part, a, b in zip(group, bounds, bounds[1:]))
        rest = [part for part in parts if part not in of_part]
        of_part.update(zip(rest, (ids.tobytes() for ids in self._encode(rest))))
        for unit, core, tail in split:
            known[unit] = of_part[core] + of_part[tail] if tail else of_part[core]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers, in order; empty for null and empty texts."""
        done, pending = 0, []
        for held in balanced(texts, SLICE_CHARS):
            parted = []
            for row, _, segment in held:
                words = self._plain_words(segment)
                if words is not None:
                    parted.append((row, True, words))
                else:
                    odd = _ODD_WHITE.search(segment)
                    parted.append((row, False, _SPACE_OR_LINE.split(segment) if odd else segment.split()))
            self._learn_words(set().union(*(parts for _, plain, parts in parted if plain)))
            self._learn(set().union(*(parts for _, plain, parts in parted if not plain)))
            of_plain, of_unit = self._words.young.__getitem__, self._units.young.__getitem__
            for row, plain, parts in parted:
                while done < row:
                    yield b"".join(pending)
                    done, pending = done + 1, []
                pending.append(b"".join(map(of_plain if plain else of_unit, parts)))
        while done < len(texts):
            yield b"".join(pending)
            done, pending = done + 1, []


@cache
def byte_level(path: str) -> ByteLevelCounts:
    """One per worker process, so that the memo serves all its tasks."""
    return ByteLevelCounts(path)


@cache
def word_end(path: str) -> WordEndIds:
    return WordEndIds(path)

"""Cutting long texts at boundaries that no token crosses, and grouping the cuts by size."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, limit: int) -> Iterator[str]:
    """The text in pieces of about `limit` characters; each but the first starts with its safe single space."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE_SPACE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def balanced(texts: Iterable[str | None], limit: int) -> Iterator[list[tuple[int, bool, str]]]:
    """Lists of (row, starts the row, segment) of about `limit` characters each; null texts give no segment."""
    held: list[tuple[int, bool, str]] = []
    size = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for k, segment in enumerate(segments(text, limit)):
            held.append((row, k == 0, segment))
            size += len(segment)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held

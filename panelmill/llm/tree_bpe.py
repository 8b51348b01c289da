"""Byte-level BPE by monoid tree reduction: a text is encoded in halves, and neighbours are joined at their boundary.

What lets tokens of two halves stand side by side:

* Cut points. A place between a character that is no white space and a blank or line break, or between a letter and
  a mark or digit, lies between two matches of the splitting pattern wherever matching began. A window from such a
  place left of the boundary to one right of it is encoded anew; everything outside it stays.
* Stable pairs. Inside one long stretch of a single kind (letters, say) there is no cut point. There the merges decide:
  merging picks the lowest rank, leftmost first, so no merge ever crosses between two tokens of which the pair alone is
  encoded as these two tokens, and tokens whose neighbours are all such pairs are the encoding of the whole. A window of
  tokens is encoded anew and grows until it forms such pairs with the tokens on both sides.

Both windows grow fourfold until one of them is enough; at last a window is the whole of both halves. Decoding
concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from panelmill.llm.storage import stored

#: characters that one call of the library encodes
LEAF_CHARS = 1 << 13
#: characters of a text that one task encodes; longer texts are encoded by several and joined in rounds
PART_CHARS = 1 << 20
_BLANK = " \n\r\t"
_FIRST_REACH = 64


@cache
def _kind(c: str) -> str:
    """L: a letter in every version of Unicode in use; M: certainly no letter, no digit; N: digit; S: white space that
    ends a match; an empty text for what a rule for its own or an unsure class excludes."""
    if c in _BLANK:
        return "S"
    if c.isspace() or c == "'":
        return ""
    category = unicodedata.ucd_3_2_0.category(c)
    if category[0] == "L":
        return "L"
    if category == "Nd":
        return "N"
    return "M" if category[0] in "PS" else ""


def _is_cut(before: str, after: str) -> bool:
    """Whether two neighbouring characters always belong to different matches."""
    kind = _kind(after)
    if kind == "S":
        return not before.isspace()
    return kind in ("M", "N") and _kind(before) == "L"


class TreeEncoder:
    """Encodes and decodes with the ranks of a file, each match of the pattern separately."""

    def __init__(self, ranks_file: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> None:
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self._sizes[rank] = len(token)
        self._leaf = max(1, leaf_chars)

    def encode(self, text: str) -> np.ndarray:
        return self._node(text, 0, len(text))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self._leaf:
            return self._library.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self._library.encode_ordinary(text), dtype=np.int32)

    def _node(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self._leaf:
            return self._whole(text[start:end])
        middle = (start + end) // 2
        left, right = self._node(text, start, middle), self._node(text, middle, end)
        return self.join(text[start:middle], left, text[middle:end], right)

    def join(self, left_text: str, left: np.ndarray, right_text: str, right: np.ndarray) -> np.ndarray:
        """The ids of both texts together, given those of each."""
        reach = _FIRST_REACH
        while left_text and right_text:
            begin, end = self._cut_before(left_text, reach), self._cut_after(right_text, reach)
            if begin is not None and end is not None:
                window = self._whole(left_text[begin:] + right_text[:end])
                kept = self._count_back(left, len(left_text[begin:].encode()))
                skipped = self._count(right, len(right_text[:end].encode()))
                return np.concatenate((left[:kept], window, right[skipped:]))
            joined = self._join_inside(left_text, left, right_text, right, reach)
            if joined is not None:
                return joined
            reach *= 4
        return np.concatenate((left, right))

    @staticmethod
    def _cut_before(text: str, reach: int) -> int | None:
        """The last cut point of the text among its last `reach` characters; its start if it has no more."""
        least = max(1, len(text) - reach)
        for at in range(len(text) - 1, least - 1, -1):
            if _is_cut(text[at - 1], text[at]):
                return at
        return 0 if len(text) <= reach else None

    @staticmethod
    def _cut_after(text: str, reach: int) -> int | None:
        for at in range(1, min(len(text), reach)):
            if _is_cut(text[at - 1], text[at]):
                return at
        return len(text) if len(text) <= reach else None

    def _count(self, ids: np.ndarray, size: int) -> int:
        """How many of the first tokens make up `size` bytes, or lie within them."""
        ends = np.cumsum(self._sizes[ids[:size]])
        return int(np.searchsorted(ends, size, side="right"))

    def _count_back(self, ids: np.ndarray, size: int) -> int:
        ends = np.cumsum(self._sizes[ids[max(0, len(ids) - size) :][::-1]])
        return len(ids) - int(np.searchsorted(ends, size, side="right"))

    def _join_inside(
        self, left_text: str, left: np.ndarray, right_text: str, right: np.ndarray, reach: int
    ) -> np.ndarray | None:
        """The ids joined within one stretch of a single kind that spans `reach` characters on both sides, if a window
        of tokens inside it is stable. Two characters at either end stay out: a shorter match may begin there."""
        near, far = left_text[-reach:], right_text[:reach]
        if len(near) < reach or len(far) < reach or not _kind(far[0]):
            return None
        if _kind(far[0]) == "S" or any(_kind(c) != _kind(far[0]) for c in near) or any(_kind(c) != _kind(far[0]) for c in far):
            return None
        first = self._count_back(left, len(near[2:].encode()))
        last = self._count(right, len(far[:-2].encode()))
        # one token on each side is the neighbour that the window must form a stable pair with
        if len(left) - first < 2 or last < 2:
            return None
        window = self._merged(np.concatenate((left[first + 1 :], right[: last - 1])))
        if self._stable(left[first], window[0]) and self._stable(window[-1], right[last - 1]):
            return np.concatenate((left[: first + 1], window, right[last - 1 :]))
        return None

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        return np.asarray(self._library._encode_single_piece(self._library.decode_bytes(ids.tolist())), dtype=np.int32)

    def _stable(self, one: int, other: int) -> bool:
        pair = np.asarray([one, other], dtype=np.int32)
        return np.array_equal(self._merged(pair), pair)


@cache
def encoder(ranks_file: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One per worker process."""
    return TreeEncoder(ranks_file, pattern, leaf_chars)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))


def _encoded(rows: DataFrame, ranks_file: str, pattern: str, leaf_chars: int, ids: str, keep_text: bool) -> DataFrame:
    """The rows with `ids` of their last column, a text, instead of it or beside it."""
    kept = rows.columns if keep_text else rows.columns[:-1]
    schema = StructType([*[rows.schema[name] for name in kept], StructField(ids, ArrayType(IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_file, pattern, leaf_chars)
        for batch in batches:
            found = _lists([own.encode(text.as_py() or "") for text in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*[batch.column(at) for at in range(len(kept))], found], names=[*kept, ids])

    return rows.mapInArrow(run, schema)


def _joined_pairs(parts: DataFrame, ranks_file: str, pattern: str, leaf_chars: int) -> DataFrame:
    """One round of the tree over the parts (r, key, part, text, ids) of each text r: parts 2i and 2i + 1 become part i."""

    def run(table: pa.Table) -> pa.Table:
        own = encoder(ranks_file, pattern, leaf_chars)
        rows = table.sort_by("part").to_pylist()
        text, ids = rows[0]["text"], np.asarray(rows[0]["ids"], dtype=np.int32)
        for row in rows[1:]:
            ids = own.join(text, ids, row["text"], np.asarray(row["ids"], dtype=np.int32))
            text += row["text"]
        first = table.slice(0, 1)
        return pa.table(
            [first["r"], first["key"], pa.array([rows[0]["part"] // 2], pa.int32()), pa.array([text]), _lists([ids])],
            names=["r", "key", "part", "text", "ids"],
        )

    half = F.expr("part div 2")
    return parts.groupBy("r", half).applyInArrow(run, parts.schema)


def encode_texts(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    leaf_chars: int = LEAF_CHARS,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """key and ids (array of int) of every row: the token ids of its whole text, without special tokens.

    `ranks_file` lies at the same path on every executor; every token of it must be one that its own merges give, as in
    any trained vocabulary. Texts of up to `part_chars` characters are encoded where they are. Longer ones are dealt
    out in parts of that size, stored, and joined in pairs: as many rounds as the number of parts of the longest has
    binary digits, each part in a task of its own. A text must fit into a task at the last round.

    Null and empty texts have no ids. Null and repeated keys keep their rows; an empty table gives an empty result;
    other columns are ignored. Stores the parts of long texts when called.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = _encoded(narrow.where(size <= part_chars), ranks_file, pattern, leaf_chars, "ids", keep_text=False)
    cuts = F.sequence(F.lit(0), F.expr(f"(char_length(text) - 1) div {part_chars}").cast("int"))
    dealt = (
        narrow.where(size > part_chars)
        .select(F.monotonically_increasing_id().alias("r"), "key", "text")
        .select("r", "key", "text", F.explode(cuts).alias("part"))
        .select("r", "key", "part", F.substring("text", F.col("part") * part_chars + 1, F.lit(part_chars)).alias("text"))
    )
    long = stored(dealt, "bpe-texts")
    most = long.agg(F.max("part")).first()[0]
    if most is None:
        return short.withColumnRenamed("key", key)
    spread = long.repartition("r", "part")
    parts = stored(_encoded(spread, ranks_file, pattern, leaf_chars, "ids", keep_text=True), "bpe-parts")
    for _ in range(int(most).bit_length()):
        parts = stored(_joined_pairs(parts, ranks_file, pattern, leaf_chars), "bpe-joined")
    return short.unionByName(parts.select("key", "ids")).withColumnRenamed("key", key)


def decode_ids(
    rows: DataFrame, ranks_file: str, pattern: str, ids: str = "ids", to: str = "decoded", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """The rows with the bytes that their token ids stand for as `to`, which replaces a column of that name. Null and
    empty lists give no bytes."""
    plain = [name for name in rows.columns if name != to]
    at_ids = plain.index(ids)
    schema = StructType([*[rows.schema[name] for name in plain], StructField(to, BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_file, pattern, leaf_chars)
        for batch in batches:
            lists = batch.column(at_ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            found = [own.decode(flat[end - size : end]) for end, size in zip(ends, np.diff(ends, prepend=0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*plain, to])

    return rows.select(*plain).mapInArrow(run, schema)

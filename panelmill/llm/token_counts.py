"""Token counts of whole texts, without ever returning the tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.bpe import byte_level


def count_tokens(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8) and n_tokens of every row.

    `tokenizer_file` is a byte-level vocabulary without a normaliser, at the same path on every executor. Each
    Arrow batch is cut into slices of about a million characters, a long text over several slices, always at a
    single space between two other characters, which no token crosses; only lengths come back.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated keys keep their rows; an empty table gives
    an empty result; other columns are ignored.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_level(tokenizer_file)
        for batch in batches:
            texts = batch.column(1)
            totals = counter.count((value.as_py() for value in texts), len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals, pa.int64())], names=[key, "n_bytes", "n_tokens"]
            )

    narrow = docs.select(
        F.col(key), F.col(text).cast("string").alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes")
    )
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long")

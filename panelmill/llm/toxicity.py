"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, of their first letters (a truncation stem), of neighbouring pairs and
of pairs with one word between; each counts once. Every coordinate has its own learning rate, and the L1 term keeps
most weights at exactly zero, so that a model is a short list of numbers that can be broadcast.

The model is fitted on at most `max_rows` labelled rows, chosen by a hash of their key, in one task whose size this
bounds; scoring covers every row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.decontamination import words_of
from panelmill.llm.storage import positional, tidy

BITS = 20
MAX_ROWS = 16_384
_STEM_BYTES = 4
_PAIR, _SKIP, _STEM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 3


@dataclass(frozen=True)
class Model:
    """Non-zero weights by feature number, and the intercept (None: fitted on nothing, scores 0)."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float | None


def hashed_features(text: bytes) -> np.ndarray:
    """Feature numbers of a text, repeats included."""
    words = words_of(text)
    plain = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    stems = np.fromiter(map(zlib.crc32, [word[:_STEM_BYTES] for word in words]), np.uint64, len(words))
    mixed = [plain * _PAIR, stems * _STEM, (plain[:-1] * _PAIR + plain[1:]) * _SKIP, (plain[:-2] * _SKIP + plain[2:]) * _PAIR]
    return (np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.uint32)


def train(examples: list[tuple[np.ndarray, int]], settings: Settings) -> Model:
    """Examples are (distinct feature numbers, 0 or 1); they are visited in the order given, `epochs` times."""
    if not examples:
        return Model(np.empty(0, np.uint32), np.empty(0), None)
    alpha, beta, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at) -> np.ndarray:
        # the intercept, at the end, carries no L1 term
        shrink = np.where(np.arange(len(z))[at] < 1 << BITS, l1, 0.0) if isinstance(at, slice) else _shrink[: len(at)]
        pull = np.abs(z[at]) - shrink
        return np.where(pull > 0, -np.sign(z[at]) * pull / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    longest = max(len(features) for features, _ in examples) + 1
    _shrink = np.full(longest, l1)
    for _ in range(settings.epochs):
        for features, label in examples:
            at = np.append(features, 1 << BITS)
            _shrink[len(at) - 1] = 0.0
            w = weights(at)
            _shrink[len(at) - 1] = l1
            error = 1 / (1 + math.exp(-min(max(float(w.sum()), -30.0), 30.0))) - label
            rate = (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / alpha
            z[at] += error - rate * w
            n[at] += error * error
    w = weights(slice(None))
    kept = np.flatnonzero(w[:-1])
    return Model(kept.astype(np.uint32), w[kept], float(w[-1]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    settings: Settings = Settings(),
) -> Model:
    """Fit on the texts of at most `max_rows` rows of `labels`, which also bounds what is broadcast and collected.

    Labels that are null or belong to no document teach nothing; of repeated documents or labels each pair counts.
    A null text is empty. Without labelled rows the model scores everything 0.
    """
    order = F.xxhash64(key)
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .select(key, F.col(label).cast("int").alias("_label"))
        .orderBy(order, key, "_label").limit(max_rows)
    )
    sample = docs.select(key, F.col(text).cast("string").cast("binary").alias("_text")).join(F.broadcast(chosen), key).select(
        order.alias("_order"), "_text", "_label"
    )

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(hashed_features(raw.as_py() or b"")).astype("<u4").tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["_order", "_features", "_label"]
            )

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        rows.sort()
        model = train([(np.frombuffer(raw, "<u4"), label) for _, raw, label in rows], settings)
        features = [*model.features.tolist(), *([] if model.intercept is None else [-1])]
        weights = [*model.weights.tolist(), *([] if model.intercept is None else [model.intercept])]
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array(weights, pa.float64())], names=["feature", "weight"])

    found = (
        sample.mapInArrow(tidy(extract), "_order long, _features binary, _label int")
        .repartition(1)
        .mapInArrow(tidy(learn), "feature long, weight double")
        .toPandas()
    )
    weighted = found[found["feature"] >= 0].sort_values("feature")
    intercept = found.loc[found["feature"] < 0, "weight"]
    return Model(
        weighted["feature"].to_numpy(np.uint32), weighted["weight"].to_numpy(), float(intercept.iloc[0]) if len(intercept) else None
    )


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row; only the text is looked at. Null and empty texts get the
    intercept's. Every column passes through; a column that is already named as the score is replaced."""
    columns = [name for name in docs.columns if name != to]
    source, _ = positional(docs.select(*columns))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = columns.index(text)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[model.features] = model.weights
        for batch in batches:
            values = []
            for raw in batch.column(at).cast(pa.binary()):
                features = hashed_features(raw.as_py() or b"")
                total = dense[np.unique(features[dense[features] != 0])].sum() if len(features) else 0.0
                values.append(0.0 if model.intercept is None else 1 / (1 + math.exp(-min(max(total + model.intercept, -700), 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in source.schema)
    return source.mapInArrow(tidy(scored), f"{kinds}, score double").toDF(*columns, to)


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that labels may be learnt from; the others are held out."""
    return labels.where(~held_out(key))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))

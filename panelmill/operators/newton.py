"""Weighted, penalised logistic regression by distributed Newton steps.

One step is one aggregate over the rows: each task sums the loss, the gradient and the outer products of its rows as
one block, and the blocks are added element by element. What reaches the driver is one number for each pair of
columns, whatever the table holds. The sums are decimals, so the order in which tasks end does not show.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows turned into a matrix at a time
_BLOCK_ROWS = 4096
_DIGITS = 12


def _block(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Loss, gradient and the upper triangle of the curvature, in a row."""
    margin = x @ at
    chance = 1.0 / (1.0 + np.exp(-np.clip(margin, -700.0, 700.0)))
    loss = w @ (np.logaddexp(0.0, margin) - y * margin)
    curvature = (x * (w * chance * (1.0 - chance))[:, None]).T @ x
    return np.concatenate([[loss], x.T @ (w * (chance - y)), curvature[np.triu_indices(len(at))]])


def _sums(rows: DataFrame, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    width = len(at)
    count = 1 + width + width * (width + 1) // 2

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in (batch.slice(low, _BLOCK_ROWS) for batch in batches for low in range(0, batch.num_rows, _BLOCK_ROWS)):
            x = np.ones((batch.num_rows, width))
            x[:, :-1] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)
            total += _block(x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), at)
        if not np.isfinite(total).all():
            raise ValueError("a feature, a target or a weight is not finite")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    partial = rows.select("x", "y", "w").mapInArrow(summed, "place int, value double")
    found = partial.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,12)")).alias("value")).collect()
    values = np.zeros(count)
    for place, value in found:
        values[place] = float(value)
    curvature = np.zeros((width, width))
    curvature[np.triu_indices(width)] = values[1 + width :]
    return values[0], values[1 : 1 + width], np.triu(curvature) + np.triu(curvature, 1).T


def newton_logistic(rows: DataFrame, width: int, penalty: float = 0.0, max_iter: int = 50, tolerance: float = 1e-18) -> tuple[list[float], float]:
    """Coefficients and intercept that minimise the weighted log-loss plus penalty / 2 times their squared length.

    `rows` has x (array of `width` doubles), y (target, 0 to 1) and w (weight), and is read once a step. The intercept
    bears no penalty. A step that raises the objective is halved. Steps end when the decrement, relative to the total
    weight, is below `tolerance`. An empty table gives zeros.
    """
    charge = np.array([penalty] * width + [0.0])
    at, last, least = np.zeros(width + 1), np.zeros(width + 1), np.inf
    scale = float(rows.agg(F.coalesce(F.sum(F.col("w").cast("decimal(38,12)")), F.lit(0))).first()[0]) or 1.0
    for _ in range(max_iter):
        loss, slope, curvature = _sums(rows, at)
        loss += float(charge @ (at * at)) / 2
        if loss > least + 1e-9 * scale:
            at = (at + last) / 2
            continue
        slope = slope + charge * at
        # columns that say the same have no unique solution without a penalty: the shortest step is taken
        step = np.linalg.lstsq(curvature + np.diag(charge), slope, rcond=None)[0]
        last, least, at = at, loss, at - step
        if float(slope @ step) <= tolerance * scale:
            break
    return [round(float(value), _DIGITS) for value in at[:-1]], round(float(at[-1]), _DIGITS)

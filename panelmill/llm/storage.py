"""Intermediate tables in the shared folder, and memory that Python workers give back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from panelmill.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once where every executor can reach them, and read them back: later jobs recompute nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns c0, c1, ..., and the new name of each: columns that an operator adds on the way can
    then clash with none of the caller's."""
    names = {name: f"c{at}" for at, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """The same function of batches; when a task ends, what it freed goes back to the system. Workers live from one
    stage to the next, and would hold on to the peak of each beside the executor's heap."""

    def run(batches: Iterable) -> Iterator:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run

"""A numbered log of committed versions, shared by writers that do not know of each other.

Entry n of a log is one small file, created only if it does not exist yet. A writer notes the number it starts from and
commits the next one; whoever comes second finds the number taken and fails cleanly. Creating a file that must not
exist is the one thing asked of the store: HDFS does it atomically, and object stores with conditional writes do.
Versions that no entry names are left-overs and can be removed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list:
    store, at = _store(spark, path)
    return list(store.listStatus(at)) if store.exists(at) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def entries(spark: SparkSession, root: str) -> list[tuple[int, dict]]:
    """Number and content of every complete entry, oldest first. An entry whose writer died half-way is left out."""
    numbers = sorted(int(status.getPath().getName().removesuffix(".json")) for status in _listed(spark, f"{root}/log"))
    found = []
    for number in numbers:
        store, at = _store(spark, f"{root}/log/{number:012d}.json")
        stream = store.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found.append((number, json.loads(text)))
        except json.JSONDecodeError:
            continue
    return found


def last_number(spark: SparkSession, root: str) -> int:
    """The highest number taken, 0 for an empty log: what a writer starts from."""
    return max((int(status.getPath().getName().removesuffix(".json")) for status in _listed(spark, f"{root}/log")), default=0)


def newest(spark: SparkSession, root: str) -> dict | None:
    found = entries(spark, root)
    return found[-1][1] if found else None


def commit(spark: SparkSession, root: str, base: int, entry: Mapping[str, object]) -> int:
    """Add the entry after number `base`; CommitConflict if somebody else has."""
    store, at = _store(spark, f"{root}/log/{base + 1:012d}.json")
    try:
        stream = store.create(at, False)
    except Py4JJavaError as error:
        if store.exists(at):
            raise CommitConflict(f"entry {base + 1} of {root} was committed by another writer") from error
        raise
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()
    return base + 1


def unnamed_versions(spark: SparkSession, root: str, grace_hours: float = 24.0) -> list[str]:
    """Versions below root/versions that no entry names and that nobody has written to for `grace_hours`: those of
    writers that failed. A running writer's version is younger."""
    named = {entry.get("version") for _, entry in entries(spark, root)}
    before = (time.time() - grace_hours * 3600) * 1000
    return sorted(
        status.getPath().getName()
        for status in _listed(spark, f"{root}/versions")
        if status.getPath().getName() not in named and status.getModificationTime() <= before
    )


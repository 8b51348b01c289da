"""Two writers, left-overs, and fingerprints that see any change of a file."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import random

import pytest

from panelmill.plans.star_schema import build_warehouse
from panelmill.sources import commit_log, merkle, publishing
from panelmill.sources.holdings_file import IngestError, load_checked
from tests import planted


@pytest.fixture
def rows(spark, write_csv):
    return load_checked(spark, write_csv(planted.csv_text()), planted.CATALOGUE, planted.MONTHS)[0]


def versions(root):
    return sorted(os.listdir(f"{root}/versions"))


def test_of_two_writers_one_fails(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    publishing.publish(rows, root, "ncodpers")
    base = commit_log.last_number(spark, root)
    first = publishing.publish(rows.filter("ncodpers > 5"), root, "ncodpers", base=base)
    with pytest.raises(commit_log.CommitConflict):
        publishing.publish(rows.filter("ncodpers > 7"), root, "ncodpers", base=base)
    assert publishing.published_version(spark, root)["version"] == first["version"]
    assert len(versions(root)) == 2 and [n for n, _ in commit_log.entries(spark, root)] == [1, 2]


def test_left_overs_go(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    kept = publishing.publish(rows, root, "ncodpers")["version"]
    with pytest.raises(IngestError):
        publishing.publish(rows, root, "ncodpers", expected_rows=1)
    assert versions(root) == [kept]
    dead = tmp_path / "lake" / "versions" / "dead"
    (dead / "rows").mkdir(parents=True)
    assert commit_log.unnamed_versions(spark, root) == []  # it may still be written
    os.utime(dead, (0, 0))
    newer = publishing.publish(rows, root, "ncodpers")["version"]
    assert versions(root) == sorted([kept, newer])


def test_a_half_written_entry_is_no_entry(spark, tmp_path):
    root = str(tmp_path / "log-only")
    assert commit_log.newest(spark, root) is None and commit_log.commit(spark, root, 0, {"version": "a"}) == 1
    (tmp_path / "log-only" / "log" / "000000000002.json").write_text('{"version": "b')
    assert commit_log.newest(spark, root) == {"version": "a"} and commit_log.last_number(spark, root) == 2
    with pytest.raises(commit_log.CommitConflict):
        commit_log.commit(spark, root, 1, {"version": "c"})
    assert commit_log.commit(spark, root, 2, {"version": "c"}) == 3
    assert commit_log.newest(spark, root) == {"version": "c"}


def test_failed_build_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "w")
    build_warehouse(spark, rows, planted.CATALOGUE, dt.date(2015, 1, 1), path, buckets=2)
    tables = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception):  # noqa: B017
        build_warehouse(spark, rows.drop("renta"), planted.CATALOGUE, dt.date(2015, 1, 1), path, buckets=2)
    assert len(versions(path)) == 1 and {t.name for t in spark.catalog.listTables()} == tables


def plain_root(lines, block_bytes):
    blocks, start = {}, 0
    for line in lines:
        blocks.setdefault(start // block_bytes, []).append(hashlib.sha256(line.encode()).hexdigest())
        start += len(line.encode()) + 1
    nodes = {n: hashlib.sha256("".join(d).encode()).hexdigest() for n, d in blocks.items()}
    most = max(nodes)
    while most > 0:
        above = {}
        for n in sorted(nodes):
            above.setdefault(n // 16, []).append(nodes[n])
        nodes = {n: hashlib.sha256("".join(d).encode()).hexdigest() for n, d in above.items()}
        most //= 16
    return hashlib.sha256(f"{start}|{len(lines)}|{nodes[0]}".encode()).hexdigest()


def test_hash_tree(spark, tmp_path):
    rng = random.Random(2)
    lines = ["é" * rng.randint(0, 30) + str(rng.random()) for _ in range(3000)] + [""] * 5 + ["x" * 5000, "y"]
    path = tmp_path / "one.txt"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        small = merkle.merkle_roots(merkle.merkle_leaves(spark, str(path), block_bytes=300)).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    leaves = merkle.merkle_leaves(spark, str(path), block_bytes=300).cache()
    root = merkle.merkle_roots(leaves).first()
    assert root == small and root["digest"] == plain_root(lines, 300)
    assert (root["file"], root["bytes"], root["lines"]) == ("one.txt", path.stat().st_size, len(lines))

    def changed(new):
        (tmp_path / "new").mkdir(exist_ok=True)
        (tmp_path / "new" / "one.txt").write_text("\n".join(new) + "\n", encoding="utf-8")
        now = merkle.merkle_leaves(spark, str(tmp_path / "new" / "one.txt"), block_bytes=300)
        return merkle.first_difference(leaves, now).collect(), merkle.merkle_roots(now).first()["digest"] != root["digest"]

    assert changed(lines) == ([], False)
    swapped = lines[:1000] + [lines[1001], lines[1000]] + lines[1002:]
    (difference,), differs = changed(swapped)
    byte = len(("\n".join(lines[:1000]) + "\n").encode())
    assert differs and difference["block"] == byte // 300
    (difference,), differs = changed(lines + ["more"])
    assert differs and difference["block"] >= (path.stat().st_size - 3) // 300
    leaves.unpersist()

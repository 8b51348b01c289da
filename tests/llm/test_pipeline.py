from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from panelmill.llm import queries
from tests.test_entry import TABLES, comparable
from tests.llm.conftest import rows_of
from tests.llm.test_dedup import brute_components
from tests.llm.test_scoring_search_and_format import brute_passages

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(folder / name))
        out.append((docs, spark.read.parquet(str(folder / name))))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_toxic_documents_go(stages):
    before, after = stages[0]
    assert 0 < after.count() < before.count() and after.exceptAll(before).isEmpty()


def test_lines_go_but_no_document(stages):
    before, after = stages[1]
    assert rows_of(before, "doc_id") == rows_of(after, "doc_id")
    assert after.where("n_chars <> length(text)").isEmpty()


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    rows = before.collect()
    found = brute_components([r["text"] for r in rows], [r["doc_id"] for r in rows], 5, 80, 100)
    assert [r[0] for r in rows_of(after, "doc_id")] == sorted({least for _, n, least in found}, key=lambda x: repr((x,)))


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {key for key, _, n_hit, _ in brute_passages([(r["doc_id"], r["text"]) for r in before.collect()], items) if n_hit}
    assert {r[0] for r in rows_of(before, "doc_id")} - hit == {r[0] for r in rows_of(after, "doc_id")}


def test_every_document_is_packed(spark, stages):
    before, after = stages[4]
    assert Counter(r["doc_id"] for r in after.where("piece = 0").collect()) == Counter(r["doc_id"] for r in before.collect())
    assert rows_of(corpus_pipeline.run(spark, SF_DIR), "doc_id", "piece", "ids_crc32") == rows_of(after, "doc_id", "piece", "ids_crc32")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_answer(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(queries.ORACLES[name])
    order = [column[0] for column in cursor.description]
    columns = sorted(found.columns)
    assert sorted(order) == columns
    expected = sorted(tuple(comparable(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(comparable(v) for v in row) for row in found.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_leave_out_no_document(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    if "doc_id" in found.columns and "piece" not in found.columns:
        assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()

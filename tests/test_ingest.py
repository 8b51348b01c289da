from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelmill.functions.hashing import HASH_MODULUS, HASH_MULTIPLIER, in_sample, sample_entities
from panelmill.sources import holdings_file as files
from panelmill.sources import publishing
from tests import planted


def load(spark, path, **options):
    return files.load_checked(spark, path, planted.CATALOGUE, options.pop("months", planted.MONTHS), **options)


def test_all_rows_and_types(spark, write_csv):
    rows, facts = load(spark, write_csv(planted.csv_text()))
    assert facts == {"source_rows": 235, "columns": 48}
    kinds = dict(rows.dtypes)
    assert kinds["fecha_dato"] == "date" and kinds["ncodpers"] == "bigint"
    assert {kinds[flag] for flag in planted.FLAGS} == {"tinyint"}
    counts = rows.groupBy("month").count().orderBy("month").collect()
    assert [(row["month"], row["count"]) for row in counts] == list(
        zip(planted.MONTHS, planted.ROWS_PER_MONTH, strict=True)
    )


def test_text_is_kept_as_delivered(spark, write_csv):
    rows, _ = load(spark, write_csv(planted.csv_text()))
    odd = {row["ncodpers"]: row for row in rows.filter("month = '2015-02'").collect()}
    assert odd[10]["renta"] == "         NA" and odd[10]["nomprov"] == "CORUÑA, A"
    assert odd[9]["renta"] is None and odd[14]["fecha_alta"] is None
    assert odd[1]["age"] == "  31" and odd[1]["indrel_1mes"] == "1.0"
    assert odd[12][planted.PAYROLL] is None and odd[12][planted.DEBIT] == 0


def test_bare_null_tokens_and_quoted_blanks_are_null(spark, write_csv):
    rows = planted.raw_rows()
    rows[0]["pais_residencia"], rows[1]["pais_residencia"] = "NA", " NA"
    text = planted.csv_text(rows).replace("02 - RETAIL", '""', 1)
    loaded, _ = load(spark, write_csv(text))
    assert loaded.filter("month = '2015-01' AND pais_residencia IS NULL").count() == 1
    assert loaded.filter("pais_residencia = ' NA'").count() == 1
    assert loaded.filter("segmento IS NULL").count() == 1


def test_column_order_of_the_file_does_not_matter(spark, write_csv):
    shuffled = list(reversed(planted.COLUMNS))
    rows, _ = load(spark, write_csv(planted.csv_text(columns=shuffled)))
    assert rows.columns[:2] == ["fecha_dato", "ncodpers"] and rows.filter("ncodpers = 1").count() == 6


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda text: text.replace("renta,", "rent,", 1), "missing renta, unexpected rent"),
        (lambda text: text.replace("MADRID", '"MAD\nRID"', 1), "data lines"),
        (lambda text: text[: text.rindex(",") - 30], "data lines"),
        (lambda text: text.replace("2015-01-28,1,", "2015-01-28,,", 1), "without"),
        (lambda text: text.replace("2015-01-28,1,", ",1,", 1), "without"),
        (lambda text: text.replace("2015-01-28,1,", "2015-01-28,x1,", 1), "do not parse"),
        (lambda text: text.replace(",0,0,0\n", ",0,0,300\n", 1), "do not parse"),
    ],
)
def test_damage_stops_the_load(spark, write_csv, change, message):
    with pytest.raises(files.IngestError, match=message):
        load(spark, write_csv(change(planted.csv_text())))


def test_missing_last_newline_is_no_damage(spark, write_csv):
    assert load(spark, write_csv(planted.csv_text().rstrip("\n")))[0].count() == 235


def test_unexpected_months(spark, write_csv):
    path = write_csv(planted.csv_text())
    with pytest.raises(files.IngestError, match="expected months"):
        load(spark, path, months=planted.MONTHS[1:])
    rows, _ = load(spark, path)
    found = files.period_differences(rows, [*planted.MONTHS[1:], "2015-07"]).collect()
    assert {(row["month"], row["problem"]) for row in found} == {("2015-01", "unexpected"), ("2015-07", "missing")}


def test_expected_months_cross_years():
    assert files.expected_months("2015-11", "2016-02") == ["2015-11", "2015-12", "2016-01", "2016-02"]
    with pytest.raises(ValueError):
        files.expected_months("2016-02", "2015-11")


def test_sample_keeps_whole_entities(spark, write_csv):
    rows, _ = load(spark, write_csv(planted.csv_text()), sample_share=0.5)
    expected = {c for c in planted.CUSTOMERS if (c * HASH_MULTIPLIER) % HASH_MODULUS < 0.5 * HASH_MODULUS}
    counts = {row["ncodpers"]: row["count"] for row in rows.groupBy("ncodpers").count().collect()}
    assert counts == {c: len(planted.PRESENT.get(c, planted.ALWAYS)) for c in expected}


def test_sample_hash_of_extreme_ids(spark):
    ids = [0, 1, 2**31, 2**32 - 1, 2**32 + 5, 9 * 10**9, 2**62, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    kept = {row["id"] for row in sample_entities(df, 0.4, "id").collect()}
    assert kept == {i for i in ids if (i % 2**64 * HASH_MULTIPLIER) % HASH_MODULUS < int(0.4 * HASH_MODULUS)}
    for share in (0, -0.1, 1.5):
        with pytest.raises(ValueError):
            in_sample(F.lit(1), share)


def test_publish_and_read_back(spark, write_csv, tmp_path):
    rows, _ = load(spark, write_csv(planted.csv_text()))
    root = str(tmp_path / "published")
    assert publishing.published_version(spark, root) is None
    entry = publishing.publish(rows, root, "ncodpers", expected_rows=235, expected_periods=planted.MONTHS)
    assert (entry["rows"], entry["entities"], entry["periods"], entry["columns"]) == (235, 40, 6, 49)
    assert [item["rows"] for item in entry["rows_per_period"]] == planted.ROWS_PER_MONTH
    stored = publishing.read_published(spark, root)
    assert stored.select(rows.columns).exceptAll(rows).isEmpty() and stored.count() == 235
    assert dict(stored.dtypes)["month"] == "string"


def test_failed_publication_is_never_seen(spark, write_csv, tmp_path):
    rows, _ = load(spark, write_csv(planted.csv_text()))
    root = str(tmp_path / "published")
    publishing.publish(rows, root, "ncodpers")
    with pytest.raises(files.IngestError):
        publishing.publish(rows.filter("ncodpers > 5"), root, "ncodpers", expected_rows=235)
    assert publishing.read_published(spark, root).count() == 235
    publishing.publish(rows.filter("ncodpers > 5"), root, "ncodpers")
    assert publishing.read_published(spark, root).count() == rows.filter("ncodpers > 5").count()


def test_pruned_read_opens_one_folder(spark, write_csv, tmp_path):
    rows, _ = load(spark, write_csv(planted.csv_text()))
    path = str(tmp_path / "months")
    publishing.write_by_period(rows, path)
    one = spark.read.parquet(path).filter(F.col("month") == "2015-03").select("ncodpers")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "ReadSchema: struct<ncodpers:bigint>" in plan


def test_rebuild_reasons(spark, write_csv, tmp_path):
    rows, _ = load(spark, write_csv(planted.csv_text()))
    root = str(tmp_path / "published")
    publishing.publish(rows, root, "ncodpers")
    entry = publishing.published_version(spark, root)
    source = publishing.source_fingerprint(spark, write_csv(planted.csv_text()))
    files_then = publishing.stored_files(spark, f"{root}/versions/{entry['version']}")
    assert files_then.count() >= 6
    same = publishing.file_status(files_then, files_then)
    assert publishing.rebuild_reason(None, None, None, None) == "no manifest"
    assert publishing.rebuild_reason(entry, None, same, publishing.file_status(source, source)) is None
    assert "sample share" in publishing.rebuild_reason(entry, 0.5, same, None)
    assert "version" in publishing.rebuild_reason({**entry, "schema_version": 0}, None, same, None)
    grown = files_then.withColumn("bytes", F.col("bytes") + 1)
    assert "changed" in publishing.rebuild_reason(entry, None, publishing.file_status(files_then, grown), None)
    assert "no files" in publishing.rebuild_reason(entry, None, same.limit(0), None)
    other = publishing.source_fingerprint(spark, write_csv(planted.csv_text().replace("KFC", "KFA", 1), "new/raw.csv"))
    assert "source" in publishing.rebuild_reason(entry, None, same, publishing.file_status(source, other))


def test_line_ends_and_strict_dates(spark, write_csv):
    text = planted.csv_text()
    plain, _ = files.load_checked(spark, write_csv(text), planted.CATALOGUE, planted.MONTHS)
    windows, facts = files.load_checked(spark, write_csv(text.replace("\n", "\r\n"), "crlf.csv"), planted.CATALOGUE, planted.MONTHS)
    assert facts["source_rows"] == plain.count() and plain.exceptAll(windows).isEmpty()
    for bad in ("2015", "2015-1", "2015-01-28 junk"):
        with pytest.raises(files.IngestError, match="do not parse"):
            files.load_checked(spark, write_csv(text.replace("2015-01-28", bad, 1), f"{bad[:7]}{len(bad)}.csv"), planted.CATALOGUE)


def test_load_unless_current(spark, write_csv, tmp_path):
    source, root = write_csv(planted.csv_text()), str(tmp_path / "lake")

    def load(share=None):
        return publishing.load_unless_current(spark, source, root, planted.CATALOGUE, planted.MONTHS, share)

    rows, reason = load()
    assert reason == "no manifest" and rows.count() == 235
    rows, reason = load()
    assert reason is None and rows.count() == 235
    assert "sample share" in load(1.0)[1] and "sample share" in load()[1]
    version = publishing.published_version(spark, root)
    assert version["source_rows"] == 235 and version["bytes"] > 0 and version["source_files"][0]["lines"] == 236
    next(f for f in (tmp_path / "lake" / "versions" / version["version"]).rglob("*.parquet")).unlink()
    assert load()[1] == "a stored file is missing or changed"
    write_csv(planted.csv_text() + "\n" if not planted.csv_text().endswith("\n") else planted.csv_text().replace("ES", "FR", 1))
    assert load()[1] == "the source differs from the one that was loaded"


def test_no_local_folder_on_a_cluster():
    class Stub:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Stub()

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    from panelmill.session import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())

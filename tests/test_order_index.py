"""The stored order, the keyed shuffle, and what the bootstrap stores."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import bootstrap, evaluation, order_index, pairs, shuffling


def test_ranks_with_a_hot_score(spark):
    rng = random.Random(3)
    rows = [(g, i, 0.5 if rng.random() < 0.6 else rng.random()) for g in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "g string, tie int, score double").repartition(5)
    index = order_index.order_index(df, [F.desc("score"), F.asc("tie")], ["g"])
    for g in "ab":
        found = {r["tie"]: (r["position"], r["position_count"]) for r in index.only(g=g).ranked().collect()}
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert found == {row[1]: (at, 700) for at, row in enumerate(order, start=1)}
    assert order_index.order_index(df.limit(0), [F.desc("score"), F.asc("tie")]).ranked().count() == 0


@pytest.mark.parametrize("count", [1, 2, 7, 1000])
def test_keyed_shuffle_is_a_bijection(spark, count):
    place, n = F.col("id"), F.lit(count).cast("bigint")
    there = shuffling.shuffled_place(place, n, 42, 1)
    back = shuffling.shuffled_place(F.col("there"), n, 42, 1, inverse=True)
    rows = spark.range(count).select("id", there.alias("there")).select("id", "there", back.alias("back")).collect()
    assert sorted(r["there"] for r in rows) == list(range(count)) and all(r["back"] == r["id"] for r in rows)
    if count == 1000:
        assert sum(r["there"] == r["id"] for r in rows) < 10


def test_the_bootstrap_stores_slices_times_resamples(spark, monkeypatch):
    """Distinct scores only: no more is stored than three rows for each slice and resample."""
    rng = random.Random(6)
    rows = [(i, i % 50, int(rng.random() < 0.2), rng.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "tie int, customer_id int, label int, score double")
    stored = []
    keep = bootstrap.cut_lineage

    def counted(frame):
        kept = keep(frame)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(bootstrap, "cut_lineage", counted)
    index = evaluation.index_scores(df, ["customer_id"])
    found = evaluation.cluster_bootstrap(index, "customer_id", 40, 42).collect()
    slices = index.slices.count()
    assert len(found) == 7 and len(stored) == 2
    assert stored[0] == slices * 41 and stored[1] <= 3 * slices * 41 < 6000


def test_small_slices_of_the_bootstrap_stay_apart(spark, monkeypatch):
    """Few rows times many resamples are much work: no task gets several slices only because their rows are few."""
    rows = [(i, i % 300, int(i % 7 == 0), (i * 37 % 4001) / 4001) for i in range(4000)]
    df = spark.createDataFrame(rows, "tie int, customer_id int, label int, score double")
    stored = []
    keep = bootstrap.cut_lineage
    monkeypatch.setattr(bootstrap, "cut_lineage", lambda frame: stored.append(keep(frame)) or stored[-1])
    index = evaluation.index_scores(df, ["customer_id"])
    evaluation.cluster_bootstrap(index, "customer_id", 8, 42).collect()
    assert index.slices.count() > 1
    assert stored[1].rdd.getNumPartitions() >= index.slices.count()


@pytest.mark.parametrize("resamples", [1, 7, 43])
def test_weights_of_the_bootstrap_are_quarters_of_digests(resamples):
    names = [None, "", "7", "1234", "-5", "é", "x" * 48, "x" * 53, "x" * 90, *map(str, range(300))]
    found = bootstrap._weights_of(resamples, 42)(names)
    for at, name in enumerate(names):
        for resample in range(resamples):
            text = f"{'' if name is None else name + '|'}{resample // 4}|42"
            draw = int(hashlib.md5(text.encode()).hexdigest()[resample % 4 * 8 :][:8], 16)
            assert found[resample, at] == sum(draw >= bound for bound in bootstrap.POISSON_ONE)
    assert (found[-1] == 1).all() and found.shape == (resamples + 1, len(names))


def test_the_bootstrap_draws_a_cluster_once_for_each_slice(spark, monkeypatch):
    """However many of its rows have the slice's one score."""
    drawn = spark.sparkContext.accumulator(0)
    whole = bootstrap._weights_of

    def counted(*given):
        weights = whole(*given)

        def count(names):
            drawn.add(len(names))
            return weights(names)

        return count

    monkeypatch.setattr(bootstrap, "_weights_of", counted)
    rows = [(i, i % 5, int(i % 3 == 0), 0.5) for i in range(30000)]
    df = spark.createDataFrame(rows, "tie int, customer_id int, label int, score double")
    index = evaluation.index_scores(df, ["customer_id"])
    evaluation.cluster_bootstrap(index, "customer_id", 1000, 42).collect()
    assert drawn.value <= 2 * 5 * index.slices.count()


def test_the_bootstrap_of_no_rows(spark):
    df = spark.createDataFrame([], "tie int, customer_id int, label int, score double")
    assert evaluation.cluster_bootstrap(df, "customer_id", 8, 42).collect() == []


def test_fingerprints_of_results(spark):
    one = spark.createDataFrame([(1, None), (None, 1), (2, 2), (2, 2)], "a int, b int")
    same = spark.createDataFrame([(2, 2), (None, 1), (2, 2), (1, None)], "a int, b int")
    turned = spark.createDataFrame([(2, 2), (None, 1), (2, 2), (None, 1)], "a int, b int")
    found = {r["pair"]: (r["rows_different"], r["equivalent"]) for r in pairs.equivalence({"same": (one, same), "other": (one, turned)}).collect()}
    assert found == {"same": (0, True), "other": (2, False)}

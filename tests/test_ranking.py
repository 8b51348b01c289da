from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmill.operators import evaluation, ranking


def test_running_totals_with_a_hot_value(spark):
    """One value holds most rows; groups span slices; totals are those of a plain loop."""
    rng = random.Random(1)
    rows = [(g, 7 if rng.random() < 0.7 else rng.randint(0, 50), i, rng.randint(1, 5)) for g in "ab" for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(8)
    found = ranking.running_totals(df, [F.desc("v"), F.asc("i")], {"w": F.col("w"), "n": F.lit(1)}, ["g"])
    expected = {}
    for g in "ab":
        total = count = 0
        for row in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])):
            total, count = total + row[3], count + 1
            expected[g, row[2]] = (total, count)
    out = found.collect()
    assert {(r["g"], r["i"]): (r["w_running"], r["n_running"]) for r in out} == expected
    assert {(r["g"], r["n_total"]) for r in out} == {("a", 3000), ("b", 3000)}


def test_slices_spread_a_hot_value(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit(1).alias("v"), "id")
        sliced = df.repartitionByRange(F.desc("v"), F.asc("id")).withColumn("s", F.spark_partition_id())
        sizes = [row["count"] for row in sliced.groupBy("s").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 1500


@pytest.mark.parametrize("count, tiles", [(10, 4), (11, 4), (3, 4), (1, 10), (40, 10), (99, 10)])
def test_tiles_and_bins(spark, count, tiles):
    df = spark.range(1, count + 1).select(F.col("id").alias("p"), F.lit(count).cast("bigint").alias("n"))
    got = [r[0] for r in df.orderBy("p").select(ranking.ntile(F.col("p"), F.col("n"), tiles)).collect()]
    size, longer = divmod(count, tiles)
    expected = [t + 1 for t in range(tiles) for _ in range(size + (t < longer))]
    assert got == expected
    bins = [r[0] for r in df.orderBy("p").select(ranking.quantile_bin(F.col("p"), F.col("n"), tiles)).collect()]
    used = min(tiles, count)
    edges = [1 + (count - 1) * q / used for q in range(used + 1)]
    assert all(
        (p == 1 and b == 1) or edges[b - 1] - 1e-9 < p <= edges[b] + 1e-9 for p, b in enumerate(bins, start=1)
    )


def reference_metrics(rows, shares=(0.05, 0.1, 0.2)):
    """rows: (label, score, weight) in tie order. Quadratic pair counting, no shared code."""
    pos = [(s, w) for y, s, w in rows if y]
    neg = [(s, w) for y, s, w in rows if not y]
    wins = sum(wp * wn * (1.0 if sp > sn else 0.5 if sp == sn else 0.0) for sp, wp in pos for sn, wn in neg)
    p, n = sum(w for _, w in pos), sum(w for _, w in neg)
    ap, last = 0.0, 0.0
    for cut in sorted({s for _, s, _ in rows}, reverse=True):
        above = [(y, w) for y, s, w in rows if s >= cut]
        hit, seen = sum(w for y, w in above if y), sum(w for _, w in above)
        if seen:
            ap += (hit / p - last) * hit / seen
        last = hit / p
    out = {
        "roc_auc": wins / (p * n),
        "pr_auc": ap,
        "brier": sum(w * (s - y) ** 2 for y, s, w in rows) / (p + n),
    }
    for share in shares:
        seen = hit = 0.0
        for y, s, w in sorted(rows, key=lambda r: -r[1]):
            if seen + w > share * (p + n):
                break
            seen, hit = seen + w, hit + w * y
        out[evaluation.capture_name(share)] = hit / p
    out["top_decile_lift"] = out["capture_top_10pct"] / 0.1
    return out


def scored(spark, rows):
    data = [(i, y, s, w) for i, (y, s, w) in enumerate(rows)]
    return spark.createDataFrame(data, "tie bigint, label int, score double, weight double")


def check(found, expected):
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=1e-9), name


@pytest.mark.parametrize("decimals", [1, 2, 9])
@pytest.mark.parametrize("weighted", [False, True])
def test_metrics_with_ties_and_weights(spark, decimals, weighted):
    rng = random.Random(decimals)
    rows = []
    for _ in range(400):
        score = round(rng.random() ** 2, decimals)
        rows.append((int(rng.random() < score), score, float(rng.randint(0, 3)) if weighted else 1.0))
    found = evaluation.point_metrics(scored(spark, rows), weight="weight" if weighted else None).first()
    check(found, reference_metrics(rows))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=2, max_size=40))
def test_metrics_of_small_samples(spark, pairs):
    rows = [(y, s / 4, 1.0) for y, s in pairs]
    found = evaluation.point_metrics(scored(spark, rows)).first()
    assert found["rows"] == len(rows) and found["positives"] == sum(y for y, _ in pairs)
    if 0 < sum(y for y, _ in pairs) < len(pairs):
        check(found, reference_metrics(rows))
    else:
        assert found["roc_auc"] is None and found["capture_top_5pct"] is None and found["brier"] is None


def test_perfect_ranking(spark):
    rows = [(int(i >= 90), i / 100, 1.0) for i in range(100)]
    found = evaluation.point_metrics(scored(spark, rows)).first()
    assert (found["roc_auc"], found["pr_auc"], found["top_decile_lift"]) == (1.0, 1.0, 10.0)
    assert (found["capture_top_5pct"], found["capture_top_10pct"]) == (0.5, 1.0)
    lift = evaluation.lift_table(scored(spark, rows)).orderBy("decile").collect()
    assert [r["adopters"] for r in lift] == [10] + [0] * 9 and lift[0]["lift"] == 10.0
    assert lift[-1]["cumulative_capture"] == 1.0 and lift[-1]["cumulative_lift"] == 1.0
    capacity = evaluation.capacity_table(scored(spark, rows), (0.05, 0.101), 100.0, 1.0).orderBy("share_contacted").collect()
    assert [(r["customers_contacted"], r["observed_adopters"], r["precision"]) for r in capacity] == [(5, 5, 1.0), (11, 10, 10 / 11)]
    assert capacity[0]["assumed_value"] == pytest.approx(sum(i / 100 for i in range(95, 100)) * 100 - 5)


def test_groups_are_independent(spark):
    rng = random.Random(9)
    rows = [(g, i, int(rng.random() < 0.3), rng.randint(0, 5) / 5) for g in (0, 1, 2) for i in range(150)]
    rows += [(3, i, 1, 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, tie bigint, label int, score double")
    found = {r["g"]: r for r in evaluation.point_metrics(df, groups=["g"]).collect()}
    for g in (0, 1, 2):
        check(found[g], reference_metrics([(y, s, 1.0) for h, _, y, s in rows if h == g]))
    assert found[3]["rows"] == 5 and found[3]["roc_auc"] is None and found[3]["base_rate"] == 1.0


def test_threshold(spark):
    rows = [(i % 2, s, 1.0) for i, s in enumerate([0.9, 0.8, 0.8, 0.8, 0.1, 0.1, 0.0, 0.0, 0.0, 0.0])]
    df = scored(spark, rows)
    for share, expected in ((0.1, 0.9), (0.11, 0.8), (0.4, 0.8), (0.5, 0.1), (1.0, 0.0)):
        assert evaluation.operating_threshold(df, share).first()["threshold"] == expected
    found = evaluation.threshold_metrics(df, 0.8).first()
    assert (found["share_selected"], found["precision"], found["recall"]) == (0.4, 0.5, 0.4)
    nothing = evaluation.threshold_metrics(df, 2.0).first()
    assert (nothing["share_selected"], nothing["precision"], nothing["recall"]) == (0.0, 0.0, 0.0)


def test_calibration_bins(spark):
    rows = [(int(i % 3 == 0), float(round(i / 50)), 1.0) for i in range(101)]
    table = evaluation.calibration_table(scored(spark, rows), 10).orderBy("bin").collect()
    assert [r["bin"] for r in table] == list(range(1, 11)) and sum(r["rows"] for r in table) == 101
    assert table[0]["rows"] == 11 and {r["rows"] for r in table[1:]} == {10}


def test_poisson_weights():
    """The fixed bounds are the cumulative Poisson(1) distribution."""
    total = 0.0
    for count, bound in enumerate(evaluation.POISSON_ONE):
        total += math.exp(-1) / math.factorial(count)
        assert bound == pytest.approx(total * 2**32, abs=2)


def test_bootstrap(spark):
    """Every resample recomputed by hand from its drawn weights."""
    import hashlib

    import numpy as np

    rng = random.Random(4)
    rows = [(c, int(rng.random() < 0.3), rng.randint(0, 20) / 20) for c in range(40) for _ in range(8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tie bigint, customer_id bigint, label int, score double")
    resamples = 30

    def weight(cluster, resample):
        digest = hashlib.md5(f"{cluster}|{resample // 4}|42".encode()).hexdigest()
        draw = int(digest[resample % 4 * 8 :][:8], 16)
        return next((w for w, bound in enumerate(evaluation.POISSON_ONE) if draw < bound), len(evaluation.POISSON_ONE))

    drawn = [
        reference_metrics([(y, s, float(weight(c, b))) for c, y, s in rows if weight(c, b)]) for b in range(resamples)
    ]
    found = {r["metric"]: r for r in evaluation.cluster_bootstrap(df, "customer_id", resamples, 42).collect()}
    assert len(found) == 7
    for name, row in found.items():
        values = [d[name] for d in drawn]
        assert row["lower"] == pytest.approx(np.percentile(values, 2.5), abs=1e-9), name
        assert row["upper"] == pytest.approx(np.percentile(values, 97.5), abs=1e-9), name
        assert row["resamples_skipped"] == 0 and row["resamples"] == resamples
    point = evaluation.point_metrics(df).first()
    assert found["roc_auc"]["estimate"] == point["roc_auc"]


def test_bootstrap_skips_single_class_resamples(spark):
    rows = [(0, 0, 1, 0.9)] + [(i, i, 0, 0.1) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "tie bigint, customer_id bigint, label int, score double")
    found = evaluation.cluster_bootstrap(df, "customer_id", 40, 42).filter("metric = 'roc_auc'").first()
    assert 0 < found["resamples_skipped"] < 40 and found["lower"] == 1.0

"""Questions that can be asked in two ways. Both ways give the same rows; they differ in cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import count_where
from panelmill.operators.events import flag_changes
from panelmill.schema import ENTITY, FLAG_PATTERN, PERIOD, flag_columns
from panelmill.session import cut_lineage


def _event_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("product_code").agg(
        count_where(F.col("delta") == 1).alias("adoptions"), count_where(F.col("delta") == -1).alias("attritions")
    )


def events_by_self_join(fact: DataFrame, pattern: str = FLAG_PATTERN) -> DataFrame:
    """Adoptions and attritions per product, each row joined to the same entity one period earlier."""
    flags = flag_columns(fact, pattern)
    now = fact.select(ENTITY, PERIOD, F.array(*flags).alias("held"))
    earlier = now.select(ENTITY, (F.col(PERIOD) + 1).alias(PERIOD), F.col("held").alias("before"))
    changed = now.join(earlier, [ENTITY, PERIOD]).filter(F.col("held") != F.col("before"))
    named = F.array(
        *[
            F.struct(
                F.lit(flag).alias("product_code"), (F.col("held")[i] - F.col("before")[i]).alias("delta")
            )
            for i, flag in enumerate(flags)
        ]
    )
    return _event_counts(changed.select(F.inline(named)).filter("delta <> 0"))


def events_by_window(fact: DataFrame, pattern: str = FLAG_PATTERN) -> DataFrame:
    """The same by one LAG pass."""
    return _event_counts(flag_changes(fact, pattern).filter("months_since_previous = 1"))


def _holders(rows: DataFrame, flag: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("customers"), F.sum(F.col(flag)).alias("holders"))


def snapshot_full_scan(rows: DataFrame, month_label: str, flag: str, date: str = "snapshot_date") -> DataFrame:
    """Holders of one flag in one month, filtered on a computed label after every column was stored."""
    return _holders(cut_lineage(rows).filter(F.date_format(date, "yyyy-MM") == month_label), flag)


def snapshot_pruned(partitioned: DataFrame, month_label: str, flag: str) -> DataFrame:
    """The same from a table partitioned by `month`: one folder and one column are read."""
    return _holders(partitioned.filter(F.col("month") == month_label), flag)


def entity_summary(fact: DataFrame) -> DataFrame:
    """One row per entity; worth storing when it is asked often."""
    return fact.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("months_present"),
        F.avg("n_products").alias("avg_products"),
        F.max("n_products").alias("max_products"),
        F.max("is_active").alias("ever_active"),
    )


def summary_by_breadth(entities: DataFrame) -> DataFrame:
    """Entities by most products ever held and whether ever active."""
    return entities.groupBy("max_products", "ever_active").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg("avg_products"), 6).alias("mean_avg_products"),
        F.round(F.avg("months_present"), 6).alias("mean_months_present"),
    )


def _distribution(running: DataFrame) -> DataFrame:
    return running.groupBy("active_months_so_far").agg(F.count(F.lit(1)).alias("customer_months"))


def running_active_by_range_join(fact: DataFrame) -> DataFrame:
    """Active periods so far, by joining every row to all earlier rows of its entity: n(n+1)/2 pairs for
    n periods. Kept to show the cost; `running_active_by_window` is the one to use."""
    active = F.coalesce(F.col("is_active"), F.lit(0)).cast("bigint")
    later = fact.select(ENTITY, PERIOD)
    earlier = fact.select(ENTITY, F.col(PERIOD).alias("_earlier"), active.alias("_active"))
    running = (
        later.join(earlier, ENTITY)
        .filter(F.col("_earlier") <= F.col(PERIOD))
        .groupBy(ENTITY, PERIOD)
        .agg(F.sum("_active").alias("active_months_so_far"))
    )
    return _distribution(running)


def running_active_by_window(fact: DataFrame) -> DataFrame:
    """The same by a cumulative frame: work linear in the rows."""
    so_far = Window.partitionBy(ENTITY).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    active = F.coalesce(F.col("is_active"), F.lit(0)).cast("bigint")
    return _distribution(fact.select(F.sum(active).over(so_far).alias("active_months_so_far")))


def _comparable(df: DataFrame, digits: int) -> DataFrame:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (
                F.round(F.col(name).cast("double"), digits)
                if kinds[name] in numeric or kinds[name].startswith("decimal")
                else F.col(name).cast("string")
            ).alias(name)
            for name in sorted(df.columns)
        ]
    )


def result_difference(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Rows that only one of the results has, as often as it has them more; empty when they agree.
    Numbers are compared as doubles rounded to `digits`, everything else as text."""
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(left.columns)} and {sorted(right.columns)}")
    one, other = _comparable(left, digits), _comparable(right, digits)
    return (
        one.exceptAll(other)
        .withColumn("only_in", F.lit("left"))
        .unionByName(other.exceptAll(one).withColumn("only_in", F.lit("right")))
    )


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row that two results share if they hold the same rows equally often, in any order: the number of rows and the
    sums of two independent hashes of them. Numbers count as in `result_difference`."""
    comparable = _comparable(df, digits)
    # a hash passes over NULLs, so which columns are NULL is hashed as well
    parts = [column for name in comparable.columns for column in (F.col(name), F.col(name).isNull())]
    one, other = F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
    return comparable.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0)).alias(name) for name, value in (("one", one), ("other", other))],
    )


def equivalence(results: Mapping[str, tuple[DataFrame, DataFrame]], digits: int = 6) -> DataFrame:
    """pair, rows of both forms, rows that only one of them has, and whether they agree.

    Both forms are read once for their fingerprint; rows are compared singly only where the fingerprints differ.
    """
    spark, found = next(iter(results.values()))[0].sparkSession, []
    for name, (left, right) in results.items():
        one, other = fingerprint(left, digits).first(), fingerprint(right, digits).first()
        differing = 0 if one == other else result_difference(left, right, digits).count()
        found.append((name, one["rows"], other["rows"], differing, one == other))
    return spark.createDataFrame(found, "pair string, rows_left bigint, rows_right bigint, rows_different bigint, equivalent boolean")


def timing_statistics(timings: DataFrame) -> DataFrame:
    """From recorded runs (pair, role, seconds) with roles baseline, candidate and build: the medians, the
    faster form, slower / faster, and after how many queries a build has paid for itself."""

    def median_of(role: str):
        return F.median(F.when(F.col("role") == role, F.col("seconds")))

    medians = timings.groupBy("pair").agg(
        *[median_of(role).alias(f"{role}_seconds") for role in ("baseline", "candidate", "build")]
    )
    slow = F.greatest("baseline_seconds", "candidate_seconds")
    fast = F.least("baseline_seconds", "candidate_seconds")
    saving = F.col("baseline_seconds") - F.col("candidate_seconds")
    return medians.select(
        "*",
        F.when(F.col("candidate_seconds") < F.col("baseline_seconds"), "candidate")
        .otherwise("baseline")
        .alias("faster"),
        F.try_divide(slow, fast).alias("ratio"),
        F.when(saving > 0, F.col("build_seconds") / saving).alias("break_even_queries"),
    )

"""Point-in-time features: every value of a row at t uses periods up to t, labels come from t + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import count_where, row_sum
from panelmill.functions.hashing import in_sample
from panelmill.schema import ENTITY, FLAG_PATTERN, PERIOD, Splits, flag_columns

ID_COLUMNS = ("customer_id", "feature_month", "label_month", "split")
LABEL_COLUMNS = ("holds_target_at_t", "adopts_target", "adopts_any")
SEGMENT_COLUMN = "held_target_before_t"
NUMERIC_FEATURES = (
    "n_products",
    "n_products_change_1m",
    "n_products_change_3m",
    "months_since_first_seen",
    "adoptions_last_3m",
    "attritions_last_3m",
    "active_months_last_3m",
    "seniority_months",
    "log_income",
)
BINARY_FEATURES = ("is_active", "is_new_customer", "income_missing")
CATEGORICAL_FEATURES = ("segment", "relation_type", "age_band", "sex", "channel")
SPLIT_NAMES = ("train", "validation", "test")


def split_of(period: Column, splits: Splits) -> Column:
    label = F.when(period.between(*splits.train), "train")
    label = label.when(period.between(*splits.validation), "validation")
    return label.when(period.between(*splits.test), "test")


def age_band(age: Column) -> Column:
    # Age bands.
    return (
        F.when(age.isNull(), "unknown")
        .when(age < 25, "under 25")
        .when(age < 35, "25-34")
        .when(age < 45, "35-44")
        .when(age < 55, "45-54")
        .when(age < 65, "55-64")
        .otherwise("65+")
    )


def log_income(income: Column) -> Column:
    """ln(1 + income); minus infinity at exactly -1, an error below it."""
    return (
        F.when(income == -1, F.lit(float("-inf")))
        .when(income < -1, F.raise_error(F.lit("income below -1 has no logarithm")).cast("double"))
        .otherwise(F.log1p(income))
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Adoptions and attritions per entity and period."""
    return events.groupBy(ENTITY, PERIOD).agg(
        count_where(F.col("event_type") == "adoption").alias("adoptions"),
        count_where(F.col("event_type") == "attrition").alias("attritions"),
    )


def panel_history(panel: DataFrame, target: str, pattern: str = FLAG_PATTERN) -> DataFrame:
    """Look-back and next-period columns of every row, from one exchange and one sort by entity and period.

    `_next_*` columns belong to the entity's next row; whether that row is period t + 1 is for the reader
    to check with `_next_period`.
    """
    flags = flag_columns(panel, pattern)
    place = flags.index(target)
    in_time = Window.partitionBy(ENTITY).orderBy(PERIOD)
    last_3 = in_time.rangeBetween(-2, 0)

    def one_back(periods: int):
        return in_time.rangeBetween(-periods, -periods)

    held = panel.withColumn("held", F.array(*flags)).drop(*flags)
    if "n_products" not in panel.columns:
        held = held.withColumn("n_products", row_sum([F.col("held")[i].cast("int") for i in range(len(flags))]))
    paired = held.select(
        "*",
        F.lag(PERIOD).over(in_time).alias("_previous_period"),
        F.lag("held").over(in_time).alias("_before"),
    )
    steps = [F.col("held")[i] - F.col("_before")[i] for i in range(len(flags))]
    changed = (F.col("_previous_period") == F.col(PERIOD) - 1) & (F.col("held") != F.col("_before"))

    def moved(matches) -> Column:
        """How many flags moved that way since the previous period; 0 after a gap."""
        return F.when(changed, row_sum([F.when(matches(step), 1).otherwise(0) for step in steps])).otherwise(0)

    counted = paired.select(
        "*",
        moved(lambda delta: delta == 1).alias("adoptions"),
        moved(lambda delta: (delta != 0) & (delta != 1)).alias("attritions"),
    ).drop("_before", "_previous_period")
    return counted.select(
        *[name for name in counted.columns if name != "held"],
        "held",
        F.col("held")[place].alias("target_flag"),
        F.lead(PERIOD).over(in_time).alias("_next_period"),
        F.lead(F.col("held")[place]).over(in_time).alias("_next_target"),
        F.lead("adoptions").over(in_time).alias("_next_adoptions"),
        F.first(PERIOD).over(in_time).alias("first_seen"),
        F.sum(F.coalesce(F.col("is_active"), F.lit(0)).cast("bigint")).over(last_3).alias("active_months_last_3m"),
        F.sum(F.col("adoptions").cast("bigint")).over(last_3).alias("adoptions_last_3m"),
        F.sum(F.col("attritions").cast("bigint")).over(last_3).alias("attritions_last_3m"),
        F.max("n_products").over(one_back(1)).alias("_products_1_ago"),
        F.max("n_products").over(one_back(3)).alias("_products_3_ago"),
        F.max((F.col("held")[place] == 1).cast("int"))
        .over(in_time.rangeBetween(Window.unboundedPreceding, -1))
        .alias("_held_before"),
    )


def feature_base(
    panel: DataFrame, target: str, splits: Splits, share: float = 1.0, pattern: str = FLAG_PATTERN
) -> DataFrame:
    """Sampled rows present at t and t + 1, with split and the target at both, all look-back columns kept.

    Sample and last period cut the rows before the exchange; both keep every row the windows look at.
    """
    needed = panel.filter((F.col(PERIOD) <= splits.test[1] + 1) & in_sample(F.col(ENTITY), share))
    history = panel_history(needed, target, pattern)
    return history.filter(
        F.col(PERIOD).between(splits.train[0], splits.test[1]) & (F.col("_next_period") == F.col(PERIOD) + 1)
    ).withColumn("split", split_of(F.col(PERIOD), splits))


def propensity_dataset(
    panel: DataFrame, target: str, splits: Splits, share: float = 1.0, pattern: str = FLAG_PATTERN
) -> DataFrame:
    """The feature table. `panel` is the staged panel, so no join is needed to reach its attributes."""
    flags = flag_columns(panel, pattern)
    base = feature_base(panel, target, splits, share, pattern)
    at_t, after = F.col("target_flag"), F.col("_next_target")
    unknown = F.lit("unknown")
    return base.select(
        F.col(ENTITY).alias("customer_id"),
        F.col(PERIOD).alias("feature_month"),
        F.col("_next_period").alias("label_month"),
        "split",
        at_t.alias("holds_target_at_t"),
        F.when((at_t == 0) & (after == 1), 1).otherwise(0).alias("adopts_target"),
        F.when(F.col("_next_adoptions") > 0, 1).otherwise(0).alias("adopts_any"),
        F.coalesce(F.col("_held_before"), F.lit(0)).alias("held_target_before_t"),
        *[F.col("held")[i].alias(flag) for i, flag in enumerate(flags) if flag != target],
        "n_products",
        (F.col("n_products") - F.col("_products_1_ago")).alias("n_products_change_1m"),
        (F.col("n_products") - F.col("_products_3_ago")).alias("n_products_change_3m"),
        (F.col(PERIOD) - F.col("first_seen")).alias("months_since_first_seen"),
        "adoptions_last_3m",
        "attritions_last_3m",
        "active_months_last_3m",
        "is_active",
        "seniority_months",
        "is_new_customer",
        F.coalesce(F.col("segment"), unknown).alias("segment"),
        F.coalesce(F.col("relation_type"), unknown).alias("relation_type"),
        age_band(F.col("age")).alias("age_band"),
        F.coalesce(F.col("sex"), unknown).alias("sex"),
        F.coalesce(F.col("channel"), unknown).alias("channel"),
        log_income(F.col("income")).alias("log_income"),
        F.col("income_missing").cast("tinyint").alias("income_missing"),
    )


def split_summary(dataset: DataFrame) -> DataFrame:
    """Rows, entities, population and positives per split."""
    return dataset.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("customer_id").alias("customers"),
        F.sum(1 - F.col("holds_target_at_t").cast("bigint")).alias("target_population"),
        F.sum(F.col("adopts_target").cast("bigint")).alias("target_adoptions"),
        F.sum(F.col("adopts_any").cast("bigint")).alias("any_adoptions"),
    )


def require_splits(summary: DataFrame) -> DataFrame:
    """Raise unless every split has rows."""
    found = {row["split"] for row in summary.select("split").collect()}  # at most one row per split
    missing = [name for name in SPLIT_NAMES if name not in found]
    if missing:
        raise ValueError(f"no rows for split {', '.join(missing)}")
    return summary


def target_rate(dataset: DataFrame, floor: float = 0.002) -> DataFrame:
    """Training base rate of the single-product target and which target it leads to."""
    population = dataset.filter("split = 'train' AND holds_target_at_t = 0")
    return population.agg(F.avg(F.col("adopts_target").cast("double")).alias("train_rate")).select(
        "train_rate", F.when(F.col("train_rate") >= floor, "product").otherwise("any").alias("target_mode")
    )


def model_rows(dataset: DataFrame, mode: str) -> DataFrame:
    """Rows and `label` of the chosen target. The product target leaves out rows that hold it already."""
    if mode == "product":
        return dataset.filter("holds_target_at_t = 0").withColumn("label", F.col("adopts_target"))
    if mode == "any":
        return dataset.withColumn("label", F.col("adopts_any"))
    raise ValueError(f"target mode must be product or any, got {mode!r}")


def population_summary(rows: DataFrame) -> DataFrame:
    """Rows, entities, positives and base rate of each split in the population of the chosen target (`model_rows`)."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("customer_id").alias("customers"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.avg(F.col("label").cast("double")).alias("base_rate"),
    )


#: rows of a panel whose features are compared in one task
_ROWS_A_TASK = 50_000


def leakage_difference(
    panel: DataFrame, scrambled: DataFrame, target: str, splits: Splits, cutoff: int, pattern: str = FLAG_PATTERN
) -> DataFrame:
    """Feature rows up to the cutoff that change when later periods change, as often as they do. Empty means no leakage.

    Both panels are dealt over as many tasks as their rows need, however well these compress, and each row is computed
    once. Counts the rows of the panel when called.
    """
    tasks = 1 + panel.count() // _ROWS_A_TASK

    def features(source: DataFrame, sign: int) -> DataFrame:
        rows = propensity_dataset(source.repartition(tasks, ENTITY), target, splits, pattern=pattern)
        return rows.filter(F.col("feature_month") <= cutoff).drop(*LABEL_COLUMNS[1:]).withColumn("_sign", F.lit(sign))

    both = features(panel, 1).unionByName(features(scrambled, -1))
    names = [name for name in both.columns if name != "_sign"]
    unequal = both.groupBy(*names).agg(F.sum("_sign").alias("_more")).filter("_more <> 0")
    return unequal.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_more")))).select(*names)


def scramble_after(panel: DataFrame, cutoff: int, pattern: str = FLAG_PATTERN) -> DataFrame:
    """Change flags, activity, segment, income and age of every period after the cutoff."""
    late = F.col(PERIOD) > cutoff
    changes: dict[str, Column] = {
        flag: F.when(late, (1 - F.col(flag)).cast("tinyint")).otherwise(F.col(flag))
        for flag in flag_columns(panel, pattern)
    }
    changes["is_active"] = F.when(late, (1 - F.coalesce(F.col("is_active"), F.lit(0))).cast("tinyint")).otherwise(
        F.col("is_active")
    )
    changes["segment"] = F.when(late, "scrambled").otherwise(F.col("segment"))
    changes["income"] = F.when(late, F.abs(F.coalesce(F.col("income"), F.lit(0.0))) * 10 + 1).otherwise(
        F.col("income")
    )
    changes["age"] = F.when(late, F.col("age") + 50).otherwise(F.col("age"))
    return panel.withColumns(changes)

"""Propensity model: preprocessing, candidates, baselines, selection, calibration, scoring.

Everything fitted is a handful of numbers per column; rows stay distributed. A fitted model is an MLlib
PipelineModel whose first stage is plain SQL, so it can be saved, loaded and applied to new rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import ratio
from panelmill.operators.evaluation import score_metrics
from panelmill.operators.features import BINARY_FEATURES, CATEGORICAL_FEATURES, NUMERIC_FEATURES
from panelmill.operators.newton import newton_logistic
from panelmill.operators.order_index import order_index
from panelmill.operators.ranking import running_totals
from panelmill.operators.shuffling import shuffled_place
from panelmill.operators.stumps import boosted_stumps
from panelmill.session import cut_lineage

OTHER = "other"


class Scorer(Protocol):
    """Anything that adds a `score` to rows and keeps their other columns."""

    def raw_scores(self, rows: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class FeatureColumns:
    flags: tuple[str, ...]
    numeric: tuple[str, ...] = NUMERIC_FEATURES
    binary: tuple[str, ...] = BINARY_FEATURES
    categorical: tuple[str, ...] = CATEGORICAL_FEATURES

    @property
    def zero_one(self) -> tuple[str, ...]:
        return (*self.flags, *self.binary)

    @property
    def all(self) -> list[str]:
        return [*self.flags, *self.numeric, *self.binary, *self.categorical]


def numeric_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated median and NULL rows of every numeric column.

    Values are counted per column first and the counts are summed in order over slices, so a column with as many
    values as rows stays spread. Stores the counts when called.
    """
    values = train.select(*[F.col(name).cast("double").alias(name) for name in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    nulls = values.groupBy("column_name").agg((F.count(F.lit(1)) - F.count("value")).alias("null_rows"))
    counted = values.filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_rows"))
    summed = running_totals(counted, [F.col("value")], {"rows": F.col("_rows")}, ["column_name"])
    # The middle rows are numbers floor((n + 1) / 2) and floor(n / 2) + 1.
    first, last = F.col("rows_running") - F.col("_rows") + 1, F.col("rows_running")
    middles = F.array(F.floor((F.col("rows_total") + 1) / 2), F.floor(F.col("rows_total") / 2) + 1)
    medians = (
        summed.withColumn("_hits", F.size(F.filter(middles, lambda place: (place >= first) & (place <= last))))
        .filter("_hits > 0")
        .groupBy("column_name")
        .agg((F.sum(F.col("value") * F.col("_hits")) / 2).alias("median"))
    )
    return nulls.join(medians, "column_name", "left").select("column_name", "median", "null_rows")


def binary_modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of every 0/1 column, the smaller one of a tie."""
    return (
        train.select(*[F.col(name).cast("double").alias(name) for name in columns])
        .unpivot([], list(columns), "column_name", "value")
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy("column_name")
        .agg(F.max_by("value", F.struct("_rows", -F.col("value"))).alias("mode"))
    )


def top_levels(train: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The most frequent levels of every categorical column; of levels as frequent the later name stays.

    Up to `top` + 1 levels are all kept. Beyond that the rest shares one bucket, marked by a level NULL.
    """
    counted = (
        train.select(*[F.col(name).cast("string").alias(name) for name in columns])
        .unpivot([], list(columns), "column_name", "level")
        .groupBy("column_name", "level")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # Only the first places of each column are needed, so tasks drop the others before they meet.
    order = Window.partitionBy("column_name").orderBy(F.desc("rows"), F.desc("level"))
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top + 1)
    levels = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("levels"))
    kept = best.join(F.broadcast(levels), "column_name").filter(
        (F.col("levels") <= top + 1) | (F.col("place") <= top)
    ).select(F.col("column_name").alias("_column"), F.col("level").alias("_level"), F.lit(True).alias("_kept"))
    # At most `top` + 1 rows for each column.
    marked = counted.join(
        F.broadcast(kept), (F.col("column_name") == F.col("_column")) & F.col("level").eqNullSafe(F.col("_level")), "left"
    )
    return (
        marked.select("column_name", F.when(F.col("_kept"), F.col("level")).alias("level"), "rows")
        .groupBy("column_name", "level")
        .agg(F.sum("rows").alias("rows"))
    )


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mean_and_deviation(rows: DataFrame, plain: Mapping[str, str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every expression, to the last digit the same in whatever order tasks end.

    A sum of doubles depends on that order, a sum of decimals does not. Values are divided by a power of two near the
    largest, and squared deviations by one near the largest square, so 25 digits serve columns of any size.
    """
    if not plain:
        return {}
    values = rows.select(*[F.expr(sql).alias(name) for name, sql in plain.items()])

    def exponents(sizes: Mapping[str, Column]) -> dict[str, float]:
        found = values.agg(*[F.max(F.abs(size)).alias(name) for name, size in sizes.items()]).first()
        if not all(math.isfinite(found[name] or 0.0) for name in sizes):
            raise ValueError(f"not finite: {', '.join(name for name in sizes if not math.isfinite(found[name] or 0.0))}")
        return {name: math.ldexp(1.0, math.frexp(found[name] or 0.0)[1] - 1) for name in sizes}

    def averages(terms: Mapping[str, Column]) -> dict[str, float]:
        sums = [F.sum(term.cast("decimal(28,25)")).alias(name) for name, term in terms.items()]
        found = values.agg(F.count(F.lit(1)).alias("|rows"), *sums).first()
        return {name: float((found[name] or 0) / max(1, found["|rows"])) for name in terms}

    column = {name: F.col(f"`{name}`") for name in plain}
    unit = exponents(column)
    mean = {name: value * unit[name] for name, value in averages({name: column[name] / unit[name] for name in plain}).items()}
    away = {name: column[name] - mean[name] for name in plain}
    unit = exponents(away)
    square = averages({name: (away[name] / unit[name]) * (away[name] / unit[name]) for name in plain})
    return {name: (mean[name], math.sqrt(square[name]) * unit[name]) for name in plain}


def fit_preprocess(train: DataFrame, columns: FeatureColumns, top: int = 10) -> tuple[list, list[str]]:
    """Stages that turn rows into `features`, fitted on training rows only, and the feature names.

    Numeric: median fill, a missing indicator where training rows lack values, standardised. 0/1 columns:
    mode fill. Categories: one column per kept level, and one for the shared bucket if there is one.
    """
    medians, modes = {}, {}
    levels: dict[str, list[str | None]] = {name: [] for name in columns.categorical}
    if columns.numeric:
        medians = {row["column_name"]: row for row in numeric_medians(train, columns.numeric).collect()}
    if columns.zero_one:
        modes = {row["column_name"]: row["mode"] for row in binary_modes(train, columns.zero_one).collect()}
    if columns.categorical:
        for row in top_levels(train, columns.categorical, top).orderBy("column_name", "level").collect():
            levels[row["column_name"]].append(row["level"])

    plain: dict[str, str] = {}
    for name in columns.numeric:
        fill = medians[name]["median"]
        plain[name] = f"coalesce(CAST(`{name}` AS DOUBLE), {0.0 if fill is None else fill!r}D)"
    for name in columns.numeric:
        if medians[name]["null_rows"]:
            plain[f"{name}_missing"] = f"CAST(`{name}` IS NULL AS DOUBLE)"
    spread = _mean_and_deviation(train, plain)
    scaled = {name: f"({sql} - {spread[name][0]!r}D) / {(spread[name][1] or 1.0)!r}D" for name, sql in plain.items()}
    for name in columns.zero_one:
        scaled[name] = f"coalesce(CAST(`{name}` AS DOUBLE), {modes.get(name, 0.0)!r}D)"
    for name in columns.categorical:
        known = [level for level in levels[name] if level is not None]
        for level in known:
            scaled[f"{name}={level}"] = f"CAST(coalesce(`{name}` = {_literal(level)}, false) AS DOUBLE)"
        if len(known) < len(levels[name]):
            listed = ", ".join(_literal(level) for level in known)
            scaled[f"{name}={OTHER} levels"] = f"CAST(coalesce(`{name}` NOT IN ({listed}), true) AS DOUBLE)"

    names = list(scaled)
    inputs = [f"_x{place}" for place in range(len(names))]
    select = ", ".join(f"{sql} AS {slot}" for sql, slot in zip(scaled.values(), inputs, strict=True))
    kept = "* EXCEPT (" + ", ".join(inputs) + ")"
    stages = [
        SQLTransformer(statement=f"SELECT *, {select} FROM __THIS__"),
        VectorAssembler(inputCols=inputs, outputCol="features"),
        SQLTransformer(statement=f"SELECT {kept} FROM __THIS__"),
    ]
    return stages, names


def class_weights(train: DataFrame) -> DataFrame:
    """Rows per class and negatives per positive; NULL where a class is missing."""
    positives = F.sum(F.col("label").cast("bigint"))
    return train.agg(F.count(F.lit(1)).alias("rows"), positives.alias("positives")).select(
        "rows",
        "positives",
        (F.col("rows") - F.col("positives")).alias("negatives"),
        ratio(F.col("rows") - F.col("positives"), F.col("positives")).alias("positive_weight"),
    )


def _both_classes(rows: DataFrame, name: str):
    counts = class_weights(rows).first()
    if not counts["rows"] or not counts["positives"] or not counts["negatives"]:
        raise ValueError(f"the {name} rows have one class only; a model can neither be fitted nor evaluated")
    return counts


@dataclass(frozen=True)
class FittedModel:
    """`coefficients` belong to `feature_names`; models that are not linear have none."""

    name: str
    pipeline: PipelineModel
    feature_names: list[str]
    coefficients: list[float] | None = None

    def raw_scores(self, rows: DataFrame) -> DataFrame:
        """Rows with the probability of the positive class as `score`."""
        scored = self.pipeline.transform(rows)
        if "probability" in scored.columns:
            scored = scored.withColumn("score", vector_to_array("probability")[1])
        return scored.drop("features", "rawPrediction", "probability", "prediction")


def _sigmoid_stage(raw: str, slope: float, intercept: float) -> SQLTransformer:
    margin = f"({slope!r}D * {raw} + {intercept!r}D)"
    return SQLTransformer(statement=f"SELECT * EXCEPT ({raw}), 1D / (1D + exp(-{margin})) AS score FROM __THIS__")


def fit_logistic(
    train: DataFrame, columns: FeatureColumns, top: int = 10, max_iter: int = 50, inverse_penalty: float = 1.0
) -> FittedModel:
    """Class-balanced logistic regression with an L2 penalty of 1 / (C n), by distributed Newton steps.

    The fitted pipeline is plain SQL: inputs, log-odds, score. Stores the prepared training rows.
    """
    counts = _both_classes(train, "training")
    stages, names = fit_preprocess(train, columns, top)
    n, positives = counts["rows"], counts["positives"]
    weight = F.when(F.col("label") == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))
    prepared = PipelineModel(stages).transform(train)
    rows = cut_lineage(
        prepared.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"))
    )
    coefficients, intercept = newton_logistic(rows, len(names), 1.0 / inverse_penalty, max_iter)
    inputs = [f"_x{place}" for place in range(len(names))]
    margin = " + ".join([f"{intercept!r}D", *[f"{value!r}D * {name}" for value, name in zip(coefficients, inputs, strict=True)]])
    odds = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(inputs)}), {margin} AS _margin FROM __THIS__")
    pipeline = PipelineModel([stages[0], odds, _sigmoid_stage("_margin", 1.0, 0.0)])
    return FittedModel("logistic_regression", pipeline, names, coefficients)


#: training rows of the boosted trees in one partition
_TREE_ROWS = 50_000


def _settled(rows: DataFrame, count: int) -> DataFrame:
    """The `count` rows in partitions and in an order that follow from `features`, `label` and `count` alone.

    MLlib draws rows and split candidates partition by partition, row after row. Equal rows may change places; the
    number that tells them apart only lets large groups of them be split. Stores the rows when called.
    """
    numbered = cut_lineage(rows.withColumn("_copy", F.monotonically_increasing_id()))
    ranked = order_index(numbered, [vector_to_array("features"), F.col("label"), F.col("_copy")]).ranked()
    slices = 1 + (count - 1) // _TREE_ROWS
    dealt = ranked.repartitionById(slices, F.pmod("position", F.lit(slices)).cast("int"))
    return dealt.sortWithinPartitions("position").select(*rows.columns)


def fit_boosted_trees(
    train: DataFrame,
    columns: FeatureColumns,
    top: int = 10,
    trees: int = 300,
    depth: int = 4,
    learning_rate: float = 0.05,
    subsample: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
) -> FittedModel:
    """Gradient-boosted trees with the positives weighted by negatives / positives.

    The same rows give the same draws, however they are partitioned. Stores the prepared training rows."""
    counts = _both_classes(train, "training")
    stages, names = fit_preprocess(train, columns, top)
    weight = F.when(F.col("label") == 1, counts["positive_weight"]).otherwise(1.0)
    prepared = PipelineModel(stages).transform(train.withColumn("_w", weight))
    rows = prepared.select("features", F.col("label").cast("double").alias("label"), "_w")
    model = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="_w",
        maxIter=trees,
        maxDepth=depth,
        stepSize=learning_rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(column_share),
        seed=seed,
    ).fit(_settled(rows, counts["rows"]))
    return FittedModel("boosted_trees", PipelineModel([*stages, model]), names)


def fit_boosted_stumps(
    train: DataFrame, columns: FeatureColumns, top: int = 10, rounds: int = 100, learning_rate: float = 0.3, penalty: float = 1.0
) -> FittedModel:
    """Boosted trees of one split with the positives weighted by negatives / positives, by second-order gains.

    The fitted pipeline is plain SQL, as that of the logistic regression. Stores the prepared training rows."""
    counts = _both_classes(train, "training")
    stages, names = fit_preprocess(train, columns, top)
    weight = F.when(F.col("label") == 1, counts["positive_weight"]).otherwise(1.0)
    prepared = PipelineModel(stages).transform(train)
    rows = cut_lineage(
        prepared.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"))
    )
    found = boosted_stumps(rows, names, rounds, learning_rate, penalty)
    inputs = [f"_x{place}" for place in range(len(names))]
    margin = " + ".join(["0D", *[stump.sql(inputs[stump.place]) for stump in found]])
    odds = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(inputs)}), {margin} AS _margin FROM __THIS__")
    return FittedModel("boosted_stumps", PipelineModel([stages[0], odds, _sigmoid_stage("_margin", 1.0, 0.0)]), names)


def rule_score(payroll_flag: str, min_products: int = 3) -> Column:
    """1 for an active holder of the payroll product with enough products, else 0."""
    rule = (F.col("is_active") == 1) & (F.col(payroll_flag) == 1) & (F.col("n_products") >= min_products)
    return F.when(rule, 1.0).otherwise(0.0)


def rule_baseline(rows: DataFrame, payroll_flag: str, min_products: int = 3) -> DataFrame:
    return rows.withColumn("score", rule_score(payroll_flag, min_products))


def constant_baseline(rows: DataFrame) -> DataFrame:
    """Every row scored with the base rate."""
    rate = rows.agg(F.avg(F.col("label").cast("double"))).scalar()
    return rows.withColumn("score", rate)


def candidate_metrics(scored: Mapping[str, DataFrame]) -> DataFrame:
    """Ranking metrics of several scorings of the same rows, one row per name."""
    tagged = [
        rows.select(F.lit(name).alias("candidate"), F.col("label"), F.col("score").cast("double").alias("score"))
        for name, rows in scored.items()
    ]
    together = tagged[0]
    for part in tagged[1:]:
        together = together.unionByName(part)
    return score_metrics(together, ["candidate"])


def baseline_metrics(rows: DataFrame, payroll_flag: str | None, min_products: int = 3) -> DataFrame:
    """The metrics of the base rate and, with a payroll flag, of the rule, and the share of rows that the rule selects.

    The rule says yes or no, which is no probability, so it has no Brier score."""
    found = {"base_rate": constant_baseline(rows)}
    if payroll_flag is not None:
        found["rule"] = rule_baseline(rows, payroll_flag, min_products)
    metrics = candidate_metrics(found)
    is_rule = F.col("candidate") == "rule"
    score = rule_score(payroll_flag, min_products) if payroll_flag is not None else F.lit(None).cast("double")
    selected = rows.agg(F.avg(score).alias("_share"))
    return metrics.join(F.broadcast(selected)).select(
        *[name for name in metrics.columns if name != "brier"],
        F.when(~is_rule, F.col("brier")).alias("brier"),
        F.when(is_rule, F.col("_share")).alias("share_selected"),
    )


def against_baselines(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row: the selected candidate, the best baseline, and whether the candidate's average precision is above it."""
    chosen = select_model(metrics).select(F.col("candidate").alias("selected"), F.col("pr_auc").alias("selected_pr_auc"))
    best = baselines.agg(
        F.max_by("candidate", F.struct("pr_auc", "candidate")).alias("best_baseline"), F.max("pr_auc").alias("baseline_pr_auc")
    )
    return chosen.join(F.broadcast(best)).withColumn("beats_baselines", F.col("selected_pr_auc") > F.col("baseline_pr_auc"))


def select_model(metrics: DataFrame) -> DataFrame:
    """Highest average precision, of equal ones the later name."""
    return metrics.orderBy(F.desc("pr_auc"), F.desc("candidate")).limit(1)


def fit_calibration(model: FittedModel, validation: DataFrame) -> FittedModel:
    """Sigmoid calibration of a frozen model: a one-feature logistic regression of smoothed targets without penalty."""
    counts = _both_classes(validation, "validation")
    high = (counts["positives"] + 1.0) / (counts["positives"] + 2.0)
    low = 1.0 / (counts["negatives"] + 2.0)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    name, names = f"{model.name}_calibrated", model.feature_names
    if isinstance(model.pipeline.stages[-1], SQLTransformer):
        # These models are calibrated on their log-odds, which their last stage turns into the score.
        before = PipelineModel(model.pipeline.stages[:-1])
        rows = before.transform(validation).select(F.array("_margin").alias("x"), target.alias("y"), F.lit(1.0).alias("w"))
        (slope,), intercept = newton_logistic(cut_lineage(rows), 1)
        stages = [*before.stages, _sigmoid_stage("_margin", slope, intercept)]
        return FittedModel(name, PipelineModel(stages), names, model.coefficients)
    # Trees are calibrated on their probability, a vector.
    one_value = VectorSlicer(inputCol="probability", outputCol="_raw", indices=[1])
    rename = SQLTransformer(
        statement="SELECT * EXCEPT (features, rawPrediction, probability, prediction) FROM __THIS__"
    )
    before = PipelineModel([*model.pipeline.stages, one_value, rename])
    doubled = before.transform(validation).select(
        "_raw",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("_y"), target.alias("_w")),
                F.struct(F.lit(0.0).alias("_y"), (1 - target).alias("_w")),
            )
        ),
    )
    sigmoid = LogisticRegression(
        featuresCol="_raw", labelCol="_y", weightCol="_w", regParam=0.0, maxIter=200, tol=1e-10
    ).fit(doubled)
    tidy = SQLTransformer(statement="SELECT * EXCEPT (_raw) FROM __THIS__")
    return FittedModel(name, PipelineModel([*before.stages, sigmoid, tidy]), names)


def calibration_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """Brier score before and after."""
    error = (F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))
    parts = [
        rows.agg(F.avg(error).alias("brier")).select(F.lit(name).alias("scores"), "brier")
        for name, rows in (("before", before), ("after", after))
    ]
    return parts[0].unionByName(parts[1])


def save_model(model: FittedModel, path: str) -> None:
    model.pipeline.write().save(f"{path}/pipeline")
    spark = SparkSession.active()
    values = model.coefficients or [None] * len(model.feature_names)
    spark.createDataFrame(
        [(model.name, place, *pair) for place, pair in enumerate(zip(model.feature_names, values, strict=True))],
        "model string, place int, feature string, coefficient double",
    ).coalesce(1).write.parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()  # one row per feature
    values = [row["coefficient"] for row in rows]
    linear = values if values and None not in values else None
    return FittedModel(rows[0]["model"], PipelineModel.load(f"{path}/pipeline"), [row["feature"] for row in rows], linear)


def odds_ratios(model: FittedModel, top: int = 15) -> DataFrame:
    """The largest coefficients of a linear model as odds ratios."""
    if model.coefficients is None:
        raise ValueError(f"{model.name} has no coefficients")
    rows = list(zip(model.feature_names, model.coefficients, strict=True))
    table = SparkSession.active().createDataFrame(rows, "feature string, log_odds double")
    return (
        table.withColumn("odds_ratio", F.exp("log_odds")).orderBy(F.desc(F.abs("log_odds")), "feature").limit(top)
    )


def _with_donors(placed: DataFrame, columns: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Each row with the values it gets in every repeat, as `_own` and `_given` (an array over the repeats).

    A row sends its values to the place that a keyed shuffle names, so one exchange by place brings all of a row's
    donors together: 1 + repeats rows a place.
    """
    values = F.struct(*columns)
    place, count = F.col("position") - 1, F.col("position_count")
    targets = F.array(
        F.struct(F.lit(-1).alias("to"), place.alias("at")),
        *[
            F.struct(F.lit(repeat).alias("to"), shuffled_place(place, count, seed, repeat).alias("at"))
            for repeat in range(repeats)
        ],
    )
    sent = placed.select("label", values.alias("_values"), F.explode(targets).alias("_target"))

    def of(repeat: int, value: str) -> Column:
        return F.max(F.when(F.col("_target.to") == repeat, F.col(value)))

    return sent.groupBy(F.col("_target.at").alias("_place")).agg(
        of(-1, "label").alias("label"), of(-1, "_values").alias("_own"), F.array(*[of(r, "_values") for r in range(repeats)]).alias("_given")
    )


def permutation_importance(
    model: Scorer,
    rows: DataFrame,
    columns: Sequence[str],
    tie: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Drop in average precision when one input column is shuffled, mean and deviation over the repeats.

    Uses every row. `tie` identifies a row and orders the rows once; a repeat is one keyed shuffle of the places, the
    same for each column, which every row computes by itself. The variants of a row (one for each column and repeat)
    are scored where the row is and leave nothing but score and label. Stores the numbered rows when called.
    """
    index = order_index(rows.select("label", *tie, *[name for name in columns if name not in tie]), [F.col(name) for name in tie])
    donors = _with_donors(index.ranked(), columns, repeats, seed)
    # variant -1 is the row as it is, variant v the column v div repeats in the repeat v mod repeats
    variant = F.explode(F.sequence(F.lit(-1), F.lit(len(columns) * repeats - 1))).alias("_variant")
    column, repeat = F.floor(F.col("_variant") / repeats), F.pmod("_variant", F.lit(repeats))
    disturbed = donors.select("label", "_own", "_given", variant).select(
        "label",
        F.coalesce(F.get(F.array(*[F.lit(name) for name in columns]), column.cast("int")), F.lit("")).alias("column_name"),
        repeat.alias("repeat"),
        *[
            F.when(column == at, F.get("_given", repeat)[name]).otherwise(F.col("_own")[name]).alias(name)
            for at, name in enumerate(columns)
        ],
    )
    scored = model.raw_scores(disturbed).select("column_name", "repeat", "label", "score")
    quality = score_metrics(scored, ["column_name", "repeat"]).select("column_name", "repeat", "pr_auc")
    undisturbed = quality.filter("column_name = ''").select(F.col("pr_auc")).scalar()
    return (
        quality.filter("column_name <> ''")
        .withColumn("_drop", undisturbed - F.col("pr_auc"))
        .groupBy(F.col("column_name").alias("feature"))
        .agg(F.avg("_drop").alias("pr_auc_drop_mean"), F.stddev_pop("_drop").alias("pr_auc_drop_std"))
        .orderBy(F.desc("pr_auc_drop_mean"), "feature")
    )

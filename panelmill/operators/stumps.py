"""Boosted trees of one split, whose search is an aggregate that any SQL engine can repeat.

For each value of each column the first and second derivatives of the log-loss are summed, running totals of these
sums give both sides of every possible split, and the best one becomes the next stump. Sums are decimals: columns
that part the rows alike then have exactly the same gain, and the tie is decided by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.ranking import running_totals


@dataclass(frozen=True)
class Stump:
    """Rows with `place` up to `threshold` get `low` added to their log-odds, the others `high`."""

    place: int
    threshold: float
    low: float
    high: float

    def sql(self, value: str) -> str:
        return f"CASE WHEN {value} <= {self.threshold!r}D THEN {self.low!r}D ELSE {self.high!r}D END"


def best_split(rows: DataFrame, names: Sequence[str], margin: Column, penalty: float) -> DataFrame:
    """No row or one: place, threshold, gain, and the value of both leaves, for rows with x (array), y and w.

    A column with as many values as rows stays spread. Stores the sums when called.
    """
    chance = 1 / (1 + F.exp(-margin))
    slope, bend = F.col("w") * (chance - F.col("y")), F.col("w") * chance * (1 - chance)
    exact = [value.cast("decimal(38,12)").alias(name) for name, value in (("g", slope), ("h", bend))]
    sums = (
        rows.select("x", *exact).select(F.posexplode("x").alias("place", "value"), "g", "h")
        .groupBy("place", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )
    summed = running_totals(sums, [F.col("value")], {"g": F.col("g"), "h": F.col("h"), "n": F.lit(1)}, ["place"])
    sides = {
        "low": [F.col(f"{name}_running").cast("double") for name in "gh"],
        "high": [(F.col(f"{name}_total") - F.col(f"{name}_running")).cast("double") for name in "gh"],
        "all": [F.col(f"{name}_total").cast("double") for name in "gh"],
    }
    worth = {side: g * g / (h + penalty) for side, (g, h) in sides.items()}
    leaf = {side: -g / (h + penalty) for side, (g, h) in sides.items()}
    splits = summed.where(F.col("n_running") < F.col("n_total")).select(
        "place", F.col("value").alias("threshold"), (worth["low"] + worth["high"] - worth["all"]).alias("gain"),
        leaf["low"].alias("low"), leaf["high"].alias("high"), F.get(F.array(*[F.lit(name) for name in names]), F.col("place")).alias("name"),
    )
    return splits.orderBy(F.desc("gain"), "name", "threshold").limit(1).drop("name")


def boosted_stumps(rows: DataFrame, names: Sequence[str], rounds: int, learning_rate: float, penalty: float) -> list[Stump]:
    """Stumps of rows with x (array of doubles, one for each name), y (0 or 1) and w. Ends early where no column has two
    values. Log-odds start at 0, and are computed anew from the stumps found, so nothing is stored for a row."""
    found: list[Stump] = []
    for _ in range(rounds):
        margin = F.lit(0.0)
        for stump in found:
            margin = margin + F.when(F.col("x")[stump.place] <= stump.threshold, stump.low).otherwise(stump.high)
        best = best_split(rows, names, margin, penalty).first()
        if best is None:
            break
        found.append(Stump(best["place"], best["threshold"], learning_rate * best["low"], learning_rate * best["high"]))
    return found

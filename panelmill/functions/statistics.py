"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the 97.5% point of the standard normal distribution.
Z_95 = 1.959963984540054


def wilson_bounds(successes: Column, trials: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; NULL without trials."""
    n = trials.cast("double")
    rate = F.when(n > 0, successes.cast("double") / n)
    shrink = 1 + z * z / n
    centre = (rate + z * z / (2 * n)) / shrink
    spread = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / shrink
    # At a rate of 0 or 1 the bound on that side is exact; rounding must not move it.
    lower = F.when(trials > 0, F.when(successes <= 0, 0.0).otherwise(centre - spread))
    upper = F.when(trials > 0, F.when(successes >= trials, 1.0).otherwise(centre + spread))
    return lower, upper


def with_wilson(df: DataFrame, successes: str, trials: str, rate: str) -> DataFrame:
    """Put `<rate>_ci_lower` and `<rate>_ci_upper` right behind the rate column."""
    lower, upper = wilson_bounds(F.col(successes), F.col(trials))
    out: list[Column] = []
    for name in df.columns:
        out.append(F.col(name))
        if name == rate:
            out += [lower.alias(f"{rate}_ci_lower"), upper.alias(f"{rate}_ci_upper")]
    return df.select(*out)

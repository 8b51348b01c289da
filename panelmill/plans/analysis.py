"""The analysis stage: every result of a warehouse, with intervals where a result is a rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.statistics import with_wilson
from panelmill.operators import events, journeys, portfolio
from panelmill.plans.star_schema import Warehouse
from panelmill.schema import Catalogue

# Result -> (successes, trials, rate), for results that get a Wilson interval.
RATES = {
    "penetration": ("holders", "customers", "penetration"),
    "ladder_funnel": ("reached", "previous_reached", "conversion_rate"),
    "cohort_retention": ("retained", "cohort_size", "retention_rate"),
    "engagement": ("active", "customers", "engagement_rate"),
}
# Breakdowns in the order they are shown.
DIMENSIONS = {
    "ladder_funnel": ("all", "segment", "channel"),
    "engagement": ("month", "segment", "tenure_band", "products_held"),
}
# Sort columns of the files: -name falls, @name follows the catalogue or the order of the breakdowns.
ORDER = {
    "event_summary": ("month_label", "@product_code"),
    "penetration": ("month_label", "@product_code"),
    "transitions": ("-transitions", "from_product", "to_product"),
    "top_transitions": ("-transitions", "from_product", "to_product"),
    "ladder_funnel": ("@dimension", "group_value", "step"),
    "time_to_next": ("months_to_first_adoption",),
    "cohort_retention": ("join_month", "months_since_join"),
    "engagement": ("@dimension", "group_value"),
    "events_by_product": ("-first_adoptions", "product_name"),
    "ladder_proposal": ("step",),
    "cohort_matrix": ("join_month",),
    "value_proxy": ("income_band", "activity", "families_held"),
}


def analyse(w: Warehouse, top_channels: int = 10) -> dict[str, DataFrame]:
    """All results by name, derived ones included. The funnel is left out while the catalogue has no ladder.

    Event results start from the stored changes, results of single periods from the fact's period folders, where the
    warehouse has them. Ranking the incomes and proposing a ladder run when this is called.
    """
    changes = events.flag_changes(w.fact) if w.changes is None else w.changes
    by_month = w.fact if w.by_month is None else w.by_month
    happened = events.product_events(changes)
    results = {
        "event_summary": events.event_summary(changes, w.periods, w.catalogue),
        "penetration": portfolio.penetration(by_month, w.periods, w.catalogue),
        "transitions": journeys.transitions(happened, w.catalogue),
        "ladder_funnel": journeys.ladder_funnel(w.fact, w.entities, w.catalogue, top_channels),
        "time_to_next": journeys.time_to_next(happened, w.entities),
        "cohort_retention": journeys.cohort_retention(w.fact, w.entities, w.periods, w.first_month),
        "engagement": portfolio.engagement(by_month, w.periods),
        "value_proxy": portfolio.value_proxy(by_month, w.entities, w.periods, w.catalogue),
    }
    results |= {
        "events_by_product": events.events_by_product(results["event_summary"]),
        "penetration_latest": portfolio.penetration_latest(results["penetration"]),
        "top_transitions": journeys.top_transitions(results["transitions"]),
        "ladder_proposal": journeys.ladder_proposal(results["penetration"], results["transitions"]),
        "adopter_share": journeys.adopter_share(results["time_to_next"]),
        "cohort_matrix": journeys.cohort_matrix(results["cohort_retention"]),
        "value_by_dimension": portfolio.value_by_dimension(results["value_proxy"]),
        "engagement_trend_ends": portfolio.engagement_trend_ends(results["engagement"]),
    }
    return {
        name: with_wilson(result, *RATES[name]) if name in RATES else result
        for name, result in results.items()
        if result is not None
    }


def write_csv(name: str, result: DataFrame, folder: str, catalogue: Catalogue | None = None) -> None:
    """One ordered CSV file per result, numbers with six decimals. Results are report-sized.

    Products follow the catalogue if one is given, and their codes otherwise.
    """
    shown = [
        f"if(`{column}` IS NULL, NULL, format_string('%.6f', `{column}`)) AS `{column}`" if kind == "double" else f"`{column}`"
        for column, kind in result.dtypes
    ]
    products = [] if catalogue is None else [product.code for product in catalogue.products]

    def key(sort: str) -> list[Column]:
        column = F.col(sort.lstrip("-@"))
        if sort.startswith("@"):
            listed = [F.lit(value) for value in (products if sort == "@product_code" else DIMENSIONS.get(name, ()))]
            return [F.array_position(F.array(*listed), column), column] if listed else [column]
        return [column.desc() if sort.startswith("-") else column]

    order = [part for sort in ORDER.get(name, result.columns) for part in key(sort)]
    ordered = result.orderBy(*order).selectExpr(*shown)
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

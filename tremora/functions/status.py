"""Status by thresholds: ratios to history, depth differences, confidence by length of history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RatioThresholds:
    very_quiet: float
    quiet: float
    normal: float
    elevated: float

    def __post_init__(self) -> None:
        if not 0 < self.very_quiet < self.quiet < self.normal < self.elevated:
            raise ValueError("ratio thresholds must be positive and ascending")


#: Thresholds of each metric, days of history by confidence, and the order of severity.
ACTIVITY = RatioThresholds(0.5, 0.8, 1.2, 1.75)
ENERGY = RatioThresholds(0.4, 0.75, 1.35, 2.5)
DEPTH_KM = (5.0, 15.0)
CONFIDENCE = ((30, "Very Low"), (180, "Low"), (730, "Moderate"))
SEVERITY = {"unavailable": -1, "very_quiet": 0, "quiet": 1, "normal": 2, "elevated": 3, "exceptional": 4}


def ratio_status(ratio: Column, t: RatioThresholds) -> Column:
    """Below the first two thresholds strictly, up to the others inclusively."""
    return (
        F.when(ratio.isNull(), "unavailable")
        .when(ratio < t.very_quiet, "very_quiet")
        .when(ratio < t.quiet, "quiet")
        .when(ratio <= t.normal, "normal")
        .when(ratio <= t.elevated, "elevated")
        .otherwise("exceptional")
    )


def change_text(ratio: Column) -> Column:
    """Like +12.5% of change from history."""
    return F.format_string("%+.1f%%", (ratio - 1) * 100)


def depth_status(difference: Column) -> Column:
    return (
        F.when(difference.isNull(), "unavailable")
        .when(F.abs(difference) <= DEPTH_KM[0], "normal")
        .when(F.abs(difference) <= DEPTH_KM[1], "elevated")
        .otherwise("exceptional")
    )


def confidence(history_days: Column) -> Column:
    chain = F.when(history_days < CONFIDENCE[0][0], CONFIDENCE[0][1])
    for days, name in CONFIDENCE[1:]:
        chain = chain.when(history_days < days, name)
    return chain.otherwise("High")


def overall(*statuses: Column) -> Column:
    """The most severe of the statuses."""
    ranks = F.create_map(*(F.lit(x) for item in SEVERITY.items() for x in item))
    names = F.create_map(*(F.lit(x) for name, rank in SEVERITY.items() for x in (rank, name)))
    return F.element_at(names, F.array_max(F.array(*(F.element_at(ranks, s) for s in statuses))))

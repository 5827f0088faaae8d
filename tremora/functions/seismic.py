"""Column functions on magnitudes, energies and depths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the counted magnitudes, bands and depth classes, moment-magnitude types.
MAGNITUDE_STEPS = (1, 2, 3, 4, 5)
MAGNITUDE_BANDS = ((1.0, "below_1"), (2.0, "1_to_1_9"), (3.0, "2_to_2_9"), (4.0, "3_to_3_9"), (5.0, "4_to_4_9"))
TOP_BAND, NO_BAND = "5_plus", "unavailable"
DEPTH_CLASSES = ((70.0, "shallow"), (300.0, "intermediate"))
DEEPEST_CLASS = "deep"
MOMENT_TYPES = ("mw", "mww", "mwc", "mwb", "mwr", "mwp")


def number(value: Column) -> Column:
    """A double, null where it isn't a number: text that doesn't parse, NaN."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def energy_joules(magnitude: Column) -> Column:
    """Radiated energy by Gutenberg and Richter: log10 E = 1.5 M + 4.8."""
    return F.pow(F.lit(10.0), 1.5 * magnitude + 4.8)


def equivalent_magnitude(joules: Column) -> Column:
    """The magnitude of one event of this energy; null unless it is positive."""
    return F.when(joules > 0, (F.log10(joules) - 4.8) / 1.5)


def seismic_moment(magnitude: Column, kind: Column) -> Column:
    """Scalar moment in N m by Hanks and Kanamori, null for other magnitude scales."""
    return F.when(F.lower(F.trim(kind)).isin(*MOMENT_TYPES), F.pow(F.lit(10.0), 1.5 * magnitude + 9.1))


def _ladder(value: Column, steps: tuple, above: str) -> Column:
    chain = F.when(value < steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        chain = chain.when(value < limit, name)
    return chain.otherwise(above)


def magnitude_band(magnitude: Column) -> Column:
    return F.when(magnitude.isNull(), NO_BAND).otherwise(_ladder(magnitude, MAGNITUDE_BANDS, TOP_BAND))


def depth_class(depth: Column) -> Column:
    return F.when(depth.isNotNull(), _ladder(depth, DEPTH_CLASSES, DEEPEST_CLASS))


def reaches(magnitude: Column, step: float) -> Column:
    """Whether a magnitude is at least step; false without one."""
    return F.coalesce(magnitude >= step, F.lit(False))

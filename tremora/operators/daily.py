"""Daily tables, rolling and historical columns, and period summaries.

A daily table is one aggregation by UTC day joined to the spine of days; windows over it run on one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.seismic import (
    MAGNITUDE_STEPS,
    depth_class,
    energy_joules,
    equivalent_magnitude,
    magnitude_band,
    number,
    reaches,
)
from tremora.operators.validation import require_columns, utc_time, validated

STEPS = [f"magnitude_{k}_plus" for k in MAGNITUDE_STEPS]


def _step_counts(magnitude: str = "magnitude") -> list[Column]:
    return [F.count_if(F.col(magnitude) >= k).alias(name) for k, name in zip(MAGNITUDE_STEPS, STEPS, strict=True)]


def with_inactive_days(daily: DataFrame, zero: list[str]) -> DataFrame:
    """Every day from the first to the last; the given columns are zero where a day had no events, others null."""
    spine = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(
        F.explode(F.sequence("a", "b")).alias("date")
    )
    kinds = dict(daily.dtypes)
    filled = {c: F.coalesce(c, F.lit(0).cast(kinds[c])) for c in zero}
    return spine.join(daily, "date", "left").withColumns(filled).select(*daily.columns)


def _by_day(catalog: DataFrame, *aggregates: Column) -> DataFrame:
    return catalog.groupBy(F.to_date("event_time_utc").alias("date")).agg(
        F.count("event_id").alias("event_count"), *aggregates
    )


def magnitude_categories(df: DataFrame) -> DataFrame:
    """The validated catalog with its magnitude band and threshold flags."""
    flags = {name: reaches(F.col("magnitude"), k) for k, name in zip(MAGNITUDE_STEPS, STEPS, strict=True)}
    return validated(df).withColumns({"magnitude_band": magnitude_band(F.col("magnitude"))} | flags)


def depth_categories(df: DataFrame) -> DataFrame:
    return validated(df, "depth_km").withColumn("depth_category", depth_class(F.col("depth_km")))


def event_energy(df: DataFrame) -> DataFrame:
    """df with the energy of each event; neither rows nor repeated ids are left out here."""
    require_columns(df, ["event_id", "event_time_utc", "magnitude"])
    magnitude = number(F.col("magnitude"))
    return df.withColumns({"magnitude": magnitude, "estimated_energy_joules": energy_joules(magnitude)})


def daily_activity(df: DataFrame, include_inactive_days: bool = True) -> DataFrame:
    daily = _by_day(
        validated(df),
        *_step_counts(),
        F.max("magnitude").alias("maximum_magnitude"),
        F.avg("magnitude").alias("average_magnitude"),
        F.median("magnitude").alias("median_magnitude"),
    )
    return with_inactive_days(daily, ["event_count", *STEPS]) if include_inactive_days else daily


def daily_magnitude(df: DataFrame, include_inactive_days: bool = True) -> DataFrame:
    value = F.col("magnitude")
    daily = _by_day(
        validated(df),
        F.count(value).alias("events_with_magnitude"),
        F.count_if(value.isNull()).alias("missing_magnitude_count"),
        F.bround(F.avg(value), 4).alias("average_magnitude"),
        F.bround(F.median(value), 4).alias("median_magnitude"),
        F.bround(F.min(value), 4).alias("minimum_magnitude"),
        F.bround(F.max(value), 4).alias("maximum_magnitude"),
        F.bround(F.stddev_samp(value), 4).alias("magnitude_standard_deviation"),
        *_step_counts(),
    )
    zero = ["event_count", "events_with_magnitude", "missing_magnitude_count", *STEPS]
    return with_inactive_days(daily, zero) if include_inactive_days else daily


def daily_depth(df: DataFrame, include_inactive_days: bool = True) -> DataFrame:
    value, kind = F.col("depth_km"), F.col("depth_category")
    daily = _by_day(
        depth_categories(df),
        F.count(value).alias("events_with_depth"),
        F.bround(F.avg(value), 3).alias("average_depth_km"),
        F.bround(F.median(value), 3).alias("median_depth_km"),
        F.bround(F.min(value), 3).alias("minimum_depth_km"),
        F.bround(F.max(value), 3).alias("maximum_depth_km"),
        F.bround(F.stddev_samp(value), 3).alias("depth_standard_deviation_km"),
        *(F.count_if(kind == k).alias(f"{k}_events") for k in ("shallow", "intermediate", "deep")),
    )
    zero = ["event_count", "events_with_depth", "shallow_events", "intermediate_events", "deep_events"]
    return with_inactive_days(daily, zero) if include_inactive_days else daily


def daily_energy(df: DataFrame, include_inactive_days: bool = True) -> DataFrame:
    """A day without magnitudes has a total of zero. Repeated ids count each time."""
    joules = F.col("estimated_energy_joules")
    typed = event_energy(df).withColumn("event_time_utc", utc_time(F.col("event_time_utc")))
    daily = _by_day(
        typed.where("event_time_utc is not null"),
        F.count("magnitude").alias("events_with_magnitude"),
        F.coalesce(F.sum(joules), F.lit(0.0)).alias("total_energy_joules"),
        F.avg(joules).alias("average_energy_joules"),
        F.max(joules).alias("maximum_event_energy_joules"),
    )
    zero = ["event_count", "events_with_magnitude", "total_energy_joules"]
    filled = with_inactive_days(daily, zero) if include_inactive_days else daily
    return filled.withColumn("equivalent_single_magnitude", equivalent_magnitude(F.col("total_energy_joules")))


def _last(days: int):
    return Window.orderBy("date").rowsBetween(1 - days, 0)


def _before():
    """All earlier rows, so that history holds nothing of its own day."""
    return Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rolling_activity(daily: DataFrame) -> DataFrame:
    require_columns(daily, ["date", "event_count"])
    n = F.coalesce(number(F.col("event_count")), F.lit(0.0))
    base = daily.where("date is not null").withColumn("event_count", F.rint(n).cast("long"))
    count, history = F.col("event_count"), F.avg("event_count").over(_before())
    mean7, mean30 = F.avg(count).over(_last(7)), F.avg(count).over(_last(30))
    return base.withColumns(
        {
            "event_count_7d": F.sum(count).over(_last(7)),
            "event_count_30d": F.sum(count).over(_last(30)),
            "daily_average_7d": F.bround(mean7, 4),
            "daily_average_30d": F.bround(mean30, 4),
            "historical_expanding_average": F.bround(history, 4),
            "activity_ratio_7d": F.bround(_ratio(mean7, history), 4),
            "activity_ratio_30d": F.bround(_ratio(mean30, history), 4),
        }
    )


def rolling_magnitude(daily: DataFrame) -> DataFrame:
    require_columns(daily, ["date", "average_magnitude", "maximum_magnitude"])
    base = daily.where("date is not null")
    mean, history = F.col("average_magnitude"), F.avg("average_magnitude").over(_before())
    columns = {"historical_expanding_average_magnitude": F.bround(history, 4)}
    for days in (7, 30):
        average = F.avg(mean).over(_last(days))
        columns |= {
            f"average_magnitude_{days}d": F.bround(average, 4),
            f"maximum_magnitude_{days}d": F.bround(F.max("maximum_magnitude").over(_last(days)), 4),
            f"average_magnitude_difference_{days}d": F.bround(average - history, 4),
        }
    return base.withColumns(columns)


def rolling_energy(daily: DataFrame) -> DataFrame:
    require_columns(daily, ["date", "total_energy_joules"])
    total = F.coalesce(number(F.col("total_energy_joules")), F.lit(0.0))
    base = daily.where("date is not null").withColumn("total_energy_joules", total)
    history = F.avg("total_energy_joules").over(_before())
    columns = {"historical_expanding_energy_average_joules": history}
    for days in (7, 30):
        average = F.avg("total_energy_joules").over(_last(days))
        columns |= {
            f"total_energy_{days}d_joules": F.sum("total_energy_joules").over(_last(days)),
            f"daily_average_energy_{days}d_joules": average,
            f"energy_ratio_{days}d": _ratio(average, history),
        }
    return base.withColumns(columns)


def rolling_depth(daily: DataFrame) -> DataFrame:
    require_columns(daily, ["date", "average_depth_km"])
    base = daily.where("date is not null")
    history = F.avg("average_depth_km").over(_before())
    columns = {"historical_expanding_depth_average_km": F.bround(history, 4)}
    for days in (7, 30):
        average = F.avg("average_depth_km").over(_last(days))
        columns |= {
            f"average_depth_{days}d_km": F.bround(average, 4),
            f"depth_difference_{days}d_km": F.bround(average - history, 4),
        }
    return base.withColumns(columns)


def activity_summary(daily: DataFrame) -> DataFrame:
    """One row over a daily activity table; zeros for an empty one. The busiest day is the first of the busiest."""
    require_columns(daily, ["date", "event_count", *STEPS])
    count = F.coalesce("event_count", F.lit(0))
    zero = F.lit(0).cast("long")
    first_busiest = F.max(F.struct(count.alias("n"), (-F.unix_date("date")).alias("day")))
    made = daily.where("date is not null").agg(
        F.coalesce(F.sum(count), zero).cast("long").alias("total_events"),
        F.count_if(count > 0).alias("active_days"),
        F.count(F.lit(1)).alias("calendar_days"),
        F.coalesce(F.round(F.avg(count), 3), F.lit(0.0)).alias("average_events_per_day"),
        F.coalesce(F.round(F.median(count), 3), F.lit(0.0)).alias("median_events_per_day"),
        first_busiest.alias("busiest"),
        *(F.coalesce(F.sum(s), zero).cast("long").alias(s) for s in STEPS),
    )
    return made.withColumns(
        {
            "maximum_events_in_one_day": F.coalesce(F.col("busiest.n").cast("long"), zero),
            "busiest_day": F.date_format(F.date_from_unix_date((-F.col("busiest.day")).cast("int")), "yyyy-MM-dd"),
        }
    ).drop("busiest")


def _first_extreme(value: Column, largest: bool, *shown: str) -> Column:
    """The shown columns of the first row, by time and id, with the extreme value."""
    key = F.struct((-value if largest else value).alias("v"), "event_time_utc", "event_id")
    return F.min_by(F.struct(*shown), F.when(value.isNotNull(), key))


def magnitude_summary(df: DataFrame) -> DataFrame:
    value = F.col("magnitude")
    shown = ["event_id", "event_time_utc", *(["place"] if "place" in df.columns else [])]
    made = validated(df).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count(value).alias("events_with_magnitude"),
        F.count_if(value.isNull()).alias("missing_magnitude_count"),
        F.round(F.avg(value), 4).alias("average_magnitude"),
        F.round(F.median(value), 4).alias("median_magnitude"),
        F.round(F.min(value), 4).alias("minimum_magnitude"),
        F.round(F.max(value), 4).alias("maximum_magnitude"),
        F.round(F.stddev_samp(value), 4).alias("magnitude_standard_deviation"),
        *_step_counts(),
        _first_extreme(value, True, *shown).alias("largest"),
    )
    place = F.col("largest.place") if "place" in df.columns else F.lit(None).cast("string")
    return made.withColumns(
        {
            "largest_event_id": F.col("largest.event_id").cast("string"),
            "largest_event_time_utc": F.col("largest.event_time_utc"),
            "largest_event_place": place,
        }
    ).drop("largest")


def depth_summary(df: DataFrame) -> DataFrame:
    value, kind = F.col("depth_km"), F.col("depth_category")
    return depth_categories(df).agg(
        F.count(value).alias("events_with_depth"),
        F.round(F.avg(value), 3).alias("average_depth_km"),
        F.round(F.median(value), 3).alias("median_depth_km"),
        F.round(F.min(value), 3).alias("minimum_depth_km"),
        F.round(F.max(value), 3).alias("maximum_depth_km"),
        F.round(F.stddev_samp(value), 3).alias("depth_standard_deviation_km"),
        *(F.count_if(kind == k).alias(f"{k}_events") for k in ("shallow", "intermediate", "deep")),
        _first_extreme(value, False, "event_id")["event_id"].cast("string").alias("shallowest_event_id"),
        _first_extreme(value, True, "event_id")["event_id"].cast("string").alias("deepest_event_id"),
    )


def energy_summary(df: DataFrame) -> DataFrame:
    joules, zero = F.col("estimated_energy_joules"), F.lit(0.0)
    made = event_energy(df).agg(
        F.count(joules).alias("event_count_with_magnitude"),
        F.coalesce(F.sum(joules), zero).alias("total_energy_joules"),
        F.coalesce(F.avg(joules), zero).alias("average_energy_joules"),
        F.coalesce(F.median(joules), zero).alias("median_energy_joules"),
        F.coalesce(F.max(joules), zero).alias("maximum_event_energy_joules"),
        _first_extreme(joules, True, "event_id", "magnitude").alias("largest"),
    )
    return made.withColumns(
        {
            "maximum_energy_magnitude": F.col("largest.magnitude"),
            "maximum_energy_event_id": F.col("largest.event_id").cast("string"),
            "equivalent_single_magnitude": F.round(equivalent_magnitude(F.col("total_energy_joules")), 4),
        }
    ).drop("largest")


def catalog_quality(df: DataFrame) -> DataFrame:
    """One row of counts, range, missing values, repeated ids and events by year of a catalog."""
    year = F.year("event_time_utc")
    totals = df.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_time_utc").alias("first_event_time"),
        F.max("event_time_utc").alias("last_event_time"),
        F.round(F.min("magnitude"), 3).alias("minimum_magnitude"),
        F.round(F.max("magnitude"), 3).alias("maximum_magnitude"),
        F.round(F.avg("magnitude"), 3).alias("average_magnitude"),
        F.count_if(F.col("magnitude").isNull()).alias("missing_magnitude_count"),
        F.count_if(F.col("depth_km").isNull()).alias("missing_depth_count"),
        (F.count("event_id") - F.count_distinct("event_id")).alias("duplicate_event_count"),
    )
    by_year = df.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "n")))).alias("events_by_year")
    )
    return totals.crossJoin(F.broadcast(by_year))

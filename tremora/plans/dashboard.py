"""Tables and selections of the research dashboard."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.operators.lineage import cut


#: Lower ends of the magnitude bins and the magnitude of a major event.
BINS = (6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0)
MAJOR = 7.0
#: Fixed value: the version of a bundle with along-boundary tables.
BUNDLE_VERSION = 5
STUDY = ("interaction_strata", "interaction_rings", "along_strata", "along_rings", "along_coverage")


def denormalised(events: DataFrame, plates: DataFrame, faults: DataFrame) -> DataFrame:
    """Events with their plate boundary and fault, where they have any, and whether they are major."""
    plate = plates.select(
        "event_id", "step_id", "boundary_id", "left_plate", "right_plate", "boundary_class", F.col("distance_km").alias("boundary_distance_km")
    )
    fault = faults.select("event_id", "fault_id", F.col("distance_km").alias("fault_distance_km"))
    return (
        events.join(plate, "event_id", "left")
        .join(fault, "event_id", "left")
        .withColumn("is_major", F.coalesce(F.col("magnitude") >= MAJOR, F.lit(False)))
    )


def major_ids(events: DataFrame, minimum: float = MAJOR) -> DataFrame:
    return events.where(F.col("magnitude") >= minimum).select("event_id").distinct()


def incident_pairs(pairs: DataFrame, ids: DataFrame, ends: Sequence[str] = ("source_event_id", "target_event_id")) -> DataFrame:
    """Pairs with an end among ids; a union of semi-joins, as a condition with OR would be a nested loop."""
    first = pairs.join(ids, pairs[ends[0]] == ids.event_id, "left_semi")
    rest = pairs.join(ids, pairs[ends[0]] == ids.event_id, "left_anti")
    return first.unionByName(rest.join(ids, rest[ends[1]] == ids.event_id, "left_semi"))


def relationships(pairs: DataFrame, event_id: str, limit: int = 120) -> DataFrame:
    """Pairs of one event with a signed lag, the nearest in time first."""
    after = pairs.where(F.col("source_event_id") == event_id).select(
        F.col("target_event_id").alias("event_id"), F.col("lag_days").alias("signed_lag_days"), "distance_km"
    )
    before = pairs.where(F.col("target_event_id") == event_id).select(
        F.col("source_event_id").alias("event_id"), (-F.col("lag_days")).alias("signed_lag_days"), "distance_km"
    )
    return after.unionByName(before).orderBy(F.abs("signed_lag_days"), "event_id").limit(limit)


def search(
    events: DataFrame,
    text: str = "",
    minimum_magnitude: float | None = None,
    years: tuple[int, int] | None = None,
    columns: Sequence[str] = ("event_id", "place"),
    extra: str = "",
    **equal: str,
) -> DataFrame:
    """Events by magnitude, years, equal columns and text anywhere in the given columns, whatever its case."""
    kept = events if minimum_magnitude is None else events.where(F.col("magnitude") >= minimum_magnitude)
    if years:
        kept = kept.where(F.year("time").between(*years))
    for name, value in equal.items():
        kept = kept.where(F.col(name) == value)
    shown = F.concat(F.lit(extra), F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    return kept.where(F.lower(shown).contains(text.lower())) if text else kept


def by_year(events: DataFrame) -> DataFrame:
    return events.groupBy(F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def by_magnitude(events: DataFrame) -> DataFrame:
    """Counts by bin, empty bins left out; what lies under the first bin isn't shown."""
    value, chain = F.col("magnitude"), None
    for low in reversed(BINS):
        chain = F.when(value >= low, low) if chain is None else chain.when(value >= low, low)
    return events.where(value >= BINS[0]).groupBy(chain.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def most_recent(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc("time"), "event_id").limit(n)


def largest(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc_nulls_last("magnitude"), "event_id").limit(1)


def strongest_first(events: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("magnitude"), F.desc("time"), "event_id").offset(offset).limit(limit)


def ratio_correlation(statistics: DataFrame) -> DataFrame:
    """Pearson's correlation of the ratios along the boundary and by radius over all windows that have both; null for
    fewer than two, or if one of them doesn't vary."""
    a, b = F.col("post_pre_along_boundary_ratio"), F.col("post_pre_routed_radial_ratio")
    both = statistics.where(a.isNotNull() & b.isNotNull())
    return both.agg(
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("correlation"), F.count(F.lit(1)).alias("n")
    )


def manifest(**tables: DataFrame) -> dict[str, int]:
    """Row counts by table name."""
    return {name: df.count() for name, df in tables.items()}


RATIOS = ("post_pre_along_boundary_ratio", "post_pre_routed_radial_ratio")


def annular_series(rings: DataFrame, magnitude: float, days: float) -> DataFrame:
    """Ratios of the rings of one stratum and time window, by distance."""
    chosen = rings.where((F.col("source_minimum_magnitude") == magnitude) & (F.col("time_window_days") == days))
    return chosen.select("lower_distance_km", "upper_distance_km", *RATIOS).orderBy("lower_distance_km")


def decay_series(strata: DataFrame, magnitude: float, kilometres: float) -> DataFrame:
    """Ratios of one stratum and distance window, by time window."""
    chosen = strata.where((F.col("source_minimum_magnitude") == magnitude) & (F.col("distance_window_km") == kilometres))
    return chosen.select("time_window_days", *RATIOS).orderBy("time_window_days")


def study_cells(strata: DataFrame) -> DataFrame:
    """Both ratios of every cell that has both."""
    return strata.where(F.col(RATIOS[0]).isNotNull() & F.col(RATIOS[1]).isNotNull()).select(
        "source_minimum_magnitude", "time_window_days", "distance_window_km", *RATIOS
    )


#: Least magnitudes that the overview counts.
OVERVIEW = (7.0, 8.0, 9.0)


def overview(events: DataFrame) -> DataFrame:
    """One row over denormalised events: their number, those of magnitude 7, 8 and 9 or more, the years covered, and the
    share with a plate boundary and with a fault in per cent (null without events)."""
    n, value = F.count(F.lit(1)), F.col("magnitude")
    share = lambda c: F.round(100 * F.count(c) / F.nullif(n, F.lit(0)), 1)
    return events.agg(
        n.alias("event_count"),
        *(F.count_if(value >= low).alias(f"m{low:.0f}_count") for low in OVERVIEW),
        F.min(F.year("time")).alias("first_year"),
        F.max(F.year("time")).alias("last_year"),
        share("boundary_id").alias("plate_coverage_percent"),
        share("fault_id").alias("fault_coverage_percent"),
    )


def write_dashboard(tables: dict[str, DataFrame], folder: str, study: Sequence[str] = STUDY) -> dict[str, int]:
    """The dashboard's JSON from the tables of an opened study: events, major pairs and windows, the study's statistics, an
    overview, and last a manifest of row counts. Every table is a folder of part files; the manifest is one row."""
    events = cut(denormalised(tables["events"], tables["boundary_associations"], tables["fault_associations"]))
    major = cut(major_ids(events))
    windows = tables["interaction_windows"]
    shown = {
        "events": events,
        "major_pairs": incident_pairs(tables["interaction_pairs"], major),
        "major_windows": windows.join(major, windows["source_event_id"] == major["event_id"], "left_semi"),
        "overview": overview(events),
        **{f"study/{name}": tables[name] for name in study if name in tables},
    }
    shown = {name: cut(df) for name, df in shown.items()}
    for name, df in shown.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}.json")
    counts = manifest(**shown)
    spark = events.sparkSession
    row = spark.createDataFrame([(json.dumps({"bundle_schema_version": BUNDLE_VERSION, "rows": counts}, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return counts

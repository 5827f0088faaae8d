"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions import seismic
from tremora.operators import baseline, context, daily, interaction, network, revisions, spatial, trend, validation
from tremora.operators.lineage import cut
from tremora.plans import dashboard, report, stored
from tremora.plans.adapters import STUDY_MAGNITUDE, catalog, faults, located, observed, steps
from tremora.plans.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

PROFILE = (datetime(2024, 1, 1), datetime(2024, 1, 31))
CURRENT = (datetime(2001, 6, 1), datetime(2001, 7, 1))
EPS_KM, MIN_SAMPLES, NEAR_KM = 10.8, 24, 12.0
STUDY = {"minimum_magnitude": STUDY_MAGNITUDE, "max_lag_days": 5.0, "max_distance_km": 60.0}
WINDOWS = {"days": (1.0, 2.0, 5.0), "kilometres": (20.0, 60.0)}
LIMITS = (6.5, 7.0)
TIME = "yyyy-MM-dd HH:mm:ss"


def rounded(df: DataFrame, digits: int = 4, **by_column: int) -> DataFrame:
    """Doubles rounded, times as text: so that engines can be compared."""
    made = {}
    for name, kind in df.dtypes:
        if kind == "double":
            made[name] = F.round(name, by_column.get(name, digits))
        elif kind == "timestamp":
            made[name] = F.date_format(name, TIME)
    return df.withColumns(made)


def in_gigajoules(df: DataFrame) -> DataFrame:
    """Energies scaled down before rounding."""
    names = [c for c in df.columns if c.endswith("_joules")]
    return df.withColumns({c: F.col(c) / 1e9 for c in names})


def _positions(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").cast("long").alias("position"), "time", "latitude", "longitude", "depth", "magnitude")


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dbscan(_positions(located(spark, d)), "position", EPS_KM, MIN_SAMPLES)


def _cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each cluster, and the number of its members."""
    labelled = cut(_positions(located(spark, d)).join(_clustered(spark, d), "position"))
    sizes = spatial.cluster_members(labelled).groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("member_indices"))
    return rounded(spatial.cluster_statistics(labelled).join(sizes, "cluster_id"))


def _associations(spark: SparkSession, d: str) -> DataFrame:
    """Of all events."""
    return cut(context.nearest_boundary(located(spark, d), steps(spark, d), 25.0))


def _strong_associations(spark: SparkSession, d: str) -> DataFrame:
    """Of the events that the studies select. Read several times by every study, so it is computed once."""
    strong = interaction.eligible(located(spark, d), STUDY_MAGNITUDE)
    return cut(context.nearest_boundary(strong, steps(spark, d), 25.0))


def _as_shown() -> dict[str, Column]:
    """What rounded makes of an event, to be made once an event where pairs are rows."""
    return {"time": F.date_format("time", TIME), "magnitude": F.round("magnitude", 4)}


def _shown_pairs(spark: SparkSession, d: str) -> DataFrame:
    """As rounded shows them, but what hangs on one event is rounded and written once an event."""
    events = located(spark, d)
    found = interaction.pairs(events, _strong_associations(spark, d), **STUDY, shown_as=_as_shown())
    return found.drop("source_moment_nm", "target_moment_nm").withColumns({c: F.round(c, 4) for c in ("lag_days", "distance_km")})


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return interaction.windows(located(spark, d), _strong_associations(spark, d), *PROFILE, STUDY_MAGNITUDE, **WINDOWS)


ALONG_STUDY = (STUDY_MAGNITUDE, 5.0, 60.0, 10.0)


def _along_pairs(spark: SparkSession, d: str) -> DataFrame:
    """As rounded shows them."""
    read = (located(spark, d), _strong_associations(spark, d), steps(spark, d))
    return interaction.along_pairs(*read, *ALONG_STUDY, shown_as=_as_shown(), digits=4)


def _along_windows(spark: SparkSession, d: str) -> DataFrame:
    read = (located(spark, d), _strong_associations(spark, d), steps(spark, d))
    found = interaction.routed_places(*read, *ALONG_STUDY) or interaction.along_pairs(*read, *ALONG_STUDY)
    return interaction.along_windows(*read, found, *PROFILE, STUDY_MAGNITUDE, **WINDOWS)


def _route_coverage(spark: SparkSession, d: str) -> DataFrame:
    read = (located(spark, d), _strong_associations(spark, d), steps(spark, d))
    if not (found := interaction.routed_places(*read, *ALONG_STUDY)):
        return interaction.along_coverage(interaction.along_pairs(*read, *ALONG_STUDY))
    placed, met = found
    return interaction.along_coverage(interaction.pairs_of_places(placed, met.where("lag_slabs >= 0"), ALONG_STUDY[1]), "pairs")


def _revised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stored catalog, and later revisions of every third event with some new ones."""
    base = located(spark, d).select("event_id", F.lit("us").alias("source"), "time", "magnitude", F.col("time").alias("updated_at"))
    key = F.col("event_id").cast("long")
    old = base.where(key % 5 != 0)
    new = base.where((key % 3 == 0) | (key % 5 == 0)).withColumns(
        {
            "magnitude": F.when(key % 2 == 0, F.col("magnitude") + 1).otherwise(F.col("magnitude")),
            "updated_at": F.when(key % 2 == 0, F.col("updated_at") + F.expr("interval 1 hour")).otherwise(F.col("updated_at")),
        }
    )
    return old, new


def _config(period: str) -> baseline.BaselineConfig:
    return baseline.BaselineConfig(period=period)


def _periods(period: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = in_gigajoules(baseline.period_summaries(observed(spark, d), _config(period)))
        return rounded(made, 9, **{c: 3 if c.endswith("_joules") else 12 for c in made.columns if c.endswith(("_joules", "_magnitude"))})

    return run


def _compared(spark: SparkSession, d: str) -> DataFrame:
    events = observed(spark, d)
    history = baseline.period_summaries(events.where(F.col("time") < F.lit(CURRENT[0])), _config("monthly"))
    return baseline.compare(events, history, *CURRENT, _config("monthly"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return trend.time_series(observed(spark, d), trend.SeriesConfig("monthly", 12, 6))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).where("is_available").select("period_start", "period_end", F.round("score", 6).alias("score"))


def _dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    """Events keyed by user and type: the row that came last in input order stays."""
    raw = catalog(spark, d).withColumn(validation.ORDINAL, F.col("event_id").cast("long"))
    keyed = raw.withColumn("source", F.col("magnitude_type")).withColumn("event_id", F.col("place"))
    return rounded(validation.validated(keyed).select("source", "event_id", "event_time_utc", "magnitude"))


def _report_status(spark: SparkSession, d: str) -> DataFrame:
    return report.observatory_report(catalog(spark, d)).select(
        "activity_status", "energy_status", "depth_status", "confidence", "overall_status", "activity_change",
        F.col("activity.event_count_7d").alias("event_count_7d"),
        F.col("activity_period.total_events").alias("total_events"),
        F.col("catalog.event_count").alias("event_count"),
    )


def _merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return revisions.merge_counts(*_revised(spark, d))


QUERIES: dict[str, Query] = {
    "daily_activity": lambda s, d: rounded(daily.daily_activity(catalog(s, d))),
    "daily_activity_sparse": lambda s, d: rounded(daily.daily_activity(catalog(s, d), include_inactive_days=False)),
    "rolling_activity": lambda s, d: rounded(daily.rolling_activity(daily.daily_activity(catalog(s, d)))),
    "activity_summary": lambda s, d: daily.activity_summary(daily.daily_activity(catalog(s, d))),
    "magnitude_bands": lambda s, d: daily.magnitude_categories(catalog(s, d))
    .groupBy("magnitude_band")
    .agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in daily.STEPS)),
    "daily_magnitude": lambda s, d: daily.daily_magnitude(catalog(s, d)),
    "rolling_magnitude": lambda s, d: daily.rolling_magnitude(
        rounded(daily.daily_activity(catalog(s, d)).select("date", "average_magnitude", "maximum_magnitude"))
    ),
    "magnitude_summary": lambda s, d: rounded(daily.magnitude_summary(catalog(s, d))),
    "depth_classes": lambda s, d: daily.depth_categories(catalog(s, d)).groupBy("depth_category").agg(F.count(F.lit(1)).alias("n")),
    "daily_depth": lambda s, d: daily.daily_depth(catalog(s, d)),
    "rolling_depth": lambda s, d: daily.rolling_depth(daily.daily_depth(catalog(s, d)).select("date", "average_depth_km")),
    "depth_summary": lambda s, d: daily.depth_summary(catalog(s, d)),
    "event_energy": lambda s, d: rounded(
        in_gigajoules(daily.event_energy(catalog(s, d)).select("event_id", "magnitude", "estimated_energy_joules"))
    ),
    "daily_energy": lambda s, d: rounded(in_gigajoules(daily.daily_energy(catalog(s, d)))),
    "rolling_energy": lambda s, d: rounded(
        in_gigajoules(daily.rolling_energy(daily.daily_energy(catalog(s, d)).select("date", "total_energy_joules")))
    ),
    "energy_summary": lambda s, d: rounded(in_gigajoules(daily.energy_summary(catalog(s, d)))),
    "catalog_dedupe_last": _dedupe_last,
    "catalog_merge": lambda s, d: rounded(revisions.merge(*_revised(s, d))),
    "merge_counts": _merge_counts,
    "query_filter": lambda s, d: rounded(
        validation.query_filter(
            catalog(s, d).withColumnRenamed("event_time_utc", "time"),
            datetime(2024, 1, 5), datetime(2024, 1, 20), (17.5, 19.0, -68.0, -65.0), 1.0,
        ).select("event_id", "time", "latitude", "longitude", "magnitude")
    ),
    "catalog_quality": lambda s, d: rounded(daily.catalog_quality(catalog(s, d)).drop("events_by_year"), 3),
    "events_by_year": lambda s, d: daily.catalog_quality(
        observed(s, d).select("event_id", F.col("time").alias("event_time_utc"), "magnitude", F.col("depth").alias("depth_km"))
    ).select(F.explode("events_by_year").alias("year", "n")),
    "baseline_daily": _periods("daily"),
    "baseline_weekly": _periods("weekly"),
    "baseline_monthly": _periods("monthly"),
    "baseline_distribution": lambda s, d: baseline.distributions(
        in_gigajoules(baseline.period_summaries(observed(s, d), _config("weekly"))), _config("weekly")
    ).transform(rounded, 4),
    "current_comparison": lambda s, d: _compared(s, d)
    .withColumns({c: F.when(F.col("metric") == "total_energy_joules", F.col(c) / 1e15).otherwise(F.col(c)) for c in ("current_value", "mean")})
    .select("metric", "current_value", "mean", "percentile_rank", "ratio", "classification")
    .transform(rounded, 6),
    "anomaly_scores": lambda s, d: rounded(
        baseline.anomaly_scores(_compared(s, d).withColumn("period", F.lit("2001-06")), ["period"]), 6
    ),
    "time_series_points": lambda s, d: rounded(_series(s, d).drop("strongest_metric"), 6),
    "trend_moving_averages": lambda s, d: rounded(trend.moving_averages(_points(s, d)).drop("period_end"), 9),
    "trend_summary": lambda s, d: rounded(
        trend.trend(_points(s, d)).select(
            "available_count", "latest_score", "current_slope", "previous_slope", "acceleration", "momentum",
            "consecutive_increases", "consecutive_decreases", "maximum_score", "maximum_period_start", "minimum_score",
            "minimum_period_start", "percent_change", "direction", "strength", "short_slope", "long_percent_change",
        )
    ),
    "intelligence_index": lambda s, d: trend.intelligence(_series(s, d)),
    # Rounded once for two spots.
    "haversine_pairs": lambda s, d: spatial.near_names(located(s, d), "event_id", NEAR_KM, 4),
    "geographic_centroid": lambda s, d: rounded(spatial.centroid(catalog(s, d), "magnitude_type"), 6),
    "dbscan_labels": _clustered,
    "dbscan_clusters": _cluster_statistics,
    "swarm_summary": lambda s, d: rounded(
        spatial.swarms(_positions(located(s, d)), spatial.SwarmConfig(EPS_KM, MIN_SAMPLES))
    ),
    "nearest_fault": lambda s, d: rounded(context.nearest(located(s, d), context.segments(faults(s, d)), "fault_id", 40.0)),
    "nearest_fault_scan": lambda s, d: rounded(
        context.nearest(located(s, d), context.segments(faults(s, d)), "fault_id", 40.0, indexed=False)
    ),
    "distance_matrix": lambda s, d: rounded(
        spatial.pairwise(steps(s, d).select("step_id", F.col("start_latitude").alias("latitude"), F.col("start_longitude").alias("longitude")), "step_id")
    ),
    "nearest_boundary": lambda s, d: rounded(_associations(s, d)),
    "boundary_projection": lambda s, d: rounded(network.project(located(s, d), _associations(s, d), steps(s, d)), 5),
    "seismic_moment": lambda s, d: located(s, d).select(
        "event_id", F.round(seismic.seismic_moment(F.col("magnitude"), F.col("magnitude_type")) / 1e18, 4).alias("moment_1e18")
    ),
    "network_summary": lambda s, d: network.network_summary(steps(s, d)),
    "network_distance": lambda s, d: network.shortest_paths(steps(s, d)),
    "interaction_pairs": lambda s, d: _shown_pairs(s, d),
    "interaction_windows": lambda s, d: rounded(_windows(s, d).drop("source_moment_nm")),
    "interaction_cumulative": lambda s, d: rounded(interaction.stratified(_windows(s, d), LIMITS)),
    "interaction_annular": lambda s, d: rounded(interaction.annular(interaction.stratified(_windows(s, d), LIMITS))),
    "along_pairs": _along_pairs,
    "along_windows": lambda s, d: rounded(_along_windows(s, d)),
    "along_statistics": lambda s, d: rounded(interaction.along_statistics(_along_windows(s, d), LIMITS)),
    "along_annular": lambda s, d: rounded(
        interaction.annular(interaction.along_statistics(_along_windows(s, d), LIMITS), interaction.ALONG)
    ),
    "annular_series": lambda s, d: rounded(
        dashboard.annular_series(
            interaction.annular(interaction.along_statistics(_along_windows(s, d), LIMITS), interaction.ALONG), 6.5, 2.0
        )
    ),
    "decay_series": lambda s, d: rounded(dashboard.decay_series(interaction.along_statistics(_along_windows(s, d), LIMITS), 6.5, 60.0)),
    "study_cells": lambda s, d: rounded(dashboard.study_cells(interaction.along_statistics(_along_windows(s, d), LIMITS))),
    "checked_projections": lambda s, d: rounded(
        network.checked_projections(network.project(located(s, d), _associations(s, d), steps(s, d)), steps(s, d)), 5
    ),
    "route_coverage": lambda s, d: rounded(_route_coverage(s, d)),
    "latest_status": _report_status,
    "dashboard_events": lambda s, d: rounded(
        dashboard.denormalised(
            located(s, d), _associations(s, d), context.nearest(located(s, d), context.segments(faults(s, d)), "fault_id", 40.0)
        )
    ),
    "major_pairs": lambda s, d: rounded(
        dashboard.incident_pairs(interaction.pairs(located(s, d), _strong_associations(s, d), **STUDY), dashboard.major_ids(located(s, d), 8.0))
        .select("source_event_id", "target_event_id", "lag_days", "distance_km")
    ),
    "year_histogram": lambda s, d: dashboard.by_year(observed(s, d)),
    "magnitude_histogram": lambda s, d: dashboard.by_magnitude(located(s, d)),
    "ratio_correlation": lambda s, d: rounded(dashboard.ratio_correlation(interaction.along_statistics(_along_windows(s, d), LIMITS))),
    "topk_recent": lambda s, d: rounded(dashboard.most_recent(located(s, d), 10).select("event_id", "time", "magnitude")),
    "largest_event": lambda s, d: rounded(dashboard.largest(catalog(s, d)).select("event_id", "magnitude")),
    "event_search": lambda s, d: rounded(
        dashboard.search(located(s, d), text="PLACE 7", minimum_magnitude=6.5, columns=("event_id", "magnitude_type"), extra="place ")
    ),
}


def queries() -> dict[str, Query]:
    return QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | stored.ORACLES

"""The observatory report: daily metrics of the latest day beside their history, as one row, JSON and text."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tremora.functions.status import ACTIVITY, ENERGY, change_text, confidence, depth_status, overall, ratio_status
from tremora.operators import daily
from tremora.operators.lineage import cut
from tremora.operators.trend import IntelligenceConfig, SeriesConfig, intelligence, time_series, trend
from tremora.sources.catalogs import CatalogStore, to_observatory


def _latest(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.max_by(F.struct(*columns), "date").alias("row")).select("row.*")


def observatory_report(df: DataFrame, region: str = "all") -> DataFrame:
    """One row: sections activity, energy, depth, magnitude, their statuses, confidence and the overall status.

    An empty catalog gives no row. Daily tables hold a row per day, so everything past them is small. The catalog is
    read once: its columns that the sections use are cut off first.
    """
    df = cut(df.select(*(c for c in ("source", "event_id", "event_time_utc", "magnitude", "depth_km") if c in df.columns)))
    days = cut(daily.daily_activity(df))
    activity = _latest(
        daily.rolling_activity(days), "date", "event_count", "event_count_7d", "daily_average_7d",
        "historical_expanding_average", "activity_ratio_7d",
    )
    energy = _latest(
        daily.rolling_energy(daily.daily_energy(df)), "total_energy_7d_joules",
        "historical_expanding_energy_average_joules", "energy_ratio_7d",
    )
    depth = _latest(
        daily.rolling_depth(daily.daily_depth(df)), "average_depth_7d_km",
        "historical_expanding_depth_average_km", "depth_difference_7d_km",
    )
    sections = {
        "activity": activity.where("date is not null"),
        "activity_period": daily.activity_summary(days),
        "energy": energy,
        "energy_period": daily.energy_summary(df),
        "depth": depth,
        "depth_period": daily.depth_summary(df) if "depth_km" in df.columns else None,
        "magnitude_period": daily.magnitude_summary(df),
        "catalog": df.agg(F.count(F.lit(1)).alias("event_count")),
    }
    row: DataFrame | None = None
    for name, section in sections.items():
        if section is None:
            continue
        packed = section.select(F.struct("*").alias(name))
        row = packed if row is None else row.crossJoin(F.broadcast(packed))
    status = {
        "activity_status": ratio_status(F.col("activity.activity_ratio_7d"), ACTIVITY),
        "energy_status": ratio_status(F.col("energy.energy_ratio_7d"), ENERGY),
        "depth_status": depth_status(F.col("depth.depth_difference_7d_km")),
        "activity_change": change_text(F.col("activity.activity_ratio_7d")),
        "confidence": confidence(F.col("activity_period.calendar_days") - 7),
        "region": F.lit(region),
    }
    return row.withColumns(status).withColumn(
        "overall_status", overall(F.col("activity_status"), F.col("energy_status"), F.col("depth_status"))
    )


def time_column_view(df: DataFrame) -> DataFrame:
    """The report's columns under the names that baselines read; a missing depth is null."""
    depth = F.col("depth_km") if "depth_km" in df.columns else F.lit(None).cast("double")
    return df.select(F.col("event_time_utc").alias("time"), "magnitude", depth.alias("depth"))


def intelligence_report(
    df: DataFrame, config: SeriesConfig = SeriesConfig(), recent: int = 14, snapshot: IntelligenceConfig = IntelligenceConfig(), region: str = "all"
) -> DataFrame:
    """The observatory report with the trend, the activity index and the latest periods of its time series."""
    series = cut(time_series(time_column_view(df), config))
    points = series.where("is_available").select("period_start", "period_end", "score")
    latest = series.orderBy(F.desc("period_start")).limit(recent)
    nested = latest.agg(F.array_sort(F.collect_list(F.struct(*latest.columns))).alias("recent_periods"))
    return (
        observatory_report(df, region)
        .crossJoin(F.broadcast(trend(points).select(F.struct("*").alias("trend"))))
        .crossJoin(F.broadcast(intelligence(series, snapshot).select(F.struct("*").alias("intelligence"))))
        .crossJoin(F.broadcast(nested))
    )


def documents(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, value): every row of a table of results as a JSON document, null fields included and times in UTC's ISO
    form; for baselines, scores, trends, series, indexes, swarms and merge counts alike."""
    how = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "ignoreNullFields": "false"}
    return df.select(*keys, F.to_json(F.struct("*"), how).alias("value"))


def as_json(report: DataFrame) -> DataFrame:
    """The report as one JSON document, without what is null."""
    return report.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("value"))


def save_json(report: DataFrame, path: str) -> None:
    as_json(report).coalesce(1).write.mode("overwrite").text(path)


def render(row: Row, width: int = 72) -> str:
    """Plain text of one collected report row."""
    def line(name: str, value: object) -> str:
        return f"{name:<36}{'unavailable' if value is None else value}"

    activity, period = row["activity"], row["activity_period"]
    lines = [
        "=" * width,
        f"Observatory report: {row['region']}".center(width),
        "=" * width,
        line("Latest day", activity["date"]),
        line("Overall status", row["overall_status"]),
        line("Confidence", row["confidence"]),
        line("Events in 7 days", activity["event_count_7d"]),
        line("Activity", f"{row['activity_status']} ({row['activity_change']})"),
        line("Energy", row["energy_status"]),
        line("Depth", row["depth_status"]),
        line("Events in catalog", f"{period['total_events']:,}"),
        line("Busiest day", period["busiest_day"]),
        line("Largest magnitude", row["magnitude_period"]["maximum_magnitude"]),
        "-" * width,
        "Descriptive statistics of past events; not a forecast or warning.",
    ]
    return "\n".join(lines) + "\n"


def render_intelligence(row: Row, width: int = 72) -> str:
    """Plain text of one collected row of an intelligence report: the report, then trend, index and recent periods."""
    def line(name: str, value: object, unit: str = "") -> str:
        return f"{name:<36}{'unavailable' if value is None else f'{value}{unit}'}"

    index, trend_row = row["intelligence"], row["trend"]
    lines = [
        "Activity index".center(width),
        "-" * width,
        line("Index", index["activity_index"]),
        line("Periods in the index", index["index_period_count"]),
        line("Movement", index["activity_trend"]),
        line("Change", index["activity_change"]),
        line("Confidence", f"{index['confidence']} ({index['confidence_score']} %)"),
        line("Periods with a score", index["available_period_count"]),
        line("Periods without", index["unavailable_period_count"]),
        "-" * width,
        *(line(name.replace("_", " ").capitalize(), trend_row[name]) for name in ("direction", "strength", "slope") if name in trend_row.asDict()),
        "-" * width,
        f"{'Period':<24}{'Events':>8}{'Score':>9}  Level",
    ]
    for p in sorted(row["recent_periods"] or [], key=lambda p: p["period_start"]):
        score = "-" if p["score"] is None else f"{p['score']:.1f}"
        lines.append(f"{p['period_start']!s:<24}{p['event_count']:>8}{score:>9}  {p['level'] or p['unavailable_reason'] or ''}")
    return render(row, width) + "\n".join(lines) + "\n"


def stored_report(store: CatalogStore, region: str, config: SeriesConfig | None = None, recent: int = 14) -> DataFrame:
    """The report of a region of a store; with a configuration of series the intelligence report."""
    events = to_observatory(store.load(region))
    if config is None:
        return observatory_report(events, region)
    return intelligence_report(events, config, recent, region=region)


def write_text(report: DataFrame, path: Path) -> None:
    """Text of the only row of a report, on the driver."""
    path.write_text(render(report.first()))

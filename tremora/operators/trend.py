"""Movement of scores over time, the observatory time series and the activity index."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.operators.baseline import (
    PRIMARY,
    AnomalyConfig,
    BaselineConfig,
    active_periods,
    anomaly_scores,
    comparison_columns,
    distribution_columns,
    long_form,
    period_start,
    shift,
    summary_columns,
)
from tremora.operators.validation import normalized

INSUFFICIENT, EMPTY_BASELINE = "insufficient_baseline_history", "empty_baseline_catalog"


@dataclass(frozen=True)
class TrendConfig:
    short_window: int = 7
    medium_window: int = 14
    long_window: int = 30
    slope_window: int = 7
    previous_slope_window: int = 7
    stable_slope: float = 0.25
    rapid_slope: float = 3.0
    moderate_strength: float = 35.0
    strong_strength: float = 70.0
    minimum_points: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.short_window <= self.medium_window <= self.long_window:
            raise ValueError("windows must be positive and ordered")
        if not 0 <= self.stable_slope < self.rapid_slope:
            raise ValueError("slope thresholds must be ordered")

    @property
    def windows(self) -> dict[str, int]:
        return {"short": self.short_window, "medium": self.medium_window, "long": self.long_window}


@dataclass(frozen=True)
class SeriesConfig:
    frequency: str = "daily"
    lookback: int = 30
    minimum_periods: int = 7
    analysis_start: datetime | None = None
    analysis_end: datetime | None = None
    baseline: BaselineConfig | None = None
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)

    def __post_init__(self) -> None:
        if not 1 <= self.minimum_periods <= self.lookback:
            raise ValueError("minimum_periods must be within 1 and lookback")

    @property
    def baseline_config(self) -> BaselineConfig:
        return self.baseline or BaselineConfig(
            self.frequency, rolling_window=self.lookback, minimum_periods=self.minimum_periods
        )


@dataclass(frozen=True)
class IntelligenceConfig:
    activity_window: int = 7
    trend_window: int = 7
    stable_change: float = 5.0
    moderate_periods: int = 7
    high_periods: int = 30
    high_completeness: float = 0.9


def moving_averages(points: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """points(period_start, score) with averages of the last available scores; a gap repeats the ones before it."""
    known = points.where("score is not null").select(
        "period_start",
        *(
            F.avg("score").over(Window.orderBy("period_start").rowsBetween(1 - n, 0)).alias(f"{name}_moving_average")
            for name, n in config.windows.items()
        ),
    )
    so_far = Window.orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(so_far) for c in known.columns if c != "period_start"}
    return points.join(known, "period_start", "left").withColumns({"is_available": F.col("score").isNotNull()} | filled)


def percent_change(first: Column, latest: Column) -> Column:
    return F.when(first == 0, F.when(latest == 0, 0.0)).otherwise((latest - first) / F.abs(first) * 100)


def direction(n: Column, slope: Column, config: TrendConfig) -> Column:
    """Slopes on a threshold belong to the milder class."""
    return (
        F.when((n < config.minimum_points) | slope.isNull(), "insufficient_data")
        .when(slope > config.rapid_slope, "rapidly_increasing")
        .when(slope > config.stable_slope, "increasing")
        .when(slope >= -config.stable_slope, "stable")
        .when(slope >= -config.rapid_slope, "decreasing")
        .otherwise("rapidly_decreasing")
    )


def strength(kind: Column, slope: Column, run: Column, change: Column, config: TrendConfig) -> Column:
    points = (
        F.least(F.abs(slope) / config.rapid_slope, F.lit(1.0)) * 50
        + F.least(run / max(config.minimum_points - 1, 1), F.lit(1.0)) * 30
        + F.coalesce(F.least(F.abs(change) / 100, F.lit(1.0)), F.lit(0.0)) * 20
    )
    return (
        F.when(kind == "insufficient_data", kind)
        .when(kind == "stable", "weak")
        .when(points < config.moderate_strength, "weak")
        .when(points < config.strong_strength, "moderate")
        .otherwise("strong")
    )


def numbered(points: DataFrame) -> DataFrame:
    """Available points with i, their number from the first, and r, from the last; plus step, the sign of change."""
    order = Window.orderBy("period_start")
    return (
        points.where("score is not null")
        .withColumn("i", F.row_number().over(order))
        .withColumn("r", F.row_number().over(Window.orderBy(F.desc("period_start"))))
        .withColumn("step", F.signum(F.col("score") - F.lag("score").over(order)))
        .withColumn("last_step", F.first("step").over(Window.orderBy(F.desc("period_start"))))
    )


def trend(points: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """One row about points(period_start, period_end, score): slopes by position among available scores, runs,
    extremes (the first among equals) and a summary of each window."""
    rows, score = numbered(points), F.col("score")
    n = F.count(score)

    def slope(low: int, high: int) -> Column:
        return F.regr_slope(F.when(F.col("r").between(low, high), score), F.col("i"))

    def first_extreme(key: Column) -> Column:
        return F.min(F.struct(key.alias("key"), "period_start", "score"))

    ends: list[Column] = []
    for name, size in config.windows.items():
        within = F.col("r") <= size
        ends += [
            F.count(F.when(within, score)).alias(f"{name}_count"),
            F.regr_slope(F.when(within, score), F.col("i")).alias(f"{name}_slope"),
            F.max_by("score", F.when(within, F.col("r"))).alias(f"{name}_first"),
            F.avg(F.when(within, score)).alias(f"{name}_moving_average"),
        ]
    made = rows.agg(
        n.alias("available_count"),
        F.max_by("score", "i").alias("latest_score"),
        F.min_by("score", "i").alias("first_score"),
        slope(1, config.slope_window).alias("current_slope"),
        slope(config.slope_window + 1, config.slope_window + config.previous_slope_window).alias("previous_slope"),
        (F.coalesce(F.min(F.when(~F.col("step").eqNullSafe(F.col("last_step")), F.col("r"))), n + 1) - 1).alias("run"),
        F.first("last_step").alias("last_step"),
        first_extreme(-score).alias("highest"),
        first_extreme(score).alias("lowest"),
        *ends,
    )
    latest, first = F.col("latest_score"), F.col("first_score")
    run = F.when(F.coalesce(F.col("last_step"), F.lit(0.0)) == 0, 0).otherwise(F.col("run")).cast("long")
    shown = made.withColumn("run", run).withColumns(
        {
            "acceleration": F.col("current_slope") - F.col("previous_slope"),
            "momentum": latest - F.col("short_moving_average"),
            "consecutive_increases": F.when(F.col("last_step") > 0, F.col("run")).otherwise(F.lit(0).cast("long")),
            "consecutive_decreases": F.when(F.col("last_step") < 0, F.col("run")).otherwise(F.lit(0).cast("long")),
            "maximum_score": F.col("highest.score"),
            "maximum_period_start": F.col("highest.period_start"),
            "minimum_score": F.col("lowest.score"),
            "minimum_period_start": F.col("lowest.period_start"),
            "percent_change": percent_change(first, latest),
            "direction": direction(F.col("available_count"), F.col("current_slope"), config),
        }
        | {f"{w}_change": latest - F.col(f"{w}_first") for w in config.windows}
        | {f"{w}_percent_change": percent_change(F.col(f"{w}_first"), latest) for w in config.windows}
    )
    rising = F.col("direction").contains("increasing")
    matching = F.when(rising, F.col("consecutive_increases")).otherwise(F.col("consecutive_decreases"))
    graded = shown.withColumn(
        "strength", strength(F.col("direction"), F.col("current_slope"), matching, F.col("percent_change"), config)
    )
    span = points.agg(
        F.min("period_start").alias("series_start"), F.max("period_end").alias("series_end"), F.count(F.lit(1)).alias("point_count")
    )
    return graded.drop("highest", "lowest", "last_step", "run").crossJoin(F.broadcast(span))


def period_index(start: Column, period: str) -> Column:
    """Consecutive integers for consecutive periods."""
    day = F.unix_date(F.to_date(start))
    if period == "monthly":
        return F.year(start) * 12 + F.month(start) - 1
    return day if period == "daily" else F.floor((day + 3) / 7).cast("int")


def _candidates(events: DataFrame, config: SeriesConfig) -> DataFrame:
    """(period_start, period_end, idx, prior): the periods to judge; prior counts the periods of coverage before."""
    span = events.agg(F.min("time").alias("a"), F.max("time").alias("b")).where("a is not null")
    f = config.frequency
    coverage = period_start(F.col("a"), f)
    start = period_start(F.lit(config.analysis_start), f) if config.analysis_start else shift(coverage, config.minimum_periods, f)
    end = F.lit(config.analysis_end).cast("timestamp") if config.analysis_end else shift(period_start(F.col("b"), f), 1, f)
    step = F.expr({"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month"}[f])
    return (
        span.select(coverage.alias("coverage"), start.cast("timestamp").alias("s"), end.alias("e"))
        .where("s < e")
        .select("coverage", "e", F.explode(F.sequence("s", "e", step)).alias("period_start"))
        .withColumn("period_end", shift(F.col("period_start"), 1, f))
        .where("period_end <= e")
        .select(
            "period_start",
            "period_end",
            period_index(F.col("period_start"), f).alias("idx"),
            F.greatest(F.lit(0), period_index(F.col("period_start"), f) - period_index(F.col("coverage"), f)).alias("prior"),
        )
    )


def _history(events: DataFrame, active: DataFrame, candidates: DataFrame, config: SeriesConfig) -> DataFrame:
    """(period_start, metrics): the baseline periods of each candidate, from its first to its last with events."""
    lags = candidates.select("period_start", F.explode(F.sequence(F.col("idx") - config.lookback, F.col("idx") - 1)).alias("idx"))
    base = config.baseline_config.period
    if base == config.frequency:
        placed = lags.join(active.withColumn("has", F.lit(True)).drop("period_start", "period_end"), "idx", "left")
    else:
        # Periods of another length are cut off where the lookback begins and ends, so events are grouped anew.
        indexed = events.withColumn("idx", period_index(F.col("time"), config.frequency))
        groups = lags.join(indexed, "idx").groupBy("period_start", period_start(F.col("time"), base).alias("b"))
        made = groups.agg(*summary_columns()).withColumn("idx", period_index(F.col("b"), base)).withColumn("has", F.lit(True))
        spine = made.groupBy("period_start").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).select(
            "period_start", F.explode(F.sequence("lo", "hi")).alias("idx")
        )
        placed = spine.join(made, ["period_start", "idx"], "left")
    whole = Window.partitionBy("period_start")
    seen = F.when(F.col("has"), F.col("idx"))
    trimmed = placed.withColumns({"lo": F.min(seen).over(whole), "hi": F.max(seen).over(whole)}).where(
        F.col("idx").between(F.col("lo"), F.col("hi"))
    )
    if base == "monthly":
        first = F.make_date(F.floor(F.col("idx") / 12).cast("int"), F.pmod("idx", F.lit(12)) + 1, F.lit(1))
        days = F.date_diff(F.add_months(first, 1), first)
    else:
        days = F.lit(1 if base == "daily" else 7)
    count = F.coalesce("event_count", F.lit(0))
    return trimmed.withColumns({"event_count": count, "event_rate_per_day": count / days}).select("period_start", "idx", *PRIMARY)


def time_series(df: DataFrame, config: SeriesConfig = SeriesConfig()) -> DataFrame:
    """One row for each candidate period: counts, whether a score is there or why not, score, level, strongest metric.

    Every candidate is compared with the periods before it only, so later events never change an earlier row.
    """
    events = normalized(df)
    active = active_periods(events, config.frequency).withColumn("idx", period_index(F.col("period_start"), config.frequency))
    candidates = _candidates(events, config)
    history = _history(events, active, candidates.where(F.col("prior") >= config.minimum_periods), config)
    now = candidates.join(active.drop("period_start", "period_end"), "idx", "left")
    days = (F.unix_micros("period_end") - F.unix_micros("period_start")) / 86_400e6
    now = now.withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("long"))).withColumn(
        "event_rate_per_day", F.col("event_count") / days
    )
    current = long_form(now, ["period_start"], PRIMARY).withColumnRenamed("value", "current_value")
    joined = long_form(history, ["period_start"], PRIMARY).join(current, ["period_start", "metric"])
    spread = joined.groupBy("period_start", "metric", "current_value").agg(
        *distribution_columns(config.baseline_config), F.count_if(F.col("value") <= F.col("current_value")).alias("below")
    )
    scores = anomaly_scores(
        spread.withColumns(comparison_columns(F.col("current_value"))), ["period_start"], config.anomaly
    )
    reason = F.when(F.col("prior") < config.minimum_periods, INSUFFICIENT).when(F.col("level").isNull(), EMPTY_BASELINE)
    return now.join(scores, "period_start", "left").select(
        "period_start",
        "period_end",
        shift(F.col("period_start"), -config.lookback, config.frequency).alias("baseline_start"),
        F.least("prior", F.lit(config.lookback)).cast("long").alias("baseline_period_count"),
        "event_count",
        F.col("level").isNotNull().alias("is_available"),
        "score",
        "level",
        "available_metric_count",
        "strongest_metric",
        reason.alias("unavailable_reason"),
    )


def intelligence(series: DataFrame, config: IntelligenceConfig = IntelligenceConfig()) -> DataFrame:
    """One row: recent mean score, its movement and how complete the scores are."""
    total = series.agg(F.count(F.lit(1)).alias("total"))
    rows = numbered(series).agg(
        F.count("score").alias("available"),
        F.round(F.avg(F.when(F.col("r") <= config.activity_window, F.col("score"))), 1).alias("activity_index"),
        F.count(F.when(F.col("r") <= config.activity_window, 1)).alias("index_period_count"),
        F.count(F.when(F.col("r") <= config.trend_window, 1)).alias("trend_points"),
        (F.max_by("score", "i") - F.max_by("score", F.when(F.col("r") <= config.trend_window, F.col("r")))).alias("change"),
    )
    n, change = F.col("available"), F.col("change")
    completeness = F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0)
    kind = (
        F.when(F.col("trend_points") < 2, "insufficient_data")
        .when(F.abs(change) <= config.stable_change, "stable")
        .when(change > 0, "increasing")
        .otherwise("decreasing")
    )
    confidence = (
        F.when((n >= config.high_periods) & (completeness >= config.high_completeness), "high")
        .when(n >= config.moderate_periods, "moderate")
        .otherwise("low")
    )
    return rows.crossJoin(F.broadcast(total)).select(
        "activity_index",
        "index_period_count",
        kind.alias("activity_trend"),
        F.when(F.col("trend_points") >= 2, F.round(change, 1)).alias("activity_change"),
        confidence.alias("confidence"),
        F.round(100 * completeness * F.least(n / config.high_periods, F.lit(1.0)), 1).alias("confidence_score"),
        n.alias("available_period_count"),
        (F.col("total") - n).alias("unavailable_period_count"),
    )

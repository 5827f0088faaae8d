"""Calendar-period baselines, comparison of a period with its history, and anomaly scores.

Periods are summarised once; everything after that works on one row per period or per period and metric.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.seismic import energy_joules
from tremora.operators.validation import normalized

PERIODS = {"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}
#: Summarised metrics in order, and those that a current period is compared by.
METRICS = (
    "event_count", "event_rate_per_day", "mean_magnitude", "median_magnitude", "maximum_magnitude",
    "minimum_magnitude", "magnitude_event_count", "mean_depth_km", "median_depth_km", "minimum_depth_km",
    "maximum_depth_km", "depth_event_count", "total_energy_joules", "mean_energy_joules", "maximum_energy_joules",
    "energy_event_count", "rolling_event_count_mean",
)
PRIMARY = ("event_count", "event_rate_per_day", "mean_magnitude", "maximum_magnitude", "mean_depth_km", "total_energy_joules")


@dataclass(frozen=True)
class BaselineConfig:
    period: str = "daily"
    lower_percentile: float = 10.0
    upper_percentile: float = 90.0
    rolling_window: int = 7
    minimum_periods: int = 1

    def __post_init__(self) -> None:
        if self.period not in PERIODS:
            raise ValueError(f"period must be one of {', '.join(PERIODS)}")
        if not 0 <= self.lower_percentile < self.upper_percentile <= 100:
            raise ValueError("percentiles must be ordered and within 0 to 100")
        if not 1 <= self.minimum_periods <= self.rolling_window:
            raise ValueError("minimum_periods must be within 1 and rolling_window")


@dataclass(frozen=True)
class MetricWeight:
    name: str
    weight: float
    two_sided: bool = False


@dataclass(frozen=True)
class AnomalyConfig:
    metrics: tuple[MetricWeight, ...] = (
        MetricWeight("event_count", 0.30),
        MetricWeight("maximum_magnitude", 0.25),
        MetricWeight("total_energy_joules", 0.30),
        MetricWeight("mean_depth_km", 0.15, two_sided=True),
    )
    levels: tuple[tuple[float, str], ...] = field(default=((60.0, "noteworthy"), (80.0, "elevated"), (95.0, "extreme")))

    def __post_init__(self) -> None:
        names = [m.name for m in self.metrics]
        if not names or len(set(names)) < len(names) or any(m.weight <= 0 for m in self.metrics):
            raise ValueError("metrics must be distinct, with positive weights")


def period_start(time: Column, period: str) -> Column:
    """Midnight of the day, of Monday or of the first, in UTC."""
    return F.date_trunc(PERIODS[period], time)


def shift(start: Column, periods: Column | int, period: str) -> Column:
    k = F.lit(periods) if isinstance(periods, int) else periods
    part = {"daily": "days", "weekly": "weeks", "monthly": "months"}[period]
    return start + F.make_interval(**{part: k})


def _steps(period: str) -> Column:
    return F.expr({"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month"}[period])


def _days(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 86_400e6


def summary_columns() -> list[Column]:
    """What a group of normalised events amounts to; null statistics where there is nothing to measure."""
    m, d = F.col("magnitude"), F.col("depth")
    e = energy_joules(m)
    return [
        F.count("time").alias("event_count"),
        F.avg(m).alias("mean_magnitude"),
        F.median(m).alias("median_magnitude"),
        F.max(m).alias("maximum_magnitude"),
        F.min(m).alias("minimum_magnitude"),
        F.count(m).alias("magnitude_event_count"),
        F.avg(d).alias("mean_depth_km"),
        F.median(d).alias("median_depth_km"),
        F.min(d).alias("minimum_depth_km"),
        F.max(d).alias("maximum_depth_km"),
        F.count(d).alias("depth_event_count"),
        F.sum(e).alias("total_energy_joules"),
        F.avg(e).alias("mean_energy_joules"),
        F.max(e).alias("maximum_energy_joules"),
        F.count(e).alias("energy_event_count"),
    ]


COUNTS = ("event_count", "magnitude_event_count", "depth_event_count", "energy_event_count")


def active_periods(events: DataFrame, period: str) -> DataFrame:
    """One row for each period with events, without the rolling column."""
    made = events.groupBy(period_start(F.col("time"), period).alias("period_start")).agg(*summary_columns())
    end = shift(F.col("period_start"), 1, period)
    return made.withColumns({"period_end": end, "event_rate_per_day": F.col("event_count") / _days(F.col("period_start"), end)})


def period_summaries(df: DataFrame, config: BaselineConfig = BaselineConfig(), **columns: str) -> DataFrame:
    """One row for each period from that of the first event to that of the last, empty ones included."""
    active = active_periods(normalized(df, **columns), config.period)
    spine = active.agg(F.min("period_start").alias("a"), F.max("period_start").alias("b")).where("a is not null").select(
        F.explode(F.sequence("a", "b", _steps(config.period))).alias("period_start")
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}
    filled = spine.join(active.drop("period_end"), "period_start", "left").withColumns(
        zero
        | {
            "period_end": shift(F.col("period_start"), 1, config.period),
            "event_rate_per_day": F.coalesce("event_rate_per_day", F.lit(0.0)),
        }
    )
    trailing = Window.orderBy("period_start").rowsBetween(1 - config.rolling_window, 0)
    enough = F.count(F.lit(1)).over(trailing) >= config.minimum_periods
    return filled.withColumn("rolling_event_count_mean", F.when(enough, F.avg("event_count").over(trailing)))


def long_form(wide: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """(keys, metric, value): a row for each metric."""
    return wide.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(
        keys, list(metrics), "metric", "value"
    )


def distribution_columns(config: BaselineConfig, value: str = "value") -> list[Column]:
    """Count, mean, median, population deviation, range and percentiles of the values that are there."""
    v = F.col(value)
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.median(v).alias("median"),
        F.stddev_pop(v).alias("standard_deviation"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.percentile(v, F.lit(config.lower_percentile / 100)).alias("lower_percentile"),
        F.percentile(v, F.lit(config.upper_percentile / 100)).alias("upper_percentile"),
    ]


def distributions(periods: DataFrame, config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """The distribution of each metric over the periods."""
    return long_form(periods, ["period_start"], METRICS).groupBy("metric").agg(*distribution_columns(config))


def comparison_columns(value: Column) -> dict[str, Column]:
    """rank, difference, ratio and class of a value beside mean, lower_percentile, upper_percentile, below and n."""
    mean, low, high = F.col("mean"), F.col("lower_percentile"), F.col("upper_percentile")
    known = value.isNotNull() & mean.isNotNull() & low.isNotNull()
    return {
        "percentile_rank": F.when(known, 100 * F.col("below") / F.col("n")),
        "absolute_difference": F.when(known, value - mean),
        "ratio": F.when(known, F.when(mean != 0, value / mean).when(value == 0, 1.0)),
        "classification": F.when(~known, "unavailable")
        .when(value < low, "below_historical_range")
        .when(value > high, "above_historical_range")
        .otherwise("within_historical_range"),
    }


def compare(
    df: DataFrame,
    periods: DataFrame,
    current_start: datetime,
    current_end: datetime,
    config: BaselineConfig = BaselineConfig(),
    **columns: str,
) -> DataFrame:
    """A row for each primary metric of [current_start, current_end) beside the distribution over periods."""
    if current_end <= current_start:
        raise ValueError("current_end must be later than current_start")
    events = normalized(df, **columns).where((F.col("time") >= F.lit(current_start)) & (F.col("time") < F.lit(current_end)))
    days = (current_end - current_start).total_seconds() / 86_400
    current = events.agg(*summary_columns()).withColumn("event_rate_per_day", F.col("event_count") / days)
    values = long_form(current.withColumn("k", F.lit(0)), ["k"], PRIMARY).select("metric", F.col("value").alias("current_value"))
    history = long_form(periods, ["period_start"], PRIMARY)
    joined = history.join(F.broadcast(values), "metric")
    below = F.count_if(F.col("value") <= F.col("current_value")).alias("below")
    spread = joined.groupBy("metric", "current_value").agg(*distribution_columns(config), below)
    return spread.withColumns(comparison_columns(F.col("current_value"))).drop("below")


def scored(compared: DataFrame, keys: list[str], config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """compared (keys, metric, current_value, mean, percentile_rank) with weight, direction, raw and weighted scores.

    Weights are shared out among the metrics that are available for a key.
    """
    spark = compared.sparkSession
    weights = spark.createDataFrame(
        [(k, m.name, m.weight, m.two_sided) for k, m in enumerate(config.metrics)],
        "position int, metric string, weight double, two_sided boolean",
    )
    spot = compared.join(F.broadcast(weights), "metric")
    value, mean, rank = F.col("current_value"), F.col("mean"), F.col("percentile_rank")
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in (value, mean, rank)]
    available = finite[0] & finite[1] & finite[2] & rank.between(0, 100)
    one_sided = F.greatest(F.lit(0.0), 2 * (rank - 50))
    raw = F.least(F.lit(100.0), F.when(F.col("two_sided"), 2 * F.abs(rank - 50)).otherwise(one_sided))
    total = F.sum(F.when(F.col("available"), F.col("weight"))).over(Window.partitionBy(*keys))
    return (
        spot.withColumn("available", F.coalesce(available, F.lit(False)))
        .withColumn("raw_score", F.when(F.col("available"), raw))
        .withColumn("normalized_weight", F.when(F.col("available"), F.col("weight") / total).otherwise(0.0))
        .withColumn("weighted_score", F.col("raw_score") * F.col("normalized_weight"))
        .withColumn(
            "direction",
            F.when(~F.col("available"), "unavailable").when(value > mean, "above").when(value < mean, "below").otherwise("typical"),
        )
    )


def level(score: Column, config: AnomalyConfig = AnomalyConfig()) -> Column:
    chain = F.when(score.isNull(), "unavailable")
    for limit, name in reversed(config.levels):
        chain = chain.when(score >= limit, name)
    return chain.otherwise("typical")


def anomaly_scores(compared: DataFrame, keys: list[str], config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """One row for each key: the score from 0 to 100, its level and what contributed most (the first among equals)."""
    parts = scored(compared, keys, config)
    made = parts.groupBy(*keys).agg(
        F.sum("weighted_score").alias("sum"),
        F.count_if("available").alias("available_metric_count"),
        F.max(F.when(F.col("available"), F.struct("weighted_score", -F.col("position"), "metric"))).alias("best"),
    )
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("sum")))
    scored_rows = made.withColumn("score", F.when(F.col("sum").isNotNull(), bounded)).drop("sum")
    return scored_rows.withColumns(
        {
            "level": level(F.col("score"), config),
            "configured_metric_count": F.lit(len(config.metrics)).cast("long"),
            "strongest_metric": F.col("best.metric"),
        }
    ).drop("best")

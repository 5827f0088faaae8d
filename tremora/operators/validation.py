"""Column checks, tolerant and strict normalisation, filters and the keep-last rule."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.seismic import number

ORDINAL = "__ordinal"


def require_columns(df: DataFrame, names: Iterable[str], what: str = "DataFrame") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def utc_time(value: Column) -> Column:
    """A timestamp from a timestamp or ISO text, seconds optional; the job fails on text that isn't a time."""
    with_seconds = F.regexp_replace(value.cast("string"), r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d)(?!:)", "$1:00")
    parsed = F.coalesce(value.try_cast("timestamp"), with_seconds.try_cast("timestamp"))
    wrong = value.isNotNull() & parsed.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a timestamp: "), value.cast("string")))).otherwise(parsed)


def keep_last(df: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with the same key, the last by input order. df has the ordinal column, which is dropped.

    An aggregate that is combined before the shuffle: a key with very many rows doesn't gather them in one task.
    """
    last = F.max_by(F.struct("*"), ORDINAL).alias("last")
    keys = [F.col(c).alias(f"__key{k}") for k, c in enumerate(key)]
    return df.groupBy(*keys).agg(last).select("last.*").drop(ORDINAL)


def with_ordinal(df: DataFrame) -> DataFrame:
    """Input order as a column, unless a source already put it there."""
    return df if ORDINAL in df.columns else df.withColumn(ORDINAL, F.monotonically_increasing_id())


def validated(df: DataFrame, value_column: str = "magnitude") -> DataFrame:
    """The event catalog that daily metrics read: typed, without rows that lack an id or a time, one row per event.

    Magnitudes that aren't numbers become null; times that aren't fail. Other columns are kept.
    """
    require_columns(df, ["event_id", "event_time_utc", value_column])
    typed = with_ordinal(df).withColumns(
        {"event_time_utc": utc_time(F.col("event_time_utc")), value_column: number(F.col(value_column))}
    )
    known = typed.where(F.col("event_id").isNotNull() & F.col("event_time_utc").isNotNull())
    return keep_last(known, [c for c in ("source", "event_id") if c in df.columns])


def strict_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df whose given columns are doubles: null stays, NaN and infinities fail the job, booleans fail at once."""
    kinds = dict(df.dtypes)
    if wrong := [c for c in columns if kinds[c] == "boolean"]:
        raise TypeError(f"values must be numeric, not boolean: {', '.join(wrong)}")

    def guard(name: str) -> Column:
        value = F.col(name).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{name} values must be finite when present"))).otherwise(value)

    return df.withColumns({c: guard(c) for c in columns})


def normalized(df: DataFrame, time: str = "time", magnitude: str = "magnitude", depth: str = "depth") -> DataFrame:
    """(time, magnitude, depth) for baselines; rows without a time are left out, bad values fail."""
    require_columns(df, [time, magnitude, depth])
    chosen = df.select(
        utc_time(F.col(time)).alias("time"), F.col(magnitude).alias("magnitude"), F.col(depth).alias("depth")
    )
    return strict_numbers(chosen, ["magnitude", "depth"]).where("time is not null")


def within_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Closed on all four sides; a box over the date line isn't allowed."""
    if not (-90 <= south <= north <= 90 and -180 <= west <= east <= 180):
        raise ValueError("bounds must be ordered and within the globe")
    return lat.between(south, north) & lon.between(west, east)


def query_filter(
    df: DataFrame,
    start: datetime,
    end: datetime,
    box: tuple[float, float, float, float] | None = None,
    minimum_magnitude: float | None = None,
) -> DataFrame:
    """Events of a half-open time range, a closed box and a least magnitude; without magnitude they fail the latter."""
    if start >= end:
        raise ValueError("start must be earlier than end")
    kept = df.where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))
    if box:
        kept = kept.where(within_box(F.col("latitude"), F.col("longitude"), *box))
    return kept if minimum_magnitude is None else kept.where(F.col("magnitude") >= minimum_magnitude)


def validity(df: DataFrame) -> DataFrame:
    """df with reason: why a row can't be a catalog event, null if it can."""
    lat, lon = F.col("latitude"), F.col("longitude")
    checks = (
        (F.coalesce(F.trim("event_id"), F.lit("")) == "", "event_id"),
        (F.coalesce(F.trim("source"), F.lit("")) == "", "source"),
        (F.col("time").isNull(), "time"),
        (lat.isNull() | F.isnan(lat) | ~lat.between(-90, 90), "latitude"),
        (lon.isNull() | F.isnan(lon) | ~lon.between(-180, 180), "longitude"),
        (F.col("depth").isNull() | F.isnan("depth"), "depth"),
        (F.coalesce(F.isnan("magnitude"), F.lit(False)), "magnitude"),
    )
    chain = F.when(*checks[0])
    for check in checks[1:]:
        chain = chain.when(*check)
    return df.withColumn("reason", chain)


def fail_on_duplicates(df: DataFrame, key: str) -> DataFrame:
    """df, but the job fails where a key stands twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(
        F.col(key)
    )
    return df.withColumn(key, checked)

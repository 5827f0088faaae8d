"""Set operations on catalogs: revisions, merge with counts, duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("source", "event_id")


def revision_rank(df: DataFrame) -> Column:
    """What decides between revisions: update time or else event time, event time, then the row as text."""
    text = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns))
    return F.struct(F.coalesce("updated_at", "time").alias("updated"), F.col("time").alias("time"), text.alias("text"))


def winners(df: DataFrame) -> DataFrame:
    """The newest revision of every event.

    The rank is aggregated before the shuffle, so many revisions of one event don't meet in one task.
    """
    packed = df.select(*KEY, F.struct(revision_rank(df).alias("rank"), F.struct("*").alias("row")).alias("candidate"))
    return packed.groupBy(*KEY).agg(F.max("candidate").alias("best")).select("best.row.*")


def first_newest(df: DataFrame, ordinal: str) -> DataFrame:
    """The newest update of every event, the earliest in input order among equals; combined before the shuffle."""
    age = F.struct((-F.unix_micros(F.coalesce("updated_at", "time"))).alias("age"), F.col(ordinal).alias("order"))
    keys = [F.col(c).alias(f"__key{k}") for k, c in enumerate(KEY)]
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), age).alias("first")).select("first.*")


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalog after an upsert of incoming into existing, by newest revision."""
    return winners(existing.unionByName(incoming))


def merge_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(inserted, updated, unchanged, final_count): how the events of the merged catalog came about."""
    before = winners(existing).select(*KEY, F.struct(*existing.columns).alias("old"))
    after = merge(existing, incoming).select(*KEY, F.struct(*existing.columns).alias("new"))
    same = [before[k].eqNullSafe(after[k]) for k in KEY]
    return after.join(before, same, "left").agg(
        F.count_if(F.col("old").isNull()).alias("inserted"),
        F.count_if(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("updated"),
        F.count_if(F.col("old").eqNullSafe(F.col("new"))).alias("unchanged"),
        F.count(F.lit(1)).alias("final_count"),
    )

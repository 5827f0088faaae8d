"""Structured Streaming over catalogs: daily counts with watermarks, and upserts that take late revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tremora.sources.catalogs import CatalogStore
from tremora.sources.schemas import CATALOG


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet catalogs as they arrive in a folder."""
    return spark.readStream.schema(CATALOG).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Counts and largest magnitudes by UTC day; days close once the watermark has passed them. Exact duplicates within
    the watermark count once."""
    once = events.withWatermark("time", late).dropDuplicatesWithinWatermark(["source", "event_id"])
    return once.groupBy(F.window("time", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("event_count"), F.max("magnitude").alias("maximum_magnitude")
    ).select(F.col("day.start").cast("date").alias("date"), "event_count", "maximum_magnitude")


def upsert_stream(events: DataFrame, store: CatalogStore, region: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into the store by newest revision. There is no watermark: a revision may come at any
    time. Only months that a batch touches are written anew. A batch that runs again merges to the same catalog."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(region, batch)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

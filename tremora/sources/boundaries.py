"""Plate-boundary steps from fifteen-column text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremora.sources.schemas import STEP_FIELDS

#: Ages above this mean that none is known.
OLDEST = 180.0


def _longitude(value: Column) -> Column:
    return F.when(value > 180, value - 360).when(value < -180, value + 360).otherwise(value)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return parse_steps(spark.read.text(path))


def parse_steps(lines: DataFrame) -> DataFrame:
    """Steps of lines(value). The boundary is two plate codes around a mark of polarity, a colon may precede it; a star
    after the class puts the step in an orogen. Lines of other widths and repeated numbers fail the job."""
    parts = F.split(F.trim("value"), r"\s+")
    words = lines.where(F.length(F.trim("value")) > 0).select("value", parts.alias("w"))
    checked = F.when(F.size("w") != len(STEP_FIELDS), F.raise_error(F.concat(F.lit("not a step: "), F.col("value")))).otherwise(F.col("w"))
    named = words.select(checked.alias("w")).select(*(F.get("w", F.lit(k)).alias(n) for k, n in enumerate(STEP_FIELDS)))
    boundary = F.regexp_replace("boundary_id", "^:+", "")
    kind = F.regexp_replace("boundary_class", "^:+", "")
    numbers = {n: F.col(n).cast("double") for n in STEP_FIELDS if n not in ("sequence", "boundary_id", "boundary_class")}
    made = named.withColumns(
        numbers
        | {
            "sequence": F.regexp_replace("sequence", ":", "").cast("int"),
            "boundary_id": boundary,
            "left_plate": F.substring(boundary, 1, 2),
            "polarity": F.substring(boundary, 3, 1),
            "right_plate": F.substring(boundary, 4, 2),
            "in_orogen": F.endswith(F.col("boundary_class"), F.lit("*")),
            "boundary_class": F.regexp_replace(kind, r"\*+$", ""),
        }
    ).withColumns(
        {
            "age": F.when(F.col("age") <= OLDEST, F.col("age")),
            "start_longitude": _longitude(F.col("start_longitude")),
            "end_longitude": _longitude(F.col("end_longitude")),
        }
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("sequence"))
    step = F.when(n > 1, F.raise_error(F.lit("duplicate step number"))).otherwise(F.format_string("pb2002-step-%04d", "sequence"))
    return made.withColumn("step_id", step).orderBy("sequence")

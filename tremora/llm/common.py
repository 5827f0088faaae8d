"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators.lineage import bounded, cut, ensure_checkpoint_dir, fits

__all__ = [
    "bounded", "cut", "ensure_checkpoint_dir", "fits", "free_names", "lower_ascii", "plain_words", "read_table", "small_batches", "text_of", "white_words",
]

#: The ASCII white space of the word rule, and the separators of the letter-and-digit word rule.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SEPARATOR_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind each as it takes to be none of df's columns."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Spark hand Python at most so many rows at once: whole texts are long, and a batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_of(name: str) -> Column:
    """The column as text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def white_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; an empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_RUN, -1)).otherwise(F.array().cast("array<string>"))


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII, case as it stands."""
    return F.filter(F.split(text, SEPARATOR_RUN, -1), lambda x: F.length(x) > 0)


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and nothing else: lower() where the text is all ASCII, a character map elsewhere."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, UPPER.lower())
    )

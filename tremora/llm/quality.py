"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

The repetition count works per row: the hashes of a text's windows stay primitive longs, a set of them tells
whether any window recurs, and only texts with such windows are sorted. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import WHITE, text_of, white_words

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für ich im in ist mit nicht sich sie sind und von war wie zu zum zur",
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous",
    "es": "a al como con de del el en es esta este ha la las le lo los más no para pero por que se si sin su sus un una uno y ya",
}
SYMBOLS = "[#*$%&|<>]"
SHOUTS = "!{2,}"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A text fails when metric is under low or over high; a missing bound doesn't hold."""

    metric: str
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        value = F.col(self.metric)
        bounds = [b for b in (None if self.low is None else value < self.low, None if self.high is None else value > self.high) if b is not None]
        return reduce(lambda a, b: a | b, bounds, F.lit(False))


#: Lengths, symbols, stop words and lines; each ratio is by word or by line.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=1.5, high=20),
    Rule("repeat_ratio", high=0.2),
    Rule("symbol_ratio", high=0.25),
    Rule("shout_ratio", high=0.25),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.6),
)
BASE_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _window_hashes(words: Column) -> Column:
    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, WINDOW))))


def _covered(starts: Column) -> Column:
    """Positions that windows at these ascending starts cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            (s + WINDOW).alias("end"), (acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n")
        ),
        lambda acc: acc["n"].cast("long"),
    )


def measure(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row (struct row, the metrics, failed array, base_failed, kept) for each row of docs, in place.

    row holds every input column, so that names may clash with the metrics. A null text counts as empty: no words,
    so it fails the length rule. Repeated rows and ties are judged each for itself; an empty table gives an empty one.
    """
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    base = docs.select(F.struct("*").alias("row"), text_of(text_col).alias("text"))
    split = base.select("row", "text", white_words(F.col("text")).alias("words"), lines.alias("lines"))
    counted = split.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(SHOUTS)).cast("long").alias("n_shouts"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stops"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("words")).alias("hashes"),
    )
    numbered = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = counted.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), numbered),
    )
    recurring = F.filter(
        "sorted",
        lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]),
    )
    starts = F.array_sort(F.transform(recurring, lambda x: x["i"]))
    measured = sorted_.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(_covered(starts), F.lit(0).cast("long")).alias("n_repeat_words"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_shouts"), F.col("n_words")).alias("shout_ratio"),
        # One more than counted, so that a short text without any isn't failed for it.
        _ratio(F.col("n_stops") + 1, F.col("n_words")).alias("stop_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
    ).withColumn("repeat_ratio", _ratio(F.col("n_repeat_words"), F.col("n_words")))
    failed = F.filter(
        F.array(*(F.when(rule.fails(), F.lit(rule.metric)) for rule in rules)), lambda x: x.isNotNull()
    )
    return (
        measured.withColumn("failed", failed)
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that pass all rules, with the columns of docs.

    The row number keeps the optimizer from pushing the verdict below the projections, where it would be spelled out
    once for every use of every metric.
    """
    judged = measure(docs, text_col, rules).withColumn("gate", F.monotonically_increasing_id())
    return judged.where("kept and gate >= 0").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of documents."""
    return measure(docs).select(
        "row.doc_id", *BASE_METRICS, "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules")
    )

"""Toxicity by class-conditional Kneser-Ney models of expressions, in DataFrame operations.

The expressions of a text are its distinct lower-case words: each whole, and by its beginnings of 2, 4, 6, ... letters,
so that a word never seen still counts for what it begins with. Toxic and ordinary texts each have a model of every
kind of expression (a length of beginning, or whole words): absolutely discounted counts of texts, interpolated with an
estimate that the classes share, Kneser and Ney's continuation count: in how many different words of the whole corpus
the expression stands. A rare expression therefore falls back to the same estimate in both classes and says nothing.

A text is judged by three measures. The first is the difference of its two length-normalised log-likelihoods: over all of
its words, whichever class they speak for, a word that fewer than KNOWN labelled texts have counting by what the classes
leave to such words. Toxic words are few among many, so two more follow: the average over all words of what exceeds TELLING
in each word's most telling expression, and the average over the LOUD loudest words alone. A logistic curve, fitted on
labelled texts that the counts of the fit leave out, turns the three into a score; the counts of the final model hold all
labelled texts.

Counts are distributed tables. Only the telling expressions and the corpus words that have one are joined back, as
hashes and numbers, by broadcast up to a bound and by a shuffle beyond it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import bounded, cut, plain_words, text_of

#: Letters that a beginning grows by, and the longest beginning; a longer word is also an expression as a whole.
STEP, LONGEST = 2, 32
DISCOUNT = 0.9
#: An expression tells something from this log-likelihood ratio on.
TELLING = 1.5
#: Labelled texts that must have a word before it has a likelihood of its own; the labels' bound bounds such words.
KNOWN = 5
#: Loudest words that are averaged, and the words that the ratio of a shorter text is shared out among.
LOUD, LEAST_WORDS = 2, 20
#: Labelled texts to learn from, about so many at most: all below that, else an even share by hash.
TRAIN_TEXTS = 200_000
#: Of five parts by crc32 of the id: the one held out, and the one that the score is calibrated on.
PARTS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Rows of (hash, ratio) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Stands behind the words of every text, and so counts how often a row is repeated.
MARK = 0
CLASSES = ("toxic", "ordinary")


def part_of(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo PARTS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % PARTS


def training_labels(labels: DataFrame, most: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, kind, calibration) of labels outside the held-out part, about `most` at most; kind is toxic or ordinary.

    Labels without an id or a verdict teach nothing; of several for one id, toxic wins.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (part_of(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.when(F.max("toxic") > 0, CLASSES[0]).otherwise(CLASSES[1]).alias("kind"))
    )
    share = min(1.0, most / max(1, known.count()))
    if share < 1.0:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return cut(known.withColumn("calibration", part_of(F.col("doc_id")) == CALIBRATION))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(plain_words(F.lower(text)))


def vocabulary(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, toxic, ordinary, toxic_fit, ordinary_fit): every word of docs, and how many texts of known(doc_id, kind,
    calibration) have it; the _fit counts leave the calibration part out. Counted before the shuffle.

    The bounded sample of labels is broadcast, so no text is moved.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    if known is None:
        read = read.select("text", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("calibration"))
    else:
        read = read.join(F.broadcast(known), "doc_id", "left")
    words = read.select(F.explode(distinct_words(F.col("text"))).alias("word"), "kind", "calibration")
    return words.groupBy("word").agg(
        *(F.count_if(F.col("kind") == k).alias(k) for k in CLASSES),
        *(F.count_if((F.col("kind") == k) & ~F.col("calibration")).alias(f"{k}_fit") for k in CLASSES),
    )


def expressions(word: Column) -> Column:
    """Array of (size, code) of a word: its beginnings by length, and the whole word under size 0."""
    reach = F.least(F.length(word), F.lit(LONGEST))
    sizes = F.when(reach >= STEP, F.sequence(F.lit(STEP), reach, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    begun = F.transform(sizes, lambda k: F.struct(k.alias("size"), F.xxhash64(F.substring(word, F.lit(1), k)).alias("code")))
    return F.concat(begun, F.array(F.struct(F.lit(0).alias("size"), F.xxhash64(word).alias("code"))))


def _likelihood(kind: str, suffix: str, shared: Column | None) -> Column:
    """P(expression | kind), interpolated with the shared estimate; without one, what the class leaves to expressions
    that it hasn't got, to be multiplied by that estimate."""
    passed_on = DISCOUNT * F.col(f"kinds_{kind}{suffix}") * (F.lit(1.0) if shared is None else shared)
    kept = F.lit(0.0) if shared is None else F.greatest(F.col(f"{kind}{suffix}") - DISCOUNT, F.lit(0.0))
    return (kept + passed_on) / F.col(f"all_{kind}{suffix}")


def _ratio(suffix: str, shared: Column | None) -> Column:
    """log P(expression | toxic) - log P(expression | ordinary); null unless both classes have expressions."""
    both = (F.col(f"all_toxic{suffix}") > 0) & (F.col(f"all_ordinary{suffix}") > 0)
    return F.when(both, F.log(_likelihood(CLASSES[0], suffix, shared)) - F.log(_likelihood(CLASSES[1], suffix, shared)))


def judged_expressions(vocab: DataFrame) -> DataFrame:
    """(size, code, texts, ratio, ratio_fit, unknown, unknown_fit) of every expression of labelled texts.

    texts counts labelled texts; unknown is the ratio of an expression of that size that no labelled text has.
    """
    counts = [f"{k}{s}" for s in ("", "_fit") for k in CLASSES]
    spread = vocab.select(F.explode(expressions(F.col("word"))).alias("e"), *counts).select("e.*", *counts)
    counted = spread.groupBy("size", "code").agg(F.count(F.lit(1)).alias("words"), *(F.sum(c).alias(c) for c in counts))
    # Of expressions that no labelled text has, only the shared total matters, and the words' lengths tell that.
    seen = cut(counted.where("toxic + ordinary > 0"))
    totals = seen.groupBy("size").agg(
        *(F.sum(c).alias(f"all_{c}") for c in counts), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in counts)
    )
    lengths = vocab.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("reach")).agg(F.count(F.lit(1)).alias("n"))
    sizes = F.concat(F.when(F.col("reach") >= STEP, F.sequence(F.lit(STEP), F.col("reach"), F.lit(STEP))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)))
    shared = lengths.select(F.explode(sizes).alias("size"), "n").groupBy("size").agg(F.sum("n").alias("all_words"))
    # One row for each size of expression: LONGEST / STEP + 1 rows.
    placed = seen.join(F.broadcast(totals.join(F.broadcast(shared), "size")), "size")
    share = F.col("words") / F.col("all_words")
    return placed.select(
        "size",
        "code",
        (F.col("toxic") + F.col("ordinary")).alias("texts"),
        *(F.when(F.col(f"toxic{s}") > 0, _ratio(s, share)).alias(f"ratio{s}") for s in ("", "_fit")),
        *(_ratio(s, share).alias(f"full{s}") for s in ("", "_fit")),
        *(_ratio(s, None).alias(f"unknown{s}") for s in ("", "_fit")),
    )


def telling_expressions(vocab: DataFrame, least: float = TELLING) -> DataFrame:
    """(size, code, ratio, ratio_fit) of the expressions whose ratio under either model is `least` or more; expressions
    that no toxic text has tell nothing."""
    return _telling(judged_expressions(vocab), least)


def _telling(judged: DataFrame, least: float = TELLING) -> DataFrame:
    return judged.where(F.greatest("ratio", "ratio_fit") >= least).select("size", "code", "ratio", "ratio_fit")


def known_words(judged: DataFrame, least: int = KNOWN) -> DataFrame:
    """(key, full, full_fit, unknown, unknown_fit): the log-likelihood ratio, of either sign, of every whole word that
    `least` labelled texts have, and the ratio of the other words."""
    whole = judged.where((F.col("size") == 0) & (F.col("texts") >= least))
    return whole.select(F.col("code").alias("key"), "full", "full_fit", "unknown", "unknown_fit")


def loud_words(vocab: DataFrame, telling: DataFrame, ratio: str = "ratio") -> DataFrame:
    """(key, ratio): hash of every word of vocab that has a telling expression, and its most telling one's ratio."""
    model = bounded(telling.where(F.col(ratio) >= TELLING).select("size", "code", F.col(ratio).alias("ratio")), BROADCAST_ROWS)
    spread = vocab.select(F.xxhash64("word").alias("key"), F.explode(expressions(F.col("word"))).alias("e"))
    return spread.select("key", "e.*").join(model, ["size", "code"]).groupBy("key").agg(F.max("ratio").alias("ratio"))


def measured(docs: DataFrame, loud: DataFrame, known: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(doc_id, text_key, likelihood, loudest, average) for the texts of docs(doc_id, text) that have a loud word or a
    known one; with known words for every text. Texts without words have a likelihood of 0."""
    words = F.transform(distinct_words(F.col("text")), lambda w: F.xxhash64(w))
    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words.alias("words"))
    table, none = loud.select("key", "ratio"), F.lit(None).cast("double")
    if known is None:
        table, unknown = table.withColumns({"full": none, "unknown": none}), F.lit(0.0)
    else:
        own = known.select("key", F.col(f"full{suffix}").alias("full"), F.col(f"unknown{suffix}").alias("unknown"))
        # Not made of a Python list: that would start Python on the executors.
        mark = known.sparkSession.range(0, 1, 1, 1).select(F.lit(MARK).cast("long").alias("key"), *(none.alias(c) for c in ("ratio", "full", "unknown")))
        table = table.join(own, "key", "full").select("key", "ratio", "full", "unknown").unionByName(mark)
        # The same number in every row; 0 if there is no known word.
        unknown = F.lit(own.agg(F.coalesce(F.max("unknown"), F.lit(0.0))).first()[0])
    spread = read.select(
        "doc_id", "text_key", F.size("words").alias("n"), F.explode(F.concat("words", F.array(F.lit(MARK).cast("long")))).alias("key")
    )
    # Repeated rows of a text add nothing to its set of words, and the mark tells how many they are.
    found = spread.join(bounded(table, BROADCAST_ROWS), "key").groupBy("doc_id", "text_key", "n").agg(
        F.sort_array(F.collect_set(F.when(F.col("ratio").isNotNull(), F.struct("ratio", "key"))), asc=False).alias("found"),
        F.sum(F.col("full") - unknown).alias("beyond"),
        F.greatest(F.lit(1), F.count_if(F.col("key") == MARK)).alias("copies"),
    )
    ratios = F.transform("found", lambda x: x["ratio"])
    total = F.aggregate(ratios, F.lit(0.0), lambda a, r: a + (r - TELLING))
    top = F.aggregate(F.slice(ratios, 1, LOUD), F.lit(0.0), lambda a, r: a + r)
    missing = F.lit(LOUD) - F.least(F.lit(LOUD), F.size("found"))
    whole = F.coalesce(F.col("beyond"), F.lit(0.0)) / F.col("copies") + F.col("n") * unknown
    return found.select(
        "doc_id",
        "text_key",
        (whole / F.greatest("n", F.lit(1))).alias("likelihood"),
        ((top + missing * TELLING) / LOUD).alias("loudest"),
        F.log1p(1000 * total / F.greatest("n", F.lit(LEAST_WORDS))).alias("average"),
    )


MEASURES = ("likelihood", "loudest", "average")
#: Of a text without words.
LEAST_MEASURES = (0.0, TELLING, 0.0)


@dataclass(frozen=True)
class ToxicityModel:
    """Telling expressions (size, code, ratio, ratio_fit), known words (key, full, ...), and the slopes and intercept of
    the curve over the three measures."""

    telling: DataFrame
    known: DataFrame
    curve: tuple[float, ...]

    def score(self) -> Column:
        """Between 0 and 1, from the measures of a text; null ones are those of a text without words."""
        z = F.lit(self.curve[-1])
        for slope, name, least in zip(self.curve, MEASURES, LEAST_MEASURES, strict=False):
            z = z + slope * F.coalesce(F.col(name), F.lit(least))
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, ...]:
    """A slope for each measure and an intercept over measures of unit spread, with a small penalty; Newton's steps,
    halved until the loss falls.

    The rarer class counts more, by the root of how much rarer it is. Without both classes, or with a falling curve,
    a fixed curve over the loudest words.
    """
    usual = (0.0, 2.0, 0.0, -8.0)
    if not (y == 1).any() or not (y == 0).any():
        return usual
    weight = np.where(y == 1, math.sqrt((y == 0).sum() / (y == 1).sum()), 1.0)
    weight /= weight.sum()
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    features = np.column_stack(((x - middle) / spread, np.ones(len(x))))
    ridge = np.array([penalty] * x.shape[1] + [1e-9])

    def loss(b: np.ndarray) -> float:
        z = features @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (b * b))

    b = np.zeros(len(ridge))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ b, -500, 500)))
        gradient = features.T @ (weight * (p - y)) + ridge * b
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag(ridge)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
    slopes = b[:-1] / spread
    found = (*slopes, b[-1] - slopes @ middle)
    return tuple(map(float, found)) if b[:-1].sum() > 0 else usual


def train(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, vocab: DataFrame | None = None) -> ToxicityModel:
    """Learn from docs(doc_id, text) with labels(doc_id, toxic); known and vocab are made where they aren't given.

    Every row of docs with a label counts as a text. Without labels of both classes nothing tells, and every text has
    the same score. Empty tables, null ids and null texts are no error; other columns aren't read.
    """
    known = training_labels(labels) if known is None else known
    vocab = cut(vocabulary(docs, known)) if vocab is None else vocab
    judged = judged_expressions(vocab)
    # Of all judged expressions only the telling ones and the known whole words are kept.
    kept = cut(judged.where((F.greatest("ratio", "ratio_fit") >= TELLING) | ((F.col("size") == 0) & (F.col("texts") >= KNOWN))))
    telling, words = _telling(kept), known_words(kept)
    held = known.where("calibration").select("doc_id", "kind")
    read = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(held.select("doc_id")), "doc_id", "left_semi")
    loud = cut(loud_words(vocab, telling, "ratio_fit"))
    measures = measured(read, loud, words, "_fit").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in MEASURES))
    has_text = read.select("doc_id").distinct()
    # One row for each label of the bounded sample's calibration part.
    rows = held.join(has_text, "doc_id").join(measures, "doc_id", "left").select(
        *(F.coalesce(c, F.lit(least)).alias(c) for c, least in zip(MEASURES, LEAST_MEASURES, strict=True)), "kind"
    ).toPandas()
    curve = _logistic(rows[list(MEASURES)].to_numpy(dtype=float), (rows["kind"] == CLASSES[0]).to_numpy(dtype=float))
    return ToxicityModel(telling, words, curve)


def score(
    docs: DataFrame, model: ToxicityModel, vocab: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, score) for each row of docs, by the whole text and nothing else.

    Null and empty texts score like a text without toxic words; repeated rows each get their score, ids may be null or
    repeat with other texts, other columns aren't read, an empty table gives an empty result.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    loud = loud_words(vocabulary(read) if vocab is None else vocab, model.telling)
    found = measured(read, cut(loud), model.known)
    keyed = read.select("doc_id", F.xxhash64("text").alias("text_key"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
    return keyed.alias("d").join(found.alias("m"), same, "left").select(
        F.col("d.doc_id").alias("doc_id"), model.score().alias("score")
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false without an id), score and predicted for each document."""
    known = training_labels(labels)
    vocab = cut(vocabulary(docs, known))
    model = train(docs, labels, known, vocab)
    return score(docs, model, vocab).select(
        "doc_id",
        F.coalesce(part_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

"""Benchmark decontamination through a positional inverted index of the training tokens.

Every benchmark window is looked up from its rarest term on: the corpus counts of all benchmark terms tell which one
that is. The index holds the posting lists (text, position) of the rarest terms and of those second rarest ones that
are not much more frequent. A window's lists, adjusted by the offsets of their terms in the window, are intersected:
where all of them name the same start in a text stands a candidate. Lists of frequent terms are never stored; postings
of a rarest term bring the tokens around them along instead, in which a candidate's other terms are compared, and, for
proximity, all terms of the window are sought in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import bounded, cut, fits, free_names, lower_ascii, plain_words, text_of

WINDOW = 10
#: A proximity match holds all distinct terms of a window within this many tokens more than the window has.
SLACK = 5
#: A second list is stored if its term is at most so many times as frequent as the window's rarest one.
LISTED = 16

def _lowered(words: Column) -> Column:
    return F.transform(words, lower_ascii)


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item, terms): the windows of each item, one row for an item and a window. window numbers equal terms."""
    words = benchmark.select(
        F.col(id_col).alias("item"), _lowered(plain_words(text_of(text_col))).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))
    return (
        words.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("terms"))
        .distinct()
        .select(F.sha2(F.array_join("terms", " "), 256).alias("window"), "item", "terms")
    )


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often each term of terms(term) stands in the corpus; counted before the shuffle."""
    tokens = docs.select(F.explode(plain_words(text_of(text_col))).alias("word")).select(
        lower_ascii(F.col("word")).alias("term")
    )
    return tokens.join(bounded(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, terms, anchor, anchor_at, second, second_at, listed): the two rarest terms of each window, their places,
    and whether the second one's list is stored, too.

    Windows with a term that the corpus lacks can't occur and are left out; ties go to the first place.
    """
    distinct = found.select("window", "terms").distinct()
    placed = distinct.select("window", F.posexplode("terms").alias("at", "term")).join(bounded(counts), "term", "left")
    ranked = placed.groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("ranked"),
        F.count_if(F.col("n").isNull()).alias("missing"),
    )
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return distinct.join(ranked.where("missing = 0"), "window").select(
        "window",
        "terms",
        first["term"].alias("anchor"),
        first["at"].alias("anchor_at"),
        second["term"].alias("second"),
        second["at"].alias("second_at"),
        F.coalesce(second["n"] <= LISTED * first["n"], F.lit(False)).alias("listed"),
    )


def postings(docs: DataFrame, terms: DataFrame, reach: int, text_col: str = "text") -> DataFrame:
    """The positional index of terms(term, rarest): (id, text_key, term, position, first, around) for every place of one.

    For the rarest terms around holds the lower-cased tokens within reach of the position, and first the position of its
    first token; for others it is null. docs has (id, text_key) and the text column.
    """
    places = docs.select("id", "text_key", plain_words(text_of(text_col)).alias("words")).select(
        "id", "text_key", "words", F.posexplode("words").alias("position", "word")
    )
    first = F.greatest(F.col("position") - reach, F.lit(0))
    around = F.slice("words", first + 1, F.col("position") - first + 1 + reach)
    named = places.withColumn("term", lower_ascii(F.col("word")))
    kept = ["id", "text_key", "term", "position", first.alias("first")]
    if fits(terms):
        near = named.join(F.broadcast(terms), "term").select(*kept, F.when(F.col("rarest"), around).alias("near"))
    else:  # what is shuffled is the tokens around a place, not the text for every one of its tokens
        near = named.select(*kept, around.alias("near")).join(terms, "term").withColumn("near", F.when(F.col("rarest"), F.col("near")))
        near = near.drop("rarest")
    return near.withColumn("around", _lowered(F.col("near"))).drop("near")


def matches(index: DataFrame, targets: DataFrame, slack: int | None = None) -> DataFrame:
    """(id, text_key, window, start, n, kind) of the windows that occur; kind is phrase or, with slack, proximity.

    A phrase match starts at start and has n tokens. A proximity match is the first stretch of slack tokens more than
    the window that has the rarest term and every other distinct term of the window, in any order. index is read twice.
    """
    one = index.where("around is not null").join(bounded(targets), F.col("term") == F.col("anchor"))
    one = one.withColumn("start", F.col("position") - F.col("anchor_at"))
    listed = targets.where("listed").select("window", "second", "second_at")
    # What is intersected are starts alone; the tokens around are looked up for those that both lists name.
    two = index.join(bounded(listed), F.col("term") == F.col("second")).withColumn("start", F.col("position") - F.col("second_at"))
    starts = ("id", "text_key", "window", "start")
    first, second = one.where("listed and start >= 0").select(*starts).alias("a"), two.select(*starts).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in starts]
    shared = cut(first.join(second, same[0] & same[1] & same[2] & same[3], "left_semi").distinct())
    shared = shared.toDF(*(f"shared_{c}" for c in starts))
    there = [F.col(c).eqNullSafe(F.col(f"shared_{c}")) if c == "id" else F.col(c) == F.col(f"shared_{c}") for c in starts]
    both = one.where("listed").join(bounded(shared), there[0] & there[1] & there[2] & there[3], "left_semi")
    candidates = both.unionByName(one.where("not listed and start >= 0"))
    inside = F.col("start") - F.col("first") >= 0
    whole = F.slice("around", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.size("terms")) == F.col("terms")
    phrase = candidates.where(inside & whole).select(
        "id", "text_key", "window", "start", F.size("terms").alias("n"), F.lit("phrase").alias("kind")
    )
    if slack is None:
        return phrase
    n, here = F.size("terms") + slack, F.col("position") - F.col("first")

    def holds(before: Column) -> Column:
        stretch = F.slice("around", F.greatest(here - before, F.lit(0)) + 1, n + F.least(here - before, F.lit(0)))
        return F.size(F.array_except("terms", stretch)) == 0

    # The stretch may begin up to n - 1 tokens before the rarest term.
    near = one.where(~F.coalesce(inside & whole, F.lit(False)) & (F.size(F.array_except("terms", "around")) == 0))
    found = near.withColumn("begin", F.get(F.filter(F.reverse(F.sequence(F.lit(0), n - 1)), holds), F.lit(0)))
    low = F.greatest(F.col("position") - F.col("begin"), F.lit(0))
    close = found.where("begin is not null").select(
        "id", "text_key", "window", low.alias("start"), n.alias("n"), F.lit("proximity").alias("kind")
    )
    return phrase.unionByName(close)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    slack: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed documents, matches, windows). Rows of docs are known by id and a hash of their text.

    Null texts and items have no words. Repeated rows of docs match once and are all marked; ids may repeat with
    other texts or be null. Empty tables give no matches. Other columns are left alone.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), F.col(text_col).alias("text")
    )
    found = cut(windows(benchmark, item_col, item_text_col))
    # Short numbers in place of the digests, from here on.
    numbers = cut(found.select(F.col("window").alias("digest")).distinct().select("digest", F.monotonically_increasing_id().alias("number")))
    found = cut(found.join(bounded(numbers), F.col("window") == F.col("digest")).select(F.col("number").alias("window"), "item", "terms"))
    terms = found.select(F.explode("terms").alias("term")).distinct()
    targets = cut(anchored(found, cut(term_counts(keyed, terms))))
    looked_up = targets.select(F.col("anchor").alias("term"), F.lit(True).alias("rarest")).unionByName(
        targets.where("listed").select(F.col("second").alias("term"), F.lit(False).alias("rarest"))
    )
    index = cut(postings(keyed, looked_up.groupBy("term").agg(F.max("rarest").alias("rarest")), WINDOW + (slack or 0)))
    return keyed, cut(matches(index, targets, slack)), found


def _covered(spans: Column) -> Column:
    """Tokens within any of the ascending spans (start, n)."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", slack: int = SLACK) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items, contaminated) for each row of docs.

    items have a window that occurs as it stands, near_items one that occurs so or whose distinct terms stand within
    slack more words than it has; both are sorted as strings. Only phrases count as hits and contaminate.
    """
    keyed, hits, found = find(docs, benchmark, id_col, slack=slack)
    phrase = F.col("kind") == "phrase"
    spans = (
        hits.where(phrase)
        .groupBy("id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
        .select("id", "text_key", _covered(F.col("spans")).alias("n_hit"))
    )
    items = (
        hits.groupBy("id", "text_key", "window")
        .agg(F.max(phrase).alias("phrase"))
        .join(found.select("window", "item"), "window")
        .groupBy("id", "text_key", F.col("item").cast("string").alias("item"))
        .agg(F.max("phrase").alias("phrase"))
        .groupBy("id", "text_key")
        .agg(F.array_sort(F.collect_list("item")).alias("near_items"), F.array_sort(F.collect_list(F.when(F.col("phrase"), F.col("item")))).alias("items"))
    )
    marks = items.alias("i").join(
        spans.alias("s"), F.col("s.id").eqNullSafe(F.col("i.id")) & (F.col("s.text_key") == F.col("i.text_key")), "left"
    ).select("i.id", "i.text_key", "n_hit", "items", "near_items")
    counted = keyed.select("id", "text_key", F.size(plain_words(text_of("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.alias("d").join(
        marks.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.text_key") == F.col("m.text_key")), "left"
    ).select(
        F.col("d.id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs.

    Rows with a null text stay. Other columns may have any names; empty tables leave docs as they are.
    """
    _, hits, _ = find(docs, benchmark, id_col, text_col)
    id_, key = free_names(docs, "marked_id", "marked_key")
    marked = hits.select(F.col("id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_of(text_col)) == F.col(key))
    return docs.join(bounded(cut(marked)), same, "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items."""
    return mark(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )

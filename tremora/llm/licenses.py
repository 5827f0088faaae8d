"""License scans: diagonal voting of word k-grams against license templates, in DataFrame operations only.

Every k-gram of a text votes for the diagonals (its position less the position in a template) on which it lies. Votes
are counted by diagonal, and a diagonal with at least as many votes as those within its template's drift takes over
theirs, so that a word too many or too few doesn't split a notice. Drift is at most a quarter of the template, so the
repeats of a notice never merge. Where merged votes cover enough of the template, the words of the span are held
against the template's, word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremora.llm.common import bounded, cut, lower_ascii, plain_words, text_of

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of licenses in lower case, by label; several may share one.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("all-rights-reserved", "all rights reserved"),
)
GRAM = 3
#: Most diagonals that a notice may drift by, and the part of a template's words that they are at most.
DRIFT, DRIFT_PART = 3, 4
#: Shares of a template's words that the votes must cover, and that must stand in the span within the drift.
COVER, VERIFIED = 0.75, 0.8
#: Candidate texts (id, key and a few numbers for each span) that may be broadcast.
BROADCAST_ROWS = 500_000


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """(gram, template, label, at, size) for each k-gram of each template: as many rows as the templates have words."""
    rows = [(k, label, text.split()) for k, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, words array<string>")
    return table.select(
        "template", "label", F.size("words").alias("size"), "words", F.posexplode("words").alias("at", "word")
    ).where(F.col("at") <= F.col("size") - GRAM).select(
        F.xxhash64("word", *(F.get("words", F.col("at") + k) for k in range(1, GRAM))).alias("gram"),
        "template",
        "label",
        "at",
        "size",
    )


def _phrase_label(words: list[Column], phrases: dict[str, str]) -> Column:
    cases = [
        (reduce(lambda a, b: a & b, (w == F.lit(p) for w, p in zip(words, phrase.split()))), label)
        for phrase, label in phrases.items()
    ]
    return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))


def hits(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """(id, text_key, position, phrase, template, label, at, size): places of phrases and of template k-grams.

    docs has (id, text_key, text). All k-grams are hashed and joined to the templates, which are small and fixed.
    """
    places = docs.select("id", "text_key", plain_words(text_of("text")).alias("words")).select(
        "id", "text_key", "words", F.posexplode("words").alias("position", "word")
    )
    longest = max(GRAM, *(len(p.split()) for p in phrases))
    words = [lower_ascii(F.col("word"))] + [
        lower_ascii(F.get("words", F.col("position") + k)) for k in range(1, longest)
    ]
    grams = places.select(
        "id",
        "text_key",
        "position",
        _phrase_label(words, phrases).alias("phrase"),
        F.xxhash64(*words[:GRAM]).alias("gram"),
    )
    grams = grams.join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram", "left")
    return grams.where("phrase is not null or template is not null").drop("gram").distinct()


def stretches(found: DataFrame) -> DataFrame:
    """(id, text_key, template, size, start, cover): places where a template may start, by the votes that hits show.

    A diagonal stands for those within the drift if none of them has more votes; the first one of equals does.
    """
    at, per = F.col("position") - F.col("at"), ["id", "text_key", "template", "size"]
    votes = (
        found.where("template is not null").groupBy(*per, at.alias("start")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    )
    near = Window.partitionBy(*per).orderBy("start").rangeBetween(-DRIFT, DRIFT)
    drift = F.least(F.lit(DRIFT), F.floor(F.col("size") / DRIFT_PART))
    around = F.filter(
        F.collect_list(F.struct("start", "at")).over(near), lambda v: F.abs(v["start"] - F.col("start")) <= drift
    )
    ahead = F.exists(
        F.col("around"),
        lambda v: (F.size(v["at"]) > F.size("at")) | ((F.size(v["at"]) == F.size("at")) & (v["start"] < F.col("start"))),
    )
    own = F.array_sort(F.array_distinct(F.flatten(F.transform("around", lambda v: v["at"]))))
    merged = votes.withColumn("around", around).where(~ahead).select(*per, "start", own.alias("at"))
    # Template words under the votes: GRAM after each voting place, or as far as the next one.
    words = F.aggregate(
        F.transform("at", lambda a, i: F.least(F.lit(GRAM), F.coalesce(F.get("at", i + 1) - a, F.lit(GRAM)))),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    return merged.select(*per, "start", (words / F.col("size")).alias("cover")).where(F.col("cover") >= COVER)


def verified(docs: DataFrame, candidates: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(id, text_key, spans) for the texts of docs(id, text_key, text) with a span that holds its template's words.

    candidates are stretches; spans are (start, size, label, share) in order, share being that of the template's words
    that stand in the span within the drift. Each word is compared; nothing rests on hashes.
    """
    listed = candidates.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "template", "size"))).alias("places")
    )
    listed = cut(listed.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), "places"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    joined = docs.join(bounded(listed, BROADCAST_ROWS), same).dropDuplicates(["id", "text_key"])
    read = joined.select("id", "text_key", "places", F.transform(plain_words(text_of("text")), lower_ascii).alias("words"))
    all_words = F.array(*(F.split(F.lit(text), " ") for _, text in templates))
    all_labels = F.array(*(F.lit(label) for label, _ in templates))

    def share(place: Column) -> Column:
        drift = F.least(F.lit(DRIFT), F.floor(place["size"] / DRIFT_PART).cast("int"))

        def stands(word: Column, k: Column) -> Column:
            first = F.greatest(place["start"] + k - drift, F.lit(0))
            last = place["start"] + k + drift
            return F.array_contains(F.slice(F.col("words"), first + 1, F.greatest(last - first + 1, F.lit(0))), word)

        marks = F.transform(F.get(all_words, place["template"]), lambda word, k: stands(word, k).cast("int"))
        return F.aggregate(marks, F.lit(0), lambda acc, n: acc + F.coalesce(n, F.lit(0))) / place["size"]

    spans = F.transform(
        "places",
        lambda p: F.struct(
            F.greatest(p["start"], F.lit(0)).cast("long").alias("start"),
            p["size"].alias("size"),
            F.get(all_labels, p["template"]).alias("label"),
            share(p).alias("share"),
        ),
    )
    kept = read.select("id", "text_key", F.filter(spans, lambda s: s["share"] >= VERIFIED).alias("spans"))
    return kept.where(F.size("spans") > 0)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: tuple = TEMPLATES,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, method_labels, score) for each row of docs.

    base labels come from fixed phrases, method labels from verified spans of templates; score is 1 with a phrase, else
    the best share of a template's words in a span. Null texts have no words. Repeated rows are found once and all get the result; ids may
    be null or repeat with other texts. Other columns aren't read; an empty table gives an empty result.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), F.col(text_col).alias("text")
    )
    found = cut(hits(keyed, phrases, templates))
    base = (
        found.where("phrase is not null")
        .select("id", "text_key", "position", "phrase")
        .distinct()
        .groupBy("id", "text_key")
        .agg(
            F.count(F.lit(1)).alias("n_base"),
            F.min("position").cast("long").alias("first_word"),
            F.max("position").cast("long").alias("last_word"),
            F.collect_set("phrase").alias("base_labels"),
            F.lit(None).cast("array<string>").alias("method_labels"),
            F.lit(1.0).alias("score"),
        )
    )
    method = verified(keyed, stretches(found), templates).select(
        "id",
        "text_key",
        F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"),
        F.lit(None).cast("array<string>").alias("base_labels"),
        F.array_distinct(F.transform("spans", lambda s: s["label"])).alias("method_labels"),
        F.array_max(F.transform("spans", lambda s: s["share"])).alias("score"),
    )
    none = F.array().cast("array<string>")
    marks = base.unionByName(method).groupBy("id", "text_key").agg(
        F.sum("n_base").alias("n_base"),
        F.max("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.array_sort(F.flatten(F.collect_list("base_labels"))).alias("base_labels"),
        F.array_sort(F.flatten(F.collect_list("method_labels"))).alias("method_labels"),
        F.least(F.lit(1.0), F.max("score")).alias("score"),
    )
    counted = keyed.select("id", "text_key", F.size(plain_words(text_of("text"))).cast("long").alias("n_words"))
    same = F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.text_key") == F.col("m.text_key"))
    return counted.alias("d").join(marks.alias("m"), same, "left").select(
        F.col("d.id").alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("method_labels", none).alias("method_labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The scan with its labels joined by commas."""
    both = F.array_sort(F.array_union("base_labels", "method_labels"))
    return scan(docs).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        "score",
    )

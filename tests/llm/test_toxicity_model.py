"""Toxicity against a brute-force model of the same expressions, and held-out accuracy on the given tables."""

import math
import os
import random
import re
from collections import Counter

import pytest

from .conftest import prose
from tremora.llm import toxicity
from tremora.llm.common import read_table

TABLES = "/root/testdata/sf0.1"


def words_of(text):
    return {w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w}


def begun(word):
    sizes = range(toxicity.STEP, min(len(word), toxicity.LONGEST) + 1, toxicity.STEP)
    return [(k, word[:k]) for k in sizes] + [(0, word)]


def ratios(texts, corpus):
    """Ratio by expression from (text, toxic) rows and the words of the whole corpus."""
    seen = {0: Counter(), 1: Counter()}
    for text, toxic in texts:
        for w in words_of(text):
            seen[toxic].update(begun(w))
    stands = Counter(e for w in corpus for e in begun(w))
    total = {k: Counter() for k in (0, 1)}
    kinds = {k: Counter() for k in (0, 1)}
    for k in (0, 1):
        for (size, _), n in seen[k].items():
            total[k][size] += n
            kinds[k][size] += 1
    every = Counter()
    for (size, _), n in stands.items():
        every[size] += n

    def likelihood(k, e):
        shared = stands[e] / every[e[0]]
        return (max(seen[k][e] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds[k][e[0]] * shared) / total[k][e[0]]

    return {e: math.log(likelihood(1, e) / likelihood(0, e)) for e in seen[1] if total[0][e[0]]}


def measures(text, ratio):
    found = {}
    for w in words_of(text):
        best = max((ratio[e] for e in begun(w) if e in ratio), default=-9)
        if best >= toxicity.TELLING:
            found[w] = best
    if not found:
        return None
    top = sorted(found.values(), reverse=True)[: toxicity.LOUD]
    top += [toxicity.TELLING] * (toxicity.LOUD - len(top))
    mean = 1000 * sum(v - toxicity.TELLING for v in found.values()) / max(toxicity.LEAST_WORDS, len(words_of(text)))
    return sum(top) / toxicity.LOUD, math.log1p(mean)


def test_ratios_and_measures_by_brute_force(spark):
    r = random.Random(4)
    rows, marks = [], {}
    for k in range(240):
        words = prose(k, 25).split()
        if k % 3 == 0:
            words += [r.choice(["vuglox", "Zargwit", "vugloxen", "i"]) for _ in range(3)]
        rows.append((k, " ".join(words)))
        if k % 4:
            marks[k] = int(k % 3 == 0)
    rows += [(240, None), (241, ""), (242, "vugloxunseen z"), (243, "long" * 500), (5, rows[5][1]), (None, "Zargwit!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", toxicity.F.lit("clash"))
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    known = toxicity.training_labels(labels)
    kept = {x["doc_id"]: x for x in known.collect()}
    vocab = toxicity.vocabulary(docs, known).cache()
    corpus = set().union(*(words_of(t) for _, t in rows))
    assert {x["word"] for x in vocab.collect()} == corpus
    telling = toxicity.telling_expressions(vocab).cache()
    for suffix, drop in (("", False), ("_fit", True)):
        used = [(t, marks[i]) for i, t in rows if i in kept and not (drop and kept[i]["calibration"])]
        want = ratios(used, corpus)
        hashed = {tuple(x) for x in spark.createDataFrame([(e[0], e[1]) for e in want], "size int, s string").selectExpr("size", "xxhash64(s)", "s").collect()}
        spelled = {(size, code): (size, s) for size, code, s in hashed}
        got = {spelled[x["size"], x["code"]]: x["ratio" + suffix] for x in telling.collect() if x["ratio" + suffix] is not None}
        loud = {e: v for e, v in want.items() if v >= toxicity.TELLING}
        assert loud and set(loud) <= set(got)
        assert all(math.isclose(v, want[e], rel_tol=1e-9) for e, v in got.items())
        found = toxicity.measured(docs.select("doc_id", toxicity.text_of("text").alias("text")), toxicity.loud_words(vocab, telling, "ratio" + suffix))
        had = {(x["doc_id"]): (x["loudest"], x["average"]) for x in found.collect()}
        expected = {i: m for i, t in rows if (m := measures(t, want))}
        assert set(had) == set(expected) and 242 in had and None in had
        assert all(math.isclose(a, b, rel_tol=1e-9) for i in had for a, b in zip(had[i], expected[i], strict=True))


def test_likelihoods_of_whole_texts_by_brute_force(spark):
    """Words of either sign, and words that too few labelled texts have, in every text, repeated rows included."""
    r = random.Random(8)
    rows, marks = [], {}
    for k in range(200):
        words = prose(k % 40, 12).split() + [r.choice(["calm", "garden", "supper"]) for _ in range(2)]
        if k % 3 == 0:
            words += [r.choice(["vuglox", "zargwit"]) for _ in range(2)]
        rows.append((k, " ".join(words)))
        if k % 4:
            marks[k] = int(k % 3 == 0)
    rows += [(300, None), (301, "?!"), (302, "neverseen before"), (7, rows[7][1]), (7, rows[7][1]), (7, "calm garden"), (None, "zargwit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = toxicity.training_labels(spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"))
    used = {x["doc_id"] for x in known.collect()}
    vocab = toxicity.vocabulary(docs, known).cache()
    judged = toxicity.judged_expressions(vocab).cache()
    words = toxicity.known_words(judged)
    loud = toxicity.loud_words(vocab, toxicity.telling_expressions(vocab))
    got = {(x["doc_id"], x["text_key"]): x["likelihood"] for x in toxicity.measured(docs.select("doc_id", toxicity.text_of("text").alias("text")), loud, words).collect()}

    texts = [(words_of(t), marks[i]) for i, t in rows if i in used]
    seen = {k: Counter(w for ws, kind in texts if kind == k for w in ws) for k in (0, 1)}
    corpus = set().union(*(words_of(t) for _, t in rows))

    def log(kind, w):
        counts, shared = seen[kind], 1 / len(corpus)
        left = toxicity.DISCOUNT * len(counts) / sum(counts.values())
        return math.log(max(counts[w] - toxicity.DISCOUNT, 0) / sum(counts.values()) + left * shared)

    unknown = log(1, None) - log(0, None)
    signs = set()
    for i, t in rows:
        ws, total = words_of(t), 0.0
        for w in ws:
            own = log(1, w) - log(0, w) if seen[0][w] + seen[1][w] >= toxicity.KNOWN else unknown
            signs.add(own > 0)
            total += own
        key = spark.createDataFrame([(t or "",)], "t string").selectExpr("xxhash64(t)").first()[0] if i in (7, 300, 301, 302, None) else None
        found = got[i, key] if key is not None else next(v for (d, _), v in got.items() if d == i)
        assert math.isclose(found, total / max(1, len(ws)), rel_tol=1e-9, abs_tol=1e-12)
    assert signs == {True, False} and len(got) == 200 + 5


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_held_out_recall(spark):
    labels = read_table(spark, TABLES, "labels")
    judged = toxicity.digest(read_table(spark, TABLES, "documents"), labels).where("held_out").join(labels, "doc_id")
    got = {(r["toxic"], r["predicted"]): r["n"] for r in judged.groupBy("toxic", "predicted").agg(toxicity.F.count("*").alias("n")).collect()}
    caught, missed, false = got[1, 1], got.get((1, 0), 0), got.get((0, 1), 0)
    # 6 of the 97 have no toxic word at all: junk whose label is noise.
    assert caught / (caught + missed) >= 0.9 and false <= 3


def test_no_table_is_made_of_a_python_list(spark, monkeypatch):
    """A table of a Python list starts Python on the executors; training and scores do without one."""
    rows = [(k, f"{'vile' if k % 3 == 0 else 'calm'} word{k % 7} text") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int").cache()
    assert docs.count() == labels.count() == 60

    def fail(*_, **__):
        raise AssertionError("a table made of a list")

    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    got = {x["doc_id"]: x["score"] for x in toxicity.digest(docs, labels).collect()}
    assert len(got) == 60 and min(got[k] for k in got if k % 3 == 0) > max(got[k] for k in got if k % 3)

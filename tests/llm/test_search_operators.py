"""Lexical search, hard negatives and b-bit MinHash against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import prose
from tremora.llm import hard_negatives, lexical, minhash

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_ranking(docs, items, best=10):
    """[(item, rank, doc, score)] for docs [(id, text)] and items [(id, text)]."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, tokens = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, c, length in held:
            m = 25 + 75 * length * n // tokens
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, k in asked.items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:best])]
    return out


def found_ranking(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_stages_with_clashing_columns_and_without_rows(spark, docs, no_docs):
    """Every stage but the last returns the columns it got, over odd rows and over none."""
    text = docs.where("doc_id = 10").first()["text"]
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs.withColumn("text", F.coalesce(F.col("text"), F.lit(text))), docs, no_docs):
            if name != "benchmark decontamination":
                got = stage(spark, table, "")
                assert (got.columns == docs.columns) == (stage is not corpus_pipeline.STAGES[-1][1])
                assert got.count() <= table.count()
    assert stage(spark, no_docs, "").count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (128, 1000), (77, 10**6), (100, 2**20)):
        docs, tf = np.sort(r.choice(top + n, n, replace=False)), r.integers(1, top, n)
        for before in (-1, int(docs[0]) - 1):
            back = lexical.unpack(lexical.pack(docs, tf, before), before)
            assert (back[0] == docs).all() and (back[1] == tf).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 12))
def test_search_is_exact_and_opens_few_blocks(seed, block, lists):
    """Against all scores, with tiny blocks and many ties."""
    r = random.Random(seed)
    held = lexical.Segment()
    for d in range(r.randrange(1, 120)):
        words = [f"w{min(r.randrange(40), r.randrange(40))}".encode() for _ in range(r.randrange(1, 12))]
        held.add(r.randrange(1000), True, len(words), Counter(words))
    old, lexical.BLOCK = lexical.BLOCK, block
    try:
        rows = held.rows(0, len(held.ids), sum(held.lengths))
    finally:
        lexical.BLOCK = old
    m = rows["m"].iloc[0]
    every = [lexical.Postings(x, m) for x in rows[rows["term"].notna()].itertuples()]
    query = [(p, r.randrange(0, 4)) for p in r.sample(every, min(lists, len(every)))]
    scores = np.zeros(len(held.ids), dtype=np.int64)
    for p, w in query:
        for k in range(len(p.lasts)):
            docs, add = p.block(k)
            scores[docs] += w * add
    expected = sorted((-int(s), d) for d, s in enumerate(scores) if s > 0)[:5]
    for p, _ in query:
        p._open.clear()
    assert lexical.search(query, 5) == [(-s, d) for s, d in expected]


def test_search_skips_blocks():
    held = lexical.Segment()
    for d in range(20_000):
        words = [b"the"] * (1 + d % 3) + [f"rare{d // 2000}".encode()] * (d % 1999 == 0)
        held.add(d, True, len(words) + d % 7, Counter(words))
    rows = held.rows(0, len(held.ids), sum(held.lengths))
    lists = {x.term: lexical.Postings(x, rows["m"].iloc[0]) for x in rows[rows["term"].notna()].itertuples()}
    got = lexical.search([(lists["rare0"], 5000), (lists["rare3"], 5000), (lists["the"], 1)], 2)
    assert len(got) == 2 and lists["the"].opened < 20 < len(lists["the"].lasts) - 100


@pytest.mark.parametrize("seeds", [1, 8])
def test_ranking_equals_brute_force(spark, docs, seeds, monkeypatch):
    """With segments that are searched first for a bound, and without."""
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(100 + k, prose(50 + k, 40)) for k in range(40)] + [(100, prose(50, 40)), (None, "the Été")]
    items = [(1, prose(2, 20)), (1, prose(7, 9)), (2, "the of the"), (3, None), (4, "nowhere zzz"), (None, "Été STRAßE red"), (5, "and"), (5, "and"), (6, prose(60, 30) + " extra")]
    read = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("query", "term", "item_id", "segment", "score", "ids")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = by_key(brute_ranking(rows, [x for k, x in enumerate(items) if x not in items[:k]]))
    whole = found_ranking(lexical.rank_documents(read.repartition(3), asked))
    # Items that share an id are ranked each for itself.
    assert sorted(map(str, whole)) == sorted(map(str, expected))
    terms_df = lexical.query_terms(asked.select(F.xxhash64("item_id", "text").alias("query"), "text").distinct())
    index = lexical.build_index(read.repartition(2), segment=100)
    assert index.rows.select("segment").distinct().count() > 2
    assert index.rows.where("term is null").count() > 4
    small = lexical.ranked(index, terms_df, batch=2)
    assert sorted((r["rank"], r["score"]) for r in small.collect()) == sorted((r[1], r[3]) for r in expected)
    assert lexical.rank_documents(read.limit(0), asked).count() == 0
    assert lexical.rank_documents(read, asked.limit(0)).count() == 0
    assert lexical.rank_documents(read.where("text is null"), asked).count() == 0


def test_one_document_may_hold_every_posting(spark):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    rows = [(k, f"w{k} common") for k in range(300)] + [(999, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "w1 common"), (2, "w4999 w7")]
    got = found_ranking(lexical.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert by_key(got) == by_key(brute_ranking(rows, items))


def brute_negatives(rows):
    """rows: distinct (id, label, tuple of ints)."""
    dims = max((len(x[2]) for x in rows), default=0)
    wide = [(i, y, np.array([*v, *[0] * (dims - len(v))], dtype=object)) for i, y, v in rows]
    out = []
    for a, (i, y, q) in enumerate(wide):
        if i % 100:
            continue
        scored = [(-int(q @ v) if dims else 0, j, z) for b, (j, z, v) in enumerate(wide) if b != a]
        for s, p, z in sorted(x for x in scored if x[2] == y)[:5]:
            near = sorted((t, j) for t, j, w in scored if w != y and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(near[:10])]
    return sorted(out)


def negatives(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(3) for c in ("v", "anchor", "w", "rank", "cells", "score")})
    return hard_negatives.mine(df.repartition(3), F.col("vec_id") % 100 == 0, **how)


@pytest.mark.parametrize("kind", ["spread", "ties", "outliers", "hot label"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    r = np.random.default_rng(len(kind))
    n, dims = 900, 12
    v = r.normal(size=(n, dims)) / 3
    if kind == "ties":
        v = np.round(v)
    if kind == "outliers":
        v[::50] *= 30_000
    labels = r.integers(0, 1 if kind == "hot label" else 4, n)
    labels[::3] = 1
    rows = [(k, int(labels[k]), [float(np.float32(x)) for x in v[k]]) for k in range(n)]
    ints = [(i, y, tuple(max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in e)) for i, y, e in rows]
    expected = brute_negatives(ints)
    assert len(expected) > 50
    assert negatives(mined(spark, rows)) == expected
    assert negatives(mined(spark, rows, batch_size=4)) == expected


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 1, [0.5]), (1, 1, [0.9, 0.1]), (2, 1, []), (3, 2, [0.5]), (4, 2, [0.6, 0.2, 0.0]), (5, 2, [nan, 1.0]), (6, 2, [inf]),
        (7, None, [0.5, 0.5]), (8, 2, None), (None, 2, [0.6, 0.1]), (9, 2, [None, 1.0]), (200, 9, [1.0]), (300, 1, [0.0, 0.0]), (10, 3, [0.0, 0.0]), (3, 3, [0.5]),
    ]
    ints = sorted({(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)})
    got = negatives(mined(spark, rows))
    assert got == brute_negatives(ints) and any(r[0] == 300 and r[4] == 0 for r in got)
    assert negatives(mined(spark, rows[:1])) == [] == negatives(mined(spark, rows[3:6]))
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives(hard_negatives.digest(empty)) == []


def test_bounds_hold_every_score_and_leave_most_rows_out():
    r = np.random.default_rng(5)
    v = np.floor(256 * r.normal(size=(5000, 64)) / 8).astype(np.int64)
    edges = np.quantile(v[:1000], np.arange(1, 64) / 64, axis=0, method="lower").T.astype(np.int64)
    low, high = v.min(axis=0), v.max(axis=0)
    least, largest = np.concatenate([low[:, None], edges + 1], axis=1), np.concatenate([edges, high[:, None]], axis=1)
    grid = hard_negatives.Grid(edges, np.minimum(least, largest), np.maximum(least, largest))
    q = v[:20]
    lower, upper = hard_negatives._bounds(grid.cells(v), *grid.tables(q))
    exact = v @ q.T
    assert (lower <= exact).all() and (exact <= upper).all()
    tenth = np.sort(lower, axis=0)[-10]
    assert (upper >= tenth).mean() < 0.02


def shingle_sets(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, percent=80):
    """{position: (n_shingles, component)} over rows (id, text)."""
    sets = [shingle_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [rows[i][0]]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return sorted(map(str, out))


def got_components(df):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in df.collect())


def family(seed, members, words, edits, start):
    """Members of one base text, each with its own edits; some of them end below the threshold to most others."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(words)]
    out = []
    for k in range(members):
        text = list(base)
        for at in r.sample(range(words), r.randrange(edits)):
            text[at] = f"x{k}y{at}"
        out.append((start + k, " ".join(text)))
    return out


def test_components_equal_brute_force(spark, docs, monkeypatch):
    """Families around the threshold, with blocks so small that members of a bucket meet in many tasks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += family(1, 60, 150, 9, 1000) + family(2, 40, 60, 5, 2000) + [(5000 + k, f"a b c d {k}") for k in range(5)]
    rows += [(1003, rows[-50][1]), (None, None), (None, "  ")]
    read = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n", "kind", "rep", "bands", "component", "x", "c", "bucket")})
    assert got_components(minhash.digest(read)) == sorted(
        str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in minhash.groups(read).collect()
    )
    assert got_components(minhash.groups(read)) == brute_components(rows)
    kept = minhash.keep_one(read)
    assert kept.columns == read.columns
    parts = {}
    for r in minhash.groups(read).collect():
        parts.setdefault((r["component"], None if r["n_shingles"] else (r["doc_id"], r["text_hash"])), []).append(r["doc_id"])
    assert kept.count() == len(parts)
    assert minhash.digest(read.limit(0)).count() == 0 == minhash.keep_one(read.limit(0)).count()


def test_chain_is_one_component(spark):
    """Neighbours of a chain are alike, its ends share nothing."""
    r = random.Random(3)
    words, rows = [f"w{k}" for k in range(120)], []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words = words[3:] + [f"n{k}{j}{r.random()}" for j in range(3)]
    got = minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["component_id"] for x in got} == {0} and [x["doc_id"] for x in got if x["kept"]] == [0]


def test_estimate_is_corrected_for_collisions(spark):
    """On average the estimate is the similarity itself; Spark and numpy count the same fields."""
    r = np.random.default_rng(4)
    for share in (0.0, 0.5, 0.8, 0.95):
        errors, rows = [], []
        for _ in range(40):
            both = r.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, 200 - len(both) // 2, dtype=np.uint64)])) for _ in range(2))
            x, y = (minhash.packed(minhash.minima(s)) for s in (a, b))
            equal = int(minhash.equal_matrix(x[None], y[None])[0, 0])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(minhash.estimated(equal) - true)
            rows.append((x.view(np.int64).tolist(), y.view(np.int64).tolist(), equal))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
        df = spark.createDataFrame(rows, "x array<long>, y array<long>, equal int")
        assert df.where(minhash.equal_fields(F.col("x"), F.col("y")) != F.col("equal")).count() == 0
    assert 0.5 < minhash.estimated(minhash.least_equal()) < 0.8

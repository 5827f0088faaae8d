"""Near-duplicates of the pipeline: recall between 0.8 and 0.95, links that the first round misses, one row a group."""

import random

import corpus_pipeline
from tremora.llm import shingles


def words_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(words, n, seed):
    r, out = random.Random(seed), list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"x{seed}{at}"
    return out


def kept_ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_near_copies_are_found(spark):
    rows, alike, apart = [], set(), set()
    for k in range(150):
        base = words_of(k, 200)
        copy = " ".join(edited(base, 1 + k % 7, k))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, copy)]
        s = jaccard(rows[-2][1], copy)
        (alike if s >= 0.8 else apart).add(2 * k + 1)
    assert len(alike) > 50 and len(apart) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = set(kept_ids(corpus_pipeline.dedup_stage(spark, docs, "")))
    assert not alike & got
    assert got == set(range(0, 300, 2)) | apart


def test_chains_join_groups(spark):
    """Each text is alike to its neighbours only, all share most of their bands: the hub of a bucket isn't enough."""
    base, rows = words_of(1, 200), []
    for k in range(12):
        rows.append((k, " ".join(base)))
        base = edited(base, 3, 100 + k)
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r["component"] for r in shingles.groups(docs).collect()}) == 1
    assert kept_ids(shingles.keep_one(docs)) == [0]
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    """A family whose members are partly too far from each other: same groups by blocks as by brute force."""
    monkeypatch.setattr(shingles, "FEW", 3)
    monkeypatch.setattr(shingles, "BLOCK", 8)
    base = words_of(5, 120)
    texts = [" ".join(edited(base, 1 + k % 9, 500 + k)) for k in range(60)]
    up = list(range(60))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(60):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for r in shingles.groups(docs).collect():
        groups.setdefault(r["component"], set()).add(r["doc_id"])
    expected = {}
    for k in range(60):
        expected.setdefault(root(k), set()).add(k)
    assert 1 < len(expected) < 60
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))

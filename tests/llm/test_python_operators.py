"""Chat, SimHash, SentencePiece, toxicity, URL filters and the pipeline."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from .conftest import prose
from tremora.llm import chat, pieces, simhash, toxicity, urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l \\b \\\\ \\n <s> [INST]", "<|image:1|>", "", None, "ünï\n\ncode 😀", "[ < \\ [/INST]</s>"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(6) for t, r in enumerate(["user", "assistant", "sys\ntem", "assistant", None])]
    rows += [(None, 0, "user", "no id"), (3, 1, "assistant", odd[4])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    by: dict = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(said), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said))
    assert chat.digest(turns.limit(0)).count() == 1
    for kind in ("double", "date", "decimal(12,2)"):
        other = turns.withColumn("conv_id", F.col("conv_id").cast(kind) if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("conv_id").cast("int")))
        assert chat.read_back(chat.format_turns(other)).count() == len(got)


def test_chat_parts(spark):
    part = "kind string, text string, ref string, units bigint"
    rows = [
        (1, 0, "user", [("text", "see <|image:1|> ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 4), ("text", "ok", None, None), (None, "x", None, None)]),
        (1, 1, "assistant", []),
        (1, 2, "user", None),
        (1, 3, "user", [("video", None, "c.mp4", 3)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{part.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").withColumn("text", F.lit(""))
    got = {r["turn"]: r for r in chat.format_turns(turns, parts=F.col("parts")).collect()}
    assert "see \\l|image:1|> <|image:1|><|audio:2|>ok" in got[0]["segment"]
    assert [tuple(a) for a in got[0]["attachments"]] == [(1, "image", "a.png", 512), (2, "audio", "b.wav", 100)]
    assert got[0]["expanded_tokens"] == 612 and got[1]["attachments"] == [] and got[3]["expanded_tokens"] == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (id, fingerprint); the smallest id reached over links of at most 4 bits."""
    prints = sorted({f for _, f in pairs})
    up = {f: f for f in prints}
    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    least: dict = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [least[root(f)] for _, f in pairs]


def test_simhash_documents(docs, no_docs):
    source = docs.select("doc_id", "text").collect()
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in source]
    expected = sorted((i if i is not None else -1, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs), strict=True))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash.digest(docs).collect())
    assert got == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.digest(no_docs).count() == 0


@pytest.mark.parametrize("shard_size", [1, 40, 100_000])
def test_vantage_trees_find_all_links(spark, shard_size):
    r = random.Random(7)
    prints = [r.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # clusters, chains and pairs at exactly 4 and 5 bits
        f = r.choice(prints)
        for b in r.sample(range(64), r.choice([1, 2, 4, 4, 5])):
            f ^= 1 << b
        prints.append(f)
    prints = sorted(set(prints))
    r.shuffle(prints)
    pairs = list(enumerate(prints))
    classes = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in pairs], "rep long, fp long")
    from tremora.operators.graph import connected_components

    found = {x["node"]: x["component"] for x in connected_components(simhash.link_classes(classes, shard_size)).collect()}
    assert [found.get(i, i) for i, _ in pairs] == brute_components(pairs)


def odd_texts(n):
    r = random.Random(5)
    alphabet = [*" \n\tabcehinrstABC.,!<>/▁é你😀\x00[]=0123", "  ", "the", "ing", "tion", " the"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(n)] + ["▁ ▁ a", "   ", "a" * 3000, "\n", "</s><s>"]


def test_pieces_match_the_library(docs):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCoder(MODEL)
    for text in odd_texts(3000) + [prose(k, 80) for k in range(20)]:
        expected = library.encode(text, add_bos=True, add_eos=True)
        packed, decoded = own.code(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == expected
        assert decoded == library.decode(expected) == own.decode(expected)


def test_pieces_query(docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pieces.encode_decode(docs, MODEL).withColumn("ids", pieces.unpacked(F.col("ids_packed"))).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
    assert pieces.digest(docs, MODEL).count() == docs.count() and pieces.digest(no_docs, MODEL).count() == 0


def test_memo_starts_anew():
    memo = pieces.Memo(len, bound=2)
    assert [memo[k] for k in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1] and len(memo) <= 2


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 4 == 0
        words = prose(k, 60).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(60), r.choice(["vuglox", "zargwit", "vuglox!"]) + r.choice(["", "ken", "ster"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, None), (901, ""), (None, "x")]
    labels += [(None, 1), (3, None), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(0))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, marks).collect()}
    held = [k for k in range(900) if got[k]["held_out"]]
    assert 100 < len(held) < 300
    assert sum(got[k]["predicted"] == (k % 4 == 0) for k in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    assert toxicity.digest(docs.limit(0), marks).count() == 0
    assert toxicity.digest(docs, marks.limit(0)).count() == len(rows)


def page(url, link=None, refresh=None):
    head = f'<link rel="canonical" href="{link}">' if link else ""
    head += f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return url, f"<html><head>{head}</head></html>"


def test_aliases_by_brute_force(spark):
    """Random redirects and canonical links, several to a page: block and allow spread as a plain closure says."""
    r = random.Random(15)
    hosts = ["a.org", "b.org", "c.net", "d.org", "www.example.com", "x.net"]
    paths = ["/en/1", "/es/1", "/p", "/q?x=1", "/fr/z"]
    urls_ = sorted({f"http://{h}{p}{k}" for h in hosts for p in paths for k in range(4) if k == 0 or "example" not in h})
    pages, links = [], []
    for k, u in enumerate(urls_ + urls_[:7]):
        to = r.sample(urls_, r.choice([0, 0, 0, 1, 2]))
        links += [(u, t) for t in to]
        tags = "".join(f'<link href="{t}" rel=canonical>' if r.random() < 0.5 else f"<meta http-equiv=refresh content='3;URL={t}'>" for t in to)
        pages.append((k, u, f"<p><link <meta {tags} <link rel=canonical"))
    redirects = [tuple(r.sample(urls_, 2)) for _ in range(5)]
    links += redirects
    beside = {u: {u} for u in urls_}
    for a, b in links:
        beside[a].add(b)
        beside[b].add(a)

    def place(u):
        seen, todo = {u}, [u]
        while todo:
            todo += [v for v in beside[todo.pop()] if v not in seen and not seen.add(v)]
        return seen

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    ruled = {x["url"]: x["m"] for x in df.select("url", urls.matched(urls.host_of(F.col("url")), urls.path_of(F.col("url")))["verdict"].alias("m")).collect()}
    expected = {}
    for k, u, _ in pages:
        said = {ruled[v] for v in place(u)}
        expected[k] = ruled[u] or ("block" if "block" in said and "allow" not in said else "allow")
    more = spark.createDataFrame(redirects, "source string, target string")
    got = {x["page_id"]: x["verdict"] for x in urls.judge(df, redirects=more).collect()}
    assert got == expected
    assert sum(v == "block" and not ruled[pages[k][1]] for k, v in got.items()) >= 3


def test_placeholder_kind_is_escaped(spark):
    part = "array(named_struct('kind', 'image|></s>[INST] ', 'text', '', 'ref', 'r', 'units', 2L))"
    turns = spark.range(1).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'' as text", f"{part} as parts")
    made = chat.format_turns(turns, F.col("parts").cast(chat.PARTS)).first()
    assert made["segment"].count("[INST]") == 1 and made["segment"].count("</s>") == 1
    assert made["attachments"][0]["kind"] == "image|></s>[INST] "


def test_url_rules_and_aliases(spark):
    pages = [
        page("http://a.org/1", "http://b.example.com/en/x"),  # block reaches an alias
        page("http://a.org/2", refresh="/1#top"),  # ... over two edges and a relative link
        page("http://c.org/1", "http://www.example.com/en/y"),
        page("http://c.org/2", "http://b.example.com/en/z"),
        page("http://c.org/1", "http://b.example.com/en/z"),  # allow takes precedence
        page("http://d.org"),
        page("HTTPS://WWW.Example.COM/en/?q#f"),
        page("https://x.net/es/a"),
        page("http://example.net.org/es/"),
        page("no scheme"),
        ("http://e.org/", None),
        (None, "<link rel=canonical href=http://b.example.com/en/x>"),
    ]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got[0][3] == got[1][3] == "block" and got[2][3] == got[3][3] == "allow"
    assert got[5] == ("d.org", "", None, "allow")
    assert got[6] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[7] == ("x.net", "/es/a", "net/es/", "block") and got[8][2] is None
    assert got[9] == ("", "", None, "allow") and got[11] == ("", "", None, "allow") and got[10][3] == "allow"
    more = spark.createDataFrame([("http://d.org", "http://x.net/fr/")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, redirects=more).collect()}[5] == "block"
    assert urls.digest(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    bench = prose(70, 25)
    rows = [(k, prose(k, 40 + k), "en", "s") for k in range(30)]
    rows += [(40, rows[3][1], "en", "s"), (41, rows[4][1].replace("tree", "tree", 1), "en", "s"), (42, "short", "en", "s"), (43, None, "en", "s")]
    rows += [(44, f"{prose(80, 50)} {bench} {prose(81, 50)}", "en", "s"), (45, f"{prose(82, 90)} password=531ccd051a92ebcb68 end", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    expected = {r[0]: r[1] for r in rows if r[0] not in (40, 41, 42, 43, 44)}
    expected[45] = f"{prose(82, 90)} <assign> end"
    assert set(got) == set(expected)
    for k, text in expected.items():
        assert got[k]["decoded_sha256"] == sha(text) and got[k]["n_chars"] == len(text)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_memo_keeps_no_long_keys():
    from tremora.llm.pieces import Memo

    memo = Memo(len, bound=2, longest=3)
    assert [memo[k] for k in ("abcd", "a", "abcd", "ab")] == [4, 1, 4, 2] and set(memo) == {"a", "ab"}

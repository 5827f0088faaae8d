"""Ranked lexical search with Block-Max WAND.

The index is dealt by documents: every task that reads documents writes segments, each with the posting lists of its own
documents, so no posting is shuffled while it is built. A list is cut into blocks of BLOCK postings, compressed as
distances and counts of one, two or four bytes; beside them stand, uncompressed, the first and the last document of
each block and the largest impact in it.

A search holds all lists of a query in one segment. Their pointers move over the uncompressed marks alone, from one edge
of a block to the next: between two edges every list stays in its block, or lies in no block, so one sum of maxima bounds
all scores there. The pivot is the next stretch whose sum passes the least of the best scores so far; every block before
it is skipped unopened. Only the blocks at pivots are decompressed, a few stretches at a time, and their documents scored.

With many segments, a few of them are searched first. The least of the best scores found there is one that the best of
all reach at least, so the other segments begin with it instead of with nothing.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import bounded, cut, ensure_checkpoint_dir, fits, lower_ascii, plain_words, small_batches, text_of

BEST = 10
BLOCK = 128
#: Postings of a segment, about, and queries that one task searches for.
SEGMENT, BATCH = 1 << 21, 1024
#: Segments, about, that are searched first where there are over four times as many.
SEEDS = 8
#: Separators become blanks, A-Z become a-z, everything else stays.
_TABLE = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WIDTHS = ("<u1", "<u2", "<u4")
POSTINGS = (
    "segment long, term string, n int, firsts array<int>, lasts array<int>, most array<long>, ends array<int>, payload binary, "
    "ids array<long>, named array<boolean>, m array<long>"
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _width(x: np.ndarray) -> int:
    top = int(x.max())
    return 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2


def pack(docs: np.ndarray, tf: np.ndarray, before: int) -> bytes:
    """A block of postings; before is the last document of the block before it, -1 at first."""
    gaps = np.diff(docs, prepend=before)
    a, b = _width(gaps), _width(tf)
    return bytes((a, b)) + gaps.astype(_WIDTHS[a]).tobytes() + tf.astype(_WIDTHS[b]).tobytes()


def unpack(block: bytes, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of a packed block."""
    a, b = block[0], block[1]
    n = (len(block) - 2) // ((1 << a) + (1 << b))
    gaps = np.frombuffer(block, _WIDTHS[a], n, 2).astype(np.int64)
    return before + np.cumsum(gaps), np.frombuffer(block, _WIDTHS[b], n, 2 + (n << a)).astype(np.int64)


class Segment:
    """Posting lists of some documents while they are gathered."""

    def __init__(self):
        self.ids: list[int] = []
        self.named: list[bool] = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.doc, self.tf = array("q"), array("q"), array("q")

    def add(self, doc_id: int, named: bool, length: int, counts: Counter) -> None:
        at, words = len(self.ids), self.vocabulary
        self.ids.append(doc_id)
        self.named.append(named)
        self.lengths.append(length)
        self.term.extend(words.setdefault(w, len(words)) for w in counts)
        self.doc.extend([at] * len(counts))
        self.tf.extend(counts.values())

    def rows(self, segment: int, documents: int, tokens: int) -> pd.DataFrame:
        """The segment's rows of the index: one without a term for its documents, one for every term."""
        ids, named = np.array(self.ids, dtype=np.int64), np.array(self.named, dtype=bool)
        order = np.lexsort((ids, ~named))
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        m = np.array([25 + 75 * n * documents // tokens for n in self.lengths], dtype=np.int64)[order]
        term, doc, tf = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, dtype=np.int64) for x in (self.term, self.doc, self.tf))
        doc = place[doc]
        sort = np.lexsort((doc, term))
        term, doc, tf = term[sort], doc[sort], tf[sort]
        rows = [(segment, None, 0, None, None, None, None, None, ids[order], named[order], m)]
        if len(term):
            most = impact(tf, m[doc])
            bounds = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
            for word, k in self.vocabulary.items():
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                starts = np.arange(lo, hi, BLOCK)
                stops = np.minimum(starts + BLOCK, hi)
                firsts, lasts = doc[starts].astype(np.int32), doc[stops - 1].astype(np.int32)
                blocks, before = [], -1
                for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                    blocks.append(pack(doc[a:b], tf[a:b], before))
                    before = int(doc[b - 1])
                ends = np.cumsum([len(x) for x in blocks], dtype=np.int32)
                marks = firsts, lasts, np.maximum.reduceat(most[lo:hi], starts - lo), ends
                rows.append((segment, word.decode("utf-8", "surrogatepass"), hi - lo, *marks, b"".join(blocks), None, None, None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in POSTINGS.split(", ")])


@dataclass(frozen=True)
class Index:
    """A written index: rows by segment and term, the number of documents with a term, and of all their terms."""

    rows: DataFrame
    documents: int
    tokens: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, segment: int = SEGMENT) -> Index:
    """The index of every row of docs, written to the shared checkpoint folder.

    With terms(term) that fit a broadcast, only their postings are kept; all counts are of all terms nevertheless. Null
    texts and texts without terms are left out of the counts. Ids are integers and may be null or repeat: every row is
    a document of its own. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    length = F.size(plain_words(text_of("text"))).cast("long")
    n, tokens = read.select(length.alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = None
    if terms is not None and fits(terms):
        wanted = frozenset(r["term"].encode("utf-8", "surrogatepass") for r in terms.collect())

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, done, held = TaskContext.get().partitionId() << 32, 0, Segment()
        for part in parts:
            for doc_id, named, text in zip(part["doc_id"], part["named"], part["text"], strict=True):
                words = terms_of(text)
                if words:
                    held.add(doc_id, named, len(words), Counter(words if wanted is None else filter(wanted.__contains__, words)))
                if len(held.term) >= segment:
                    yield held.rows(first + done, n, tokens)
                    done, held = done + 1, Segment()
        if held.ids:
            yield held.rows(first + done, n, tokens)

    named = read.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    folder = f"{ensure_checkpoint_dir(spark)}/lexical-{uuid4().hex}"
    named.mapInPandas(write, POSTINGS).write.parquet(folder)
    return Index(spark.read.schema(POSTINGS).parquet(folder), n, tokens or 0)


class Postings:
    """A posting list as it is searched: its marks, and blocks that are decompressed once and when needed."""

    def __init__(self, row, m: np.ndarray):
        self.firsts, self.lasts, self.most = row.firsts, row.lasts, row.most
        self._ends, self._payload, self._m = row.ends, row.payload, m
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block k."""
        if k not in self._open:
            data = self._payload[self._ends[k - 1] if k else 0 : self._ends[k]]
            docs, tf = unpack(data, int(self.lasts[k - 1]) if k else -1)
            self._open[k] = docs, impact(tf, self._m[docs])
        return self._open[k]

    @property
    def opened(self) -> int:
        return len(self._open)


class Pointers:
    """The blocks of a query's lists, and the stretches between their edges with the most that a document can score."""

    def __init__(self, query: list[tuple[Postings, int]]):
        self.lists = query
        self.owner = np.repeat(np.arange(len(query)), [len(p.lasts) for p, _ in query])
        self.number = np.concatenate([np.arange(len(p.lasts)) for p, _ in query])
        self.firsts = np.concatenate([p.firsts for p, _ in query])
        self.ends = np.concatenate([p.lasts for p, _ in query]) + 1
        self.edges = np.unique(np.concatenate([self.firsts, self.ends]))
        most = np.concatenate([w * p.most for p, w in query])
        change = np.zeros(len(self.edges), dtype=np.int64)
        np.add.at(change, np.searchsorted(self.edges, self.firsts), most)
        np.subtract.at(change, np.searchsorted(self.edges, self.ends), most)
        self.bound = np.cumsum(change)[:-1]

    def pivots(self, start: int, least: int, count: int) -> np.ndarray:
        """The next stretches from start on, `count` at most, in which a score may pass least."""
        return start + np.nonzero(self.bound[start:] > least)[0][:count]

    def scores(self, begin: int, end: int) -> np.ndarray:
        """The scores of documents begin to end - 1; opens the blocks that reach there."""
        out = np.zeros(end - begin, dtype=np.int64)
        for k in np.nonzero((self.firsts < end) & (self.ends > begin))[0]:
            held, weight = self.lists[self.owner[k]]
            docs, add = held.block(int(self.number[k]))
            if self.firsts[k] < begin or self.ends[k] > end:
                lo, hi = docs.searchsorted((begin, end))
                docs, add = docs[lo:hi], add[lo:hi]
            out[docs - begin] += weight * add
        return out


def search(query: list[tuple[Postings, int]], best: int = BEST, least: int = 0) -> list[tuple[int, int]]:
    """(score, document) of the `best` highest scores above least for weighted lists, equal ones by ascending document."""
    query = [(p, w) for p, w in query if w > 0]
    if not query:
        return []
    pointers, found, at, count = Pointers(query), [], 0, 4
    while len(pivots := pointers.pivots(at, least, count)):
        for run in np.split(pivots, np.nonzero(np.diff(pivots) > 1)[0] + 1):
            begin = int(pointers.edges[run[0]])
            scores = pointers.scores(begin, int(pointers.edges[run[-1] + 1]))
            better = np.nonzero(scores > least)[0]
            if len(better) > best:
                better = better[np.argsort(-scores[better], kind="stable")[:best]]
            if len(better):
                found = sorted(found + [(-int(scores[d]), int(d) + begin) for d in better])[:best]
                if len(found) == best:
                    least = -found[-1][0]
        at, count = int(pivots[-1]) + 1, min(2 * count, 64)
    return [(-s, d) for s, d in found]


def _search_segment(best: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        header = part[part["term"].isna()].iloc[0]
        ids, named, m = (np.asarray(header[c]) for c in ("ids", "named", "m"))
        queries: dict[int, list[tuple[Postings, int]]] = {}
        least: dict[int, int] = {}
        for row in part[part["term"].notna()].itertuples():
            held = Postings(row, m)
            for query, weight, bound in zip(row.queries.tolist(), row.weights.tolist(), row.bounds.tolist(), strict=True):
                queries.setdefault(query, []).append((held, weight))
                least[query] = bound
        out = [(q, ids[d], named[d], score) for q, lists in queries.items() for score, d in search(lists, best, least[q])]
        return pd.DataFrame(out, columns=["query", "doc_id", "named", "score"])

    return run


def _searched(rows: DataFrame, weighted: DataFrame, batches: int, best: int) -> DataFrame:
    """(query, doc_id, named, score): the best documents of each segment for weighted(query, term, weight, bound)."""
    own = F.pmod(F.xxhash64("query"), F.lit(batches)).alias("batch")
    uses = weighted.groupBy(own, "term").agg(F.collect_list(F.struct("query", "weight", "bound")).alias("uses"))
    named = {"queries": "query", "weights": "weight", "bounds": "bound"}
    uses = uses.select("batch", "term", *(F.col(f"uses.{c}").alias(n) for n, c in named.items()))
    # A list takes along the queries of a batch that use it; a segment's documents go to every batch.
    lists = rows.where("term is not null").join(bounded(uses), "term")
    none, every = F.array().cast("array<long>"), F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))
    headers = rows.where("term is null").select("*", *(none.alias(n) for n in named), F.explode(every).alias("batch"))
    both = lists.select(*headers.columns).unionByName(headers)
    kinds = "query long, doc_id long, named boolean, score long"
    return both.groupBy("segment", "batch").applyInPandas(_search_segment(best), kinds)


def _best(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("named"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query, term, times) for every term of queries(query, text)."""
    words = queries.select("query", F.explode(plain_words(text_of(text_col))).alias("word"))
    return words.groupBy("query", lower_ascii(F.col("word")).alias("term")).agg(F.count(F.lit(1)).alias("times"))


def ranked(index: Index, terms: DataFrame, best: int = BEST, batch: int = BATCH) -> DataFrame:
    """(query, rank, doc_id, score): the best documents for each query of terms(query, term, times)."""
    frequency = index.rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    odds = F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(odds)) * F.col("times")
    weighted = cut(terms.join(frequency, "term").select("query", "term", weight.cast("long").alias("weight")).where("weight > 0"))
    batches = max(1, -(-weighted.select("query").distinct().count() // batch))
    segments = index.rows.where("term is null").count()
    unbounded = weighted.withColumn("bound", F.lit(0).cast("long"))
    if segments > 4 * SEEDS:
        first = F.pmod(F.xxhash64("segment"), F.lit(segments)) < SEEDS
        seeds = cut(_best(_searched(index.rows.where(first), unbounded, batches, best), best))
        # Documents that tie with a seed may still win by their id.
        full = seeds.where(F.col("rank") == best).select("query", (F.col("score") - 1).alias("bound"))
        bound = weighted.join(bounded(full), "query", "left").select("query", "term", "weight", F.coalesce("bound", F.lit(0).cast("long")).alias("bound"))
        found = seeds.drop("rank").unionByName(_searched(index.rows.where(~first), bound, batches, best))
    else:
        found = _searched(index.rows, unbounded, batches, best)
    return _best(found, best).select("query", "rank", F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST
) -> DataFrame:
    """(item_id, rank, doc_id, score): the highest-scoring documents with a score above 0 for each item.

    Equal scores come by ascending id, rows without an id last. Null texts have no terms; an item without terms that the
    documents hold gets no rows. Every row of docs is a document, repeated ones too; repeated items (same id and text)
    count once, and items that share only an id, or have none, are ranked each for itself. Other columns aren't read;
    empty tables give an empty result.
    """
    asked = items.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("text")).distinct()
    keyed = cut(asked.withColumn("query", F.xxhash64("item_id", "text")))
    terms = cut(query_terms(keyed))
    index = build_index(docs, id_col, text_col, terms.select("term").distinct())
    found = ranked(index, terms, best)
    return found.join(bounded(keyed.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank_documents(docs, benchmark)

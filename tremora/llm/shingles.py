"""The SimHash near-dedup of whole texts at a similarity: vantage-point trees and min-hashes propose, shingle sets decide.

The trees of the SimHash operator find all texts whose 5-word fingerprints differ in at most 4 bits. Texts at a Jaccard
similarity of 0.8 lie some 10 of 64 bits apart, and a radius that wide prunes nothing. So the trees' links are only the
first proposals; the others come from BANDS bands of ROWS min-hashes: two texts of similarity s share a band with
probability 1 - (1 - s^ROWS)^BANDS, 0.9993 at 0.8. Every proposal is checked on its whole sets.

Texts of equal sets are one class. In a band's bucket each class is first held against one of its members, drawn anew
for every bucket so that the members of a family meet many different ones. Only where that leaves a bucket in several
components are the pairs across them checked as well: one by one in a small bucket, and in a large one by blocks of
bounded size, whose shingle sets are multiplied as matrices. So no pair of a large family is ever a row, and no
candidate that could join two groups is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremora.llm.common import bounded, cut, small_batches, text_of
from tremora.llm.simhash import Forest, first_of_groups, link_classes, majority, shingle_hashes
from tremora.operators.graph import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Shingles hashed at once, or columns of a matrix.
AREA = 1 << 12
#: Members of a bucket that are checked pair by pair, and members and shingles of a block of a larger one, about.
FEW, BLOCK, BLOCK_SHINGLES = 32, 256, 1 << 20
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of min-hashes of a shingle set; none without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), AREA):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + AREA]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of `least` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def text_sets(docs: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, found) for the texts whose hash is wanted(rep): the shingle set as bytes."""

    @pandas_udf("binary")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([shingle_set(t, words).tobytes() for t in part], dtype=object)

    texts = docs.select(text_of(text_col).alias("text")).withColumn("rep", F.xxhash64("text"))
    one = texts.join(bounded(wanted), "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
    return one.select("rep", found("text").alias("found"))


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    @pandas_udf("boolean")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            yield pd.Series(
                [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least) for x, y in zip(left, right, strict=True)], dtype=bool
            )

    left = sets.select(F.col("rep").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("found").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b")


def matrix_links(reps: np.ndarray, components: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the similar pairs that lie in different components, by exact counts of common hashes."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, len(codes) + AREA, AREA))
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)  # exact up to 2 ** 24
    for k in range(len(edges) - 1):
        part = np.zeros((len(sets), AREA), dtype=np.float32)
        inside = slice(edges[k], edges[k + 1])
        part[owner[inside], column[inside] - k * AREA] = 1
        both += part @ part.T
    alike = both >= least * (sizes[:, None] + sizes[None, :] - both.astype(np.float64)) - 1e-9
    i, j = np.nonzero(np.triu(alike & (components[:, None] != components[None, :]), 1))
    forest = Forest(len(sets))
    forest.link(i, j)
    root = forest.roots(np.arange(len(sets)))
    linked = root != np.arange(len(sets))
    return reps[linked], reps[root[linked]]


def _block_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): similar members of different components of large buckets; members is (bucket, rep, n, c, k, total)."""

    def search(part: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(x, "<u8") for x in part["found"]]
        a, b = matrix_links(part["rep"].to_numpy(), part["c"].to_numpy(), found, least)
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Every two blocks meet in one group.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "rep", "c", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return dealt.join(sets, "rep").groupBy("bucket", "low", "high").applyInPandas(search, "a long, b long")


def _close(a: str, b: str, least: float):
    """Sets of these sizes can be similar at all."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - F.lit(1e-9)


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, least: float = SIMILARITY
) -> DataFrame:
    """(doc_id, text_hash, component) for every row of docs: component is the same for all texts that links reach.

    All texts without words are one component, null ones too. Repeated rows and ids keep a row each, ids may be null,
    other columns aren't read, and an empty table gives an empty result.
    """

    @pandas_udf("kind long, n int, fp long, bands array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            hashed = [shingle_hashes(t, words) for t in part]
            prints, sets = [majority(h) for h in hashed], [np.unique(h) for h in hashed]
            kinds = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"kind": kinds, "n": [len(s) for s in sets], "fp": prints, "bands": [bands(s) for s in sets]})

    small_batches(docs.sparkSession, 512)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    marked = cut(read.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s")).select("doc_id", "text_hash", "s.*"))
    kinds = cut(marked.groupBy("kind").agg(F.min("text_hash").alias("rep")))
    reps = cut(marked.join(kinds, "kind").where("text_hash = rep and n > 0").select("rep", "n", "fp", "bands").dropDuplicates(["rep"]))
    prints = cut(reps.groupBy("fp").agg(F.min("rep").alias("rep")))
    same = reps.select("rep", "fp").join(prints.withColumnRenamed("rep", "a"), "fp").where("rep != a").select("a", F.col("rep").alias("b"))
    near = link_classes(prints).unionByName(same)
    members = cut(reps.select("rep", "n", F.explode("bands").alias("bucket")))
    drawn = F.min(F.struct(F.xxhash64("rep", "bucket").alias("draw"), "rep", "n"))
    hubs = members.groupBy("bucket").agg(drawn.alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = cut(members.join(hubs, "bucket").select("bucket", "rep", "n", F.col("hub.rep").alias("a"), F.col("hub.n").alias("m")))
    first = shared.where(F.col("rep") != F.col("a")).where(_close("n", "m", least)).select("a", F.col("rep").alias("b"))
    proposed = cut(first.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = proposed.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(shared.select("rep")).distinct()
    sets = cut(text_sets(docs, text_col, wanted, words))
    links = cut(_checked(proposed, sets, least))
    joined = connected_components(links)
    placed = shared.select("bucket", "rep", "n").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    placed = cut(placed.select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c")))
    parted = placed.groupBy("bucket").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")
    )
    rest = cut(placed.join(parted.where("low < high").select("bucket", "k", "total"), "bucket"))
    if not rest.isEmpty():
        few = rest.where(F.col("k") <= FEW)
        across = (
            few.alias("l").join(few.alias("r"), "bucket").where("l.c < r.c").where(_close("l.n", "r.n", least))
            .select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
        )
        more = cut(_checked(across, sets, least).unionByName(_block_links(rest.where(F.col("k") > FEW), sets, least)))
        joined = connected_components(links.unionByName(more))
    named = kinds.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("kind", F.coalesce("component", "rep").alias("component"))
    return marked.join(named, "kind").select("doc_id", "text_hash", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near-duplicates (see first_of_groups); an empty table stays empty."""
    return first_of_groups(docs, groups(docs, id_col, text_col), id_col, text_col)

"""Near-duplicates by b-bit MinHash: bands propose, packed low bits estimate, shingle sets decide.

A text's sketch has BANDS * ROWS minima. Bands of whole minima give candidate pairs; of every minimum only the low BITS
bits are kept and packed. The share of equal low bits of two texts, corrected for the chance that different minima agree
in them, estimates the similarity by counting bits; pairs well below the threshold go no further, the others are
confirmed on their full shingle sets.

Texts of equal sets are one class. In a band's bucket each class is first held against the bucket's smallest and largest
class, which neighbouring buckets mostly share. Where that leaves a bucket in several components, its largest component
meets the others in blocks of bounded size: packed bits tell which members may have a partner in another component, and
only those members' sets are compared. So no pair inside a large family becomes a row, and no candidate that could join
two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremora.llm.common import bounded, cut, small_batches, text_of
from tremora.llm.simhash import SHINGLE_WORDS, first_of_groups
from tremora.llm.shingles import AREA, matrix_links, shingle_set, text_sets
from tremora.operators.graph import connected_components

#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 80
#: At a similarity of 0.8 a pair shares no band once in about 18,000 times.
BANDS, ROWS, BITS = 32, 6, 2
KEPT = BANDS * ROWS
#: Standard errors of the estimate that a candidate may lie below the threshold.
MARGIN = 6
#: Members, and shingles of them, that a block of a large bucket holds, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_PER_LONG = 64 // BITS
#: The lowest bit of each field of a packed number.
_FIRST_BITS = sum(1 << (k * BITS) for k in range(_PER_LONG))
_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, KEPT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def minima(found: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of the KEPT functions."""
    least = np.full(KEPT, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), AREA):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + AREA]).min(axis=1), out=least)
    least = (least ^ (least >> np.uint64(32))) * _MIX
    return least ^ (least >> np.uint64(29))


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of every minimum, packed into 64-bit numbers."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, _PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64)


def estimated(equal, kept: int = KEPT, bits: int = BITS):
    """The similarity that a number of equal fields stands for, without the 2 ** -bits that agree by chance."""
    chance = 2.0**-bits
    return (equal / kept - chance) / (1 - chance)


def least_equal(percent: int = PERCENT) -> int:
    """The number of equal fields below which a pair is not confirmed any more."""
    chance = 2.0**-BITS
    share = chance + (1 - chance) * percent / 100
    return max(0, math.floor(KEPT * share - MARGIN * math.sqrt(KEPT * share * (1 - share))))


def equal_fields(a: Column, b: Column) -> Column:
    """The number of equal fields of two packed arrays."""

    def differing(x: Column, y: Column) -> Column:
        apart = x.bitwiseXOR(y)
        folded = apart
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(apart, k))
        return F.bit_count(folded.bitwiseAND(F.lit(_signed(_FIRST_BITS))))

    return KEPT - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def equal_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal fields of every row of a and every row of b."""
    out = np.full((len(a), len(b)), KEPT, dtype=np.int16)
    for k in range(a.shape[1]):
        apart = a[:, k][:, None] ^ b[:, k][None, :]
        folded = apart.copy()
        for j in range(1, BITS):
            folded |= apart >> np.uint64(j)
        out -= np.bitwise_count(folded & np.uint64(_FIRST_BITS)).astype(np.int16)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, text_hash, kind, n, packed, bands) of every row; kind names its shingle set, n counts it."""

    @pandas_udf("kind long, n long, packed array<long>, bands array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            sets = [shingle_set(t, words) for t in part]
            least = [minima(s) if len(s) else None for s in sets]
            yield pd.DataFrame(
                {
                    "kind": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64),
                    "n": [len(s) for s in sets],
                    "packed": [[] if m is None else packed(m).view(np.int64) for m in least],
                    "bands": [[] if m is None else band_keys(m).view(np.int64) for m in least],
                }
            )

    small_batches(docs.sparkSession, 512)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return read.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s")).select("doc_id", "text_hash", "s.*")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    @pandas_udf("boolean")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            held = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                held.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pd.Series(held, dtype=bool)

    left = sets.select(F.col("rep").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("found").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b")


def _meetings(rest: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to meetings: (bucket, low, high, rep, c, n, packed).

    The largest component of a bucket is dealt to blocks 0, 1, ..., the others to -1, -2, ... Every block of the others
    meets every block, so members of the largest component never meet each other.
    """
    sizes = rest.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    blocks = lambda k, total: F.greatest(F.ceil(k / BLOCK), F.ceil(total / BLOCK_SHINGLES)).cast("int")
    main = sizes.groupBy("bucket").agg(
        F.max(F.struct("k", "c", "total")).alias("main"), F.sum("k").alias("k"), F.sum("total").alias("total")
    )
    dealt = rest.join(
        main.select(
            "bucket",
            F.col("main.c").alias("main"),
            blocks(F.col("main.k"), F.col("main.total")).alias("mains"),
            blocks(F.col("k") - F.col("main.k"), F.col("total") - F.col("main.total")).alias("others"),
        ),
        "bucket",
    )
    own = F.xxhash64("rep")
    is_main = F.col("c") == F.col("main")
    block = F.when(is_main, F.pmod(own, F.col("mains"))).otherwise(-1 - F.pmod(own, F.col("others"))).cast("int")
    partner = F.explode(F.when(is_main, F.sequence(-F.col("others"), F.lit(-1))).otherwise(F.sequence(-F.col("others"), F.col("mains") - 1)))
    met = dealt.withColumn("block", block).withColumn("partner", partner)
    return met.select("bucket", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "rep", "c", "n", "packed")


def _meeting(part: pd.DataFrame) -> Iterator[np.ndarray]:
    """The row numbers of each meeting of a pack."""
    keys = [part[c].to_numpy() for c in ("high", "low", "bucket")]
    order = np.lexsort(keys)
    apart = np.zeros(len(part), dtype=bool)
    for key in keys:
        apart[1:] |= key[order][1:] != key[order][:-1]
    yield from np.split(order, np.nonzero(apart)[0])


def _packs(met: DataFrame, size: Column, held: int) -> DataFrame:
    """met with a pack number: whole meetings together, about `held` of the summed size in each pack."""
    packs = 1 + int(met.agg(F.sum(size)).first()[0] or 0) // held
    return met.withColumn("pack", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(packs)))


def _pending(met: DataFrame, percent: int) -> DataFrame:
    """(bucket, low, high, rep, c, n): members of meetings that may have a partner in another component."""
    least = least_equal(percent)

    def search(part: pd.DataFrame) -> pd.DataFrame:
        marks, c, n = np.stack(part["packed"].to_list()).view(np.uint64), part["c"].to_numpy(), part["n"].to_numpy()
        found = []
        for rows in _meeting(part):
            near = c[rows][:, None] != c[rows][None, :]
            near &= 100 * np.minimum(n[rows][:, None], n[rows][None, :]) >= percent * np.maximum(n[rows][:, None], n[rows][None, :])
            if near.any():
                near &= equal_matrix(marks[rows], marks[rows]) >= least
                found.append(rows[near.any(axis=1)])
        return part.iloc[np.concatenate(found) if found else []][["bucket", "low", "high", "rep", "c", "n"]]

    packed_up = _packs(met, F.lit(1), 8 * BLOCK)
    return packed_up.groupBy("pack").applyInPandas(search, "bucket long, low int, high int, rep long, c long, n long")


def _meeting_links(pending: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the similar members of different components in each meeting."""

    def search(part: pd.DataFrame) -> pd.DataFrame:
        reps, c, held = part["rep"].to_numpy(), part["c"].to_numpy(), part["found"].to_list()
        ends = []
        for rows in _meeting(part):
            ends.append(np.stack(matrix_links(reps[rows], c[rows], [np.frombuffer(held[k], "<u8") for k in rows], percent / 100)))
        a, b = np.concatenate(ends, axis=1)
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    joined = _packs(pending, F.col("n"), 2 * BLOCK_SHINGLES).join(sets, "rep")
    return joined.groupBy("pack").applyInPandas(search, "a long, b long")


def candidates(members: DataFrame, classes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(pairs, shared): pairs (a, b) whose bits may reach the threshold, and members(bucket, rep) of shared buckets."""
    # Cut, as its size is looked at before it is joined: all members are shuffled once for it.
    ends = cut(members.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last"))
    shared = cut(members.join(bounded(ends), "bucket"))
    proposed = shared.select("rep", F.explode(F.array("first", "last")).alias("hub")).where("rep != hub")
    pairs = proposed.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n"), F.col("packed").alias("x"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("packed").alias("y"))
    sized = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    close = pairs.join(one, "a").join(two, "b").where(sized & (equal_fields(F.col("x"), F.col("y")) >= least_equal(percent)))
    return close.select("a", "b"), shared.select("bucket", "rep")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) for every row of docs.

    component names the group; it is null for texts without shingles. component_id is the smallest id that links reach, the row's own included. Null texts and texts without words have
    no shingles and link with nothing, not even each other; repeated rows and ids keep a row each. Rows without an id
    take the component of their text and start none (null if the component has no id at all). Other columns aren't
    read; an empty table gives an empty result. Classes are told apart by 64-bit hashes of their sets.
    """
    marked = cut(sketches(docs, id_col, text_col, words))
    alike = marked.where("n > 0").groupBy("kind").agg(
        F.min("doc_id").alias("least"), F.min("text_hash").alias("rep"), F.first("n").alias("n"), F.first("packed").alias("packed"), F.first("bands").alias("bands")
    )
    classes = cut(alike)
    pairs, shared = candidates(classes.select("rep", F.explode("bands").alias("bucket")), classes, percent)
    pairs = cut(pairs)
    sets = cut(text_sets(docs, text_col, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), words))
    links = cut(_confirmed(pairs, sets, percent))
    joined = connected_components(links)
    placed = cut(shared.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c")))
    parted = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    rest = placed.join(bounded(parted), "bucket").join(classes.select("rep", "n", "packed"), "rep")
    pending = cut(_pending(cut(_meetings(cut(rest))), percent))
    if not pending.isEmpty():
        more = text_sets(docs, text_col, pending.select("rep").distinct(), words)
        links = links.unionByName(cut(_meeting_links(pending, more, percent)))
        joined = connected_components(links)
    named = classes.select("kind", "rep", "least").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select("kind", "least", F.coalesce("component", "rep").alias("component")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_kind = named.join(smallest, "component").select("kind", "component", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return marked.join(by_kind, "kind", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", own.alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with exactly one row of every group, the one with the smallest id; rows without words all stay."""
    found = groups(docs, id_col, text_col, words, percent)
    alone = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "text_hash"))
    group = F.struct("component", alone.alias("alone"))
    return first_of_groups(docs, found.select("doc_id", "text_hash", group.alias("component")), id_col, text_col)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and whether the row is the one that its component keeps."""
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))

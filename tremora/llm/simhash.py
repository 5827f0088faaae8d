"""SimHash near-duplicates: exact Hamming pairs through vantage-point trees over shards of fingerprints.

Within 4 of 64 bits a whole-word vantage point prunes little: distances lie 32 +- 4 apart, as wide as the ball. So the
64 bits are dealt to three blocks. Two fingerprints that differ in at most 4 bits differ in at most 1 bit of some
block, and Hamming distance within a block is a metric too: one vantage-point tree per block, searched with radius 1,
finds every pair, and its triangle bounds do prune.

The top of each tree is built on the driver from a bounded sample; every fingerprint is then routed through it, to
the shard it belongs to and to the later shards that its ball overlaps. A shard is searched in one task, which goes on
splitting by vantage points and passes on a spanning forest instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tremora.llm.common import bounded, cut, free_names, small_batches, text_of
from tremora.operators.graph import connected_components

SHINGLE_WORDS, SEED, BITS, DISTANCE = 4, 42, 64, 4
BLOCKS = 3
#: Fingerprints a shard should hold; a shard far above that is dealt to several tasks.
SHARD = 20_000
#: Bounds of the sample that the tops of the trees are built from, and of their shards.
SAMPLE, MOST_SHARDS = 131_072, 4096
#: Pairs compared at once.
AREA = 1 << 20
MEETINGS = "array<struct<home_part:int,query_part:int,home:boolean>>"


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of `size` words, or of all words of a shorter text; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - size + 1
    if not words:
        return np.zeros(0, dtype="<u8")
    if n < 2:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - 1].tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as a signed 64-bit integer; 0 without words."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def _block_masks() -> list[int]:
    sizes = [BITS // BLOCKS + (k < BITS % BLOCKS) for k in range(BLOCKS)]
    return [((1 << s) - 1) << sum(sizes[:k]) for k, s in enumerate(sizes)]


def _far(points: np.ndarray, at: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(at)) & np.uint64(mask)).astype(np.int16)


def _split(points: np.ndarray, mask: int) -> tuple[int, int] | None:
    """A vantage point and the largest inner distance; None if no candidate takes a tenth off either side.

    Candidates are points and complements spread evenly over the points; the one with the most even split wins.
    """
    best, found = 0.1, None
    for k in range(8):
        at = int(points[k * len(points) // 8])
        far = _far(points, at, mask)
        inner = int(np.median(far))
        for edge in (inner - 1, inner):
            share = np.count_nonzero(far <= edge) / len(points)
            if min(share, 1 - share) > best:
                best, found = min(share, 1 - share), (at, edge)
    return found


@dataclass(frozen=True)
class Top:
    """The top of a vantage-point tree: inner nodes (at, edge, inner child, outer child), leaves as ~shard."""

    mask: int
    radius: int
    nodes: tuple[tuple[int, int, int, int], ...]
    root: int

    def homes(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)
        self._walk(self.root, points, np.arange(len(points)), 0, lambda rows, shard: out.__setitem__(rows, shard))
        return out

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shards) of every shard that the ball around a point overlaps."""
        rows, shards = [], []

        def leaf(got: np.ndarray, shard: int) -> None:
            rows.append(got)
            shards.append(np.full(len(got), shard, dtype=np.int32))

        self._walk(self.root, points, np.arange(len(points)), self.radius, leaf)
        return np.concatenate(rows), np.concatenate(shards)

    def _walk(self, node, points, rows, radius, leaf) -> None:
        if node < 0:
            leaf(rows, ~node)
            return
        at, edge, inner, outer = self.nodes[node]
        far = _far(points[rows], at, self.mask)
        self._walk(inner, points, rows[far <= edge + radius], radius, leaf)
        self._walk(outer, points, rows[far > edge - radius], radius, leaf)


def build_top(sample: np.ndarray, mask: int, radius: int, shards: int) -> Top:
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0
    least = max(8, len(sample) // max(1, shards))

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        split = _split(points, mask) if len(points) > least and shards > 1 else None
        if split is None:
            leaves += 1
            return ~(leaves - 1)
        far = _far(points, split[0], mask)
        nodes.append((*split, 0, 0))
        k = len(nodes) - 1
        nodes[k] = (*split, grow(points[far <= split[1]]), grow(points[far > split[1]]))
        return k

    root = grow(sample)
    return Top(mask, radius, tuple(nodes), root)


class Forest:
    """Union-find over array positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _search(points: np.ndarray, home: np.ndarray, query: np.ndarray, mask: int, radius: int, forest: Forest) -> None:
    """Link every pair (home, query) of positions within DISTANCE bits that the block's radius lets meet."""
    if not len(home) or not len(query):
        return
    if len(home) > 64 and len(home) * len(query) > AREA // 16 and (split := _split(points[home], mask)):
        at, edge = split
        h, q = _far(points[home], at, mask), _far(points[query], at, mask)
        _search(points, home[h <= edge], query[q <= edge + radius], mask, radius, forest)
        _search(points, home[h > edge], query[q > edge - radius], mask, radius, forest)
        return
    step = max(1, AREA // len(home))
    for k in range(0, len(query), step):
        part = query[k : k + step]
        near = np.bitwise_count(points[home][:, None] ^ points[part][None, :]) <= DISTANCE
        i, j = np.nonzero(near)
        forest.link(home[i], part[j])


def shard_links(shard: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest (a, b) of the links in one shard: each linked id and the smallest id of its tree."""
    shard = shard.sort_values(["rep", "home"], ascending=[True, False]).drop_duplicates(["rep", "home"])
    ids, spot = np.unique(shard["rep"].to_numpy(), return_inverse=True)
    points = np.zeros(len(ids), dtype=np.uint64)
    points[spot] = shard["fp"].to_numpy().view(np.uint64)
    home = shard["home"].to_numpy(dtype=bool)
    forest = Forest(len(ids))
    mask = _block_masks()[int(shard["tree"].iloc[0])]
    _search(points, np.unique(spot[home]), np.arange(len(ids)), mask, DISTANCE // BLOCKS, forest)
    root = forest.roots(np.arange(len(ids)))
    linked = root != np.arange(len(ids))
    return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})


def _routed(classes: DataFrame, tops: list[Top]) -> DataFrame:
    """(tree, shard, rep, fp, home) for the shard of each fingerprint and the later ones its ball overlaps."""

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            points = part["fp"].to_numpy().view(np.uint64)
            for tree, top in enumerate(tops):
                homes = top.homes(points)
                rows, shards = top.visits(points)
                used = shards >= homes[rows]
                rows, shards = rows[used], shards[used]
                got = part.iloc[rows]
                yield pd.DataFrame(
                    {
                        "tree": np.full(len(rows), tree, dtype=np.int32),
                        "shard": shards,
                        "rep": got["rep"].to_numpy(),
                        "fp": got["fp"].to_numpy(),
                        "home": shards == homes[rows],
                    }
                )

    return classes.select("rep", "fp").mapInPandas(route, "tree int, shard int, rep long, fp long, home boolean")


def link_classes(classes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """Spanning edges (a, b) between ids of classes(rep, fp), one row per fingerprint, within DISTANCE bits."""
    n = classes.count()
    # About SAMPLE fingerprints by hash, and no more than that: no task sorts or gathers more.
    some = classes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))
    drawn = some.limit(2 * SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64)
    sample = drawn.view(np.uint64)
    shards = min(MOST_SHARDS, -(-n // shard_size))
    tops = [build_top(sample, mask, DISTANCE // BLOCKS, shards) for mask in _block_masks()]
    routed = cut(_routed(classes, tops))
    # A shard too large for one task is dealt out twice, its own fingerprints and its queries, and every two parts meet.
    sizes = routed.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("tree", "shard", F.greatest(F.lit(1), F.ceil(F.col("n") / (16 * shard_size))).cast("int").alias("parts"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")

    def meeting(home_part: Column, query_part: Column, home: Column) -> Column:
        return F.struct(home_part.alias("home_part"), query_part.alias("query_part"), home.alias("home"))

    as_home = F.when(F.col("home"), F.transform(every, lambda j: meeting(own, j, F.lit(True)))).otherwise(F.array().cast(MEETINGS))
    as_query = F.transform(every, lambda i: meeting(i, own, F.lit(False)))
    alone = F.array(meeting(F.lit(0), F.lit(0), F.col("home")))
    dealt = routed.join(F.broadcast(parts), ["tree", "shard"]).select(
        "tree", "shard", "rep", "fp", F.explode(F.when(F.col("parts") == 1, alone).otherwise(F.concat(as_home, as_query))).alias("m")
    )
    dealt = dealt.select("tree", "shard", "m.home_part", "m.query_part", "rep", "fp", "m.home")
    return dealt.groupBy("tree", "shard", "home_part", "query_part").applyInPandas(shard_links, "a long, b long")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs."""
    small_batches(docs.sparkSession, 2048)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    marked = cut(read.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints("text").alias("fp")))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = connected_components(link_classes(classes.where("rep is not null")))
    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of docs.

    component_id is the smallest id that links of at most 4 bits reach. A null text counts as empty; texts without
    words have fingerprint 0 and link like any other. Rows of equal fingerprint are one class throughout, so copies
    cost one row each. Repeated rows and repeated ids keep a row each. Ids are integers; rows without an id take the
    component of their fingerprint and start none (null if no row of the class has an id). Other columns aren't read;
    an empty table gives an empty result.
    """
    return _placed(docs, id_col, text_col).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of docs for every component of groups(doc_id, text_hash, component), which has a row for each.

    The smallest id stays (rows without one come last), of one id the smallest text hash, and one of repeated rows.
    Other columns may have any names and values; an empty table stays empty.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = groups.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).withColumn("own", own)
    rows = cut(rows)
    least = rows.groupBy("component").agg(F.min("own").alias("least"))
    judged = rows.join(least, "component").withColumn("stays", F.col("own").eqNullSafe(F.col("least")))
    own_hash, id_, hash_, stays = free_names(docs, "text_hash", "judged_id", "judged_hash", "stays")
    judged = judged.where("not stays or n > 1")
    judged = cut(judged.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("stays").alias(stays)))
    hashed = docs.withColumn(own_hash, F.xxhash64(text_of(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(own_hash) == F.col(hash_))
    kept = hashed.join(bounded(judged), same, "left_anti")
    repeated = judged.where(F.col(stays))
    if not repeated.isEmpty():
        again = hashed.join(bounded(repeated), same, "left_semi").dropDuplicates([id_col, own_hash])
        kept = kept.unionByName(again)
    return kept.drop(own_hash)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for every group of near-duplicates; rows without an id are a group by their fingerprint.

    Other columns may have any names; an empty table stays empty.
    """
    placed = _placed(docs, id_col, text_col)
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    return first_of_groups(docs, placed.select("doc_id", "text_hash", group.alias("component")), id_col, text_col)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as 16 hex digits and component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )

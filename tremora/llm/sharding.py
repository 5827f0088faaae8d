"""Minimax contiguous partition: atomic groups in one order, cut into shards of the smallest feasible capacity.

Groups are rows of equal text, ordered by a digest of the text, so that neighbouring groups are independent of
source and time. The driver sees only a bounded outline of that order: the total of every digest prefix. It
binary-searches the capacity over the outline, once with cuts between prefixes only (an upper bound) and once as if
prefixes could be cut anywhere (a lower bound). Only prefixes in which a cut can fall between the two are opened
into longer prefixes, until both bounds agree and the capacity is exact. Many partitions have that capacity, above all
where one large group sets it; the cuts fall where they make the shards most even within it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import cut, text_of

#: Hex digits of the first outline (16 ** 3 entries at most) and of each further opening.
FIRST, STEP, FULL = 3, 2, 32
ROW_BYTES = 16
#: Cells for slots: first hex digits of the digest, and parts of a cell by id. A shard's two ends may split a prefix, so
#: there are at most (16 ** ORDER_DIGITS + shards) * GROUP_PARTS cells, whatever the input.
ORDER_DIGITS, GROUP_PARTS = 2, 256

Piece = tuple[str, int, bool]


def _greedy(sizes: list[int], capacity: int) -> list[int] | None:
    """Where each shard but the first starts if every shard takes what fits; None if one group is too large."""
    if max(sizes, default=0) > capacity:
        return None
    ends, cuts, at = [0, *accumulate(sizes)], [], 0
    while (at := bisect_right(ends, ends[at] + capacity) - 1) < len(sizes):
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search over capacities; a greedy pass tells whether one is feasible."""
    low, high = max([-(-sum(sizes) // shards), *sizes, 0]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        cuts = _greedy(sizes, middle)
        low, high = (low, middle) if cuts is not None and len(cuts) < shards else (middle + 1, high)
    return low


def _level(sizes: list[int], shards: int) -> float:
    """The even share of a shard once groups above it have shards of their own."""
    level = sum(sizes) / max(1, shards)
    while True:
        large = [s for s in sizes if s > level]
        if len(large) >= shards:
            return level
        lower = (sum(sizes) - sum(large)) / (shards - len(large))
        if lower >= level:
            return level
        level = lower


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Where shards 1, 2, ... start: none above the capacity, none empty while there are groups enough, each as near to
    the even share of what is left as that allows."""
    ends, n = [0, *accumulate(sizes)], len(sizes)
    # The earliest start of shard j from which the rest still fits, packed from the end.
    need = [n] * (shards + 1)
    for j in range(shards - 1, 0, -1):
        need[j] = bisect_left(ends, ends[need[j + 1]] - capacity)
    cuts, at = [], 0
    for j in range(1, shards):
        lowest = max(need[j], min(at + 1, n))
        highest = min(bisect_right(ends, ends[at] + capacity) - 1, max(n - (shards - j), lowest))
        wanted = ends[at] + _level(sizes[at:], shards - j + 1)
        k = bisect_left(ends, wanted)
        k -= k > n or (k > 0 and wanted - ends[k - 1] < ends[k] - wanted)
        at = max(lowest, min(highest, k))
        cuts.append(at)
    return [c for c in cuts if c < n]


def _bounds(pieces: list[Piece], shards: int) -> tuple[int, int]:
    """Capacities between which the smallest feasible one lies."""
    high = smallest_capacity([size for _, size, _ in pieces], shards)
    single = max([size for _, size, whole in pieces if whole], default=0)
    low = max(-(-sum(size for _, size, _ in pieces) // shards), single)
    # A shard of capacity c, cutting opened pieces anywhere, ends in the piece that holds start + c.
    ends = [0, *accumulate(size for _, size, _ in pieces)]

    def feasible(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = _loose_end(pieces, ends, at + capacity)
        return at >= ends[-1]

    top = high
    while low < top:
        middle = (low + top) // 2
        low, top = (low, middle) if feasible(middle) else (middle + 1, top)
    return low, high


def _loose_end(pieces: list[Piece], ends: list[int], reach: int) -> int:
    """The furthest end at or before reach when a piece that is not a single group may be cut anywhere."""
    k = bisect_right(ends, reach) - 1
    return ends[-1] if k >= len(pieces) else ends[k] if pieces[k][2] else reach


def _to_open(pieces: list[Piece], shards: int, low: int, high: int) -> set[str]:
    """Pieces in which the j-th cut can fall for a capacity from low to high."""
    ends, found = [0, *accumulate(size for _, size, _ in pieces)], set()
    widest = max([size for _, size, whole in pieces if not whole], default=0)
    first = last = 0
    for _ in range(shards):
        first, last = _strict_start(pieces, ends, first + low), last + high
        a, b = bisect_right(ends, max(first - widest, 0)) - 1, bisect_right(ends, last)
        found.update(p for p, _, whole in pieces[max(a, 0) : b] if not whole)
    return found


def _strict_start(pieces: list[Piece], ends: list[int], reach: int) -> int:
    """The end of a greedy shard with cuts between pieces only, at or before reach."""
    return ends[min(bisect_right(ends, reach) - 1, len(pieces))]


def _outline(groups: DataFrame, digits: int) -> list[Piece]:
    """(prefix, bytes, whether it is one group) of the groups by the first digits of their digest, in order."""
    rows = (
        groups.groupBy(F.substring("group_key", 1, digits).alias("prefix"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return sorted((r["prefix"], r["bytes"], r["n"] == 1 or digits >= FULL) for r in rows)


def cut_keys(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which shards 1, 2, ... start. groups: one row (group_key, bytes) for each group."""
    pieces, digits = _outline(groups, FIRST), FIRST
    while True:
        low, high = _bounds(pieces, shards)
        opened = _to_open(pieces, shards, low, high) if low < high else set()
        if not opened:
            break
        spark, parent = groups.sparkSession, digits
        digits = min(FULL, digits + STEP)
        # At most a bounded number of prefixes, as each piece is a sliver of the order.
        chosen = spark.createDataFrame([(p,) for p in sorted(opened)], "parent string")
        inner = groups.join(
            F.broadcast(chosen), F.substring("group_key", 1, parent) == F.col("parent"), "left_semi"
        )
        # Prefixes opened before this round are longer or shorter than parent; only those of its length are replaced.
        pieces = sorted([p for p in pieces if p[0] not in opened] + _outline(inner, digits))
    sizes = [size for _, size, _ in pieces]
    return [pieces[at][0] for at in even_cuts(sizes, smallest_capacity(sizes, shards), shards)]


def _shard_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at or before the key."""
    total = F.lit(0)
    for c in cuts:
        total = total + (key >= F.lit(c)).cast("int")
    return total


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs; rows of equal text share a shard.

    A null text is a group of its own of size 16 bytes a row; an empty text is another. Repeated rows (equal ids too)
    each get a row and a slot; null ids stay. Only with fewer groups than shards some shards stay empty. Other columns of
    docs are not read, so their names don't matter. An empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("0" * FULL)).alias("group_key"),
        )
    )
    groups = cut(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")))
    cuts = cut_keys(groups, shards)
    # Rows without an id go by their place in the checkpoint, so that they don't all meet in one cell.
    part = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    cell = F.conv(F.substring("group_key", 1, ORDER_DIGITS), 16, 10).cast("int") * GROUP_PARTS
    cell = cell + F.pmod(part, F.lit(GROUP_PARTS)).cast("int")
    placed = rows.select(
        "doc_id", "size", "text_crc32", "group_key", _shard_of(F.col("group_key"), cuts).alias("shard"), cell.alias("cell")
    )
    # Slots: rows before a cell of a shard, plus the place within the cell. The totals are bounded (see GROUP_PARTS).
    totals = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select(
        "shard",
        "cell",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("shard", "cell").orderBy("group_key", "doc_id")
    return (
        placed.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(before), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))
    )


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The law is ``bytes``: sizes near equal, as equal as groups allow."""
    return assign(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

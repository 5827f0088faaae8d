"""Hard negatives by a vector-approximation file.

Components become integers, and each dimension is cut into CELLS cells at quantiles of a bounded sample; the file holds
a byte for each component of every row, beside the row itself. An anchor has two small tables: the least and the most
that a cell of a dimension can add to its inner product. Summing table entries over a row's bytes bounds the row's
score from both sides, and only rows whose bounds may enter a window or a list of the best are scored exactly.

Anchors come in batches of about BATCH, each of which is sent to the tasks that read the file; a task keeps the best
few of its rows for every anchor, so what is shuffled are short lists and never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import cut

#: An integer component is the floor of SCALE times the component, held to LARGEST either way so that sums fit 64 bits.
SCALE, LARGEST = 256, 1 << 24
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies within these per cent of the positive's.
LOW, HIGH = 30, 90
CELLS = 64
#: Rows that the cells are fitted on, about; anchors of a batch, about; rows and anchors whose bounds are held at once.
SAMPLE, BATCH, ROWS_AT_ONCE, ANCHORS_AT_ONCE = 16_384, 4096, 2048, 128
_NONE = np.iinfo(np.int64).min


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, once each, with integer components."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(SCALE * c))).cast("int"))
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"), odd.alias("odd"))
    return read.where("vec_id is not null and label is not null and v is not null and not odd").select("vec_id", "label", "v").distinct()


@dataclass(frozen=True)
class Grid:
    """The cells of every dimension: inner edges, and the least and the largest component that lies in each cell."""

    edges: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, d]) for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, anchor): the least and the most that a cell can add to an anchor's score."""
        a, b = self.least[:, :, None] * q.T[:, None, :], self.largest[:, :, None] * q.T[:, None, :]
        most = np.abs(q).max(axis=0, initial=0) @ np.maximum(np.abs(self.least).max(axis=1), np.abs(self.largest).max(axis=1))
        kind = np.int32 if most < 1 << 31 else np.int64
        return np.minimum(a, b).astype(kind), np.maximum(a, b).astype(kind)


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    """Rows of components; a shorter row is filled up with zeros."""
    if len(rows) and all(len(row) == dims for row in rows):
        return np.concatenate(rows.to_list()).reshape(len(rows), dims).astype(np.int64)
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def fit_grid(rows: DataFrame, dims: int, cells: int = CELLS) -> Grid:
    """Cells of about equally many of the sampled rows; their outer bounds are those of all rows."""
    n = rows.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share).select("v").limit(2 * SAMPLE).toPandas()
    sample = _matrix(drawn["v"], dims)

    def outer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(dims, LARGEST), np.full(dims, -LARGEST)
        for part in parts:
            if len(part):
                v = _matrix(part["v"], dims)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        yield pd.DataFrame({"d": np.arange(dims), "low": low, "high": high})

    bounds = rows.select("v").mapInPandas(outer, "d long, low long, high long")
    ends = bounds.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("d")
    low, high = ends["low"].to_numpy(), ends["high"].to_numpy()
    if len(sample):
        edges = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").T.astype(np.int64)
    else:
        edges = np.zeros((dims, cells - 1), dtype=np.int64)
    # A cell holds what lies above the edge before it, up to its own; an empty one may have any bounds.
    least = np.concatenate([low[:, None], edges + 1], axis=1)
    largest = np.concatenate([edges, high[:, None]], axis=1)
    return Grid(edges, np.minimum(least, largest), np.maximum(least, largest))


def approximation_file(rows: DataFrame, grid: Grid) -> DataFrame:
    """(vec_id, label, v, cells) of every row: a byte for each dimension."""
    dims = len(grid.edges)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(cells=[c.tobytes() for c in grid.cells(_matrix(part["v"], dims))])

    return rows.mapInPandas(encode, "vec_id long, label long, v array<int>, cells binary")


class Lists:
    """The best rows so far of numbered lists, by falling score, then rising id."""

    def __init__(self, lists: int, length: int):
        self.length = length
        self.at, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        #: The score that a row must reach to enter a list.
        self.least = np.full(lists, _NONE)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        kept = rank < self.length
        self.at, self.score, self.id = at[kept], score[kept], ids[kept]
        full = rank[kept] == self.length - 1
        self.least[self.at[full]] = self.score[full]


def _bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the lower and upper bound of each score."""
    lower = np.zeros((len(cells), low.shape[2]), dtype=low.dtype)
    upper = np.zeros_like(lower)
    for d in range(cells.shape[1]):
        lower += low[d][cells[:, d]]
        upper += high[d][cells[:, d]]
    return lower, upper


def _kth(lower: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """For each column the k-th largest lower bound among sure rows; the least number where there are fewer."""
    if len(lower) < k:
        return np.full(lower.shape[1], _NONE)
    held = np.where(sure, lower, np.iinfo(lower.dtype).min)
    at = np.partition(held, len(held) - k, axis=0)[len(held) - k].astype(np.int64)
    return np.where(at > np.iinfo(lower.dtype).min, at, _NONE)


@dataclass(frozen=True)
class Batch:
    """Anchors that are searched together: number, id, label, vector; and the windows (anchor, low, high) of negatives."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray

    def chunks(self, parts: Iterator[pd.DataFrame], dims: int):
        for part in parts:
            for at in range(0, len(part), ROWS_AT_ONCE):
                rows = part.iloc[at : at + ROWS_AT_ONCE]
                cells = np.frombuffer(b"".join(rows["cells"]), dtype=np.uint8).reshape(len(rows), dims)
                yield rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], dims), cells

    def best_positives(self, parts: Iterator[pd.DataFrame], grid: Grid, length: int) -> Lists:
        found = Lists(len(self.ids), length)
        own = {label: np.nonzero(self.labels == label)[0] for label in np.unique(self.labels)}
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, labels, v, cells in self.chunks(parts, len(grid.edges)):
            for label in np.intersect1d(np.unique(labels), self.labels):
                rows = np.nonzero(labels == label)[0]
                for at in range(0, len(own[label]), ANCHORS_AT_ONCE):
                    anchors = own[label][at : at + ANCHORS_AT_ONCE]
                    lower, upper = _bounds(cells[rows], *grid.tables(self.q[anchors]))
                    # The anchor itself is one of the rows.
                    least = np.maximum(found.least[anchors], _kth(lower, np.ones_like(lower, dtype=bool), length + 1))
                    i, j = np.nonzero(upper >= least)
                    i, j = rows[i], anchors[j]
                    other = (ids[i] != self.ids[j]) | (v[i] != self.q[j]).any(axis=1)
                    i, j = i[other], j[other]
                    found.add(j, np.einsum("nd,nd->n", v[i], self.q[j]), ids[i])
        return found

    def best_negatives(self, parts: Iterator[pd.DataFrame], grid: Grid, windows: np.ndarray, length: int) -> Lists:
        """windows: rows of (anchor, low, high), by anchor."""
        found = Lists(len(windows), length)
        for ids, labels, v, cells in self.chunks(parts, len(grid.edges)):
            for at in range(0, len(self.ids), ANCHORS_AT_ONCE):
                own = np.nonzero((windows[:, 0] >= at) & (windows[:, 0] < at + ANCHORS_AT_ONCE))[0]
                if not len(own):
                    continue
                anchors = np.arange(at, min(at + ANCHORS_AT_ONCE, len(self.ids)))
                lower, upper = _bounds(cells, *grid.tables(self.q[anchors]))
                apart = labels[:, None] != self.labels[anchors][None, :]
                turn = np.arange(len(own)) - np.searchsorted(windows[own, 0], windows[own, 0])
                picked, asked = np.zeros_like(apart), []
                for t in range(turn.max() + 1):
                    mine = own[turn == t]
                    column, low, high = windows[mine, 0] - at, windows[mine, 1], windows[mine, 2]
                    lo, up, ap = (lower, upper, apart) if len(column) == len(anchors) else (lower[:, column], upper[:, column], apart[:, column])
                    within = ap & (lo <= high) & (up >= np.maximum(low, found.least[mine]))
                    if within.sum(axis=0).max(initial=0) > 4 * length:
                        sure = within & (lo >= low) & (up <= high)
                        within &= up >= _kth(lo, sure, length)
                    picked[:, column] |= within
                    asked.append((mine, column, low, high))
                i, j = np.nonzero(picked)
                score = np.einsum("nd,nd->n", v[i], self.q[anchors[j]])
                for mine, column, low, high in asked:
                    spot = np.full(len(anchors), -1)
                    spot[column] = np.arange(len(column))
                    k = spot[j]
                    inside = (k >= 0) & (score >= low[k]) & (score <= high[k]) & (score >= found.least[mine[k]]) if len(mine) else k >= 0
                    found.add(mine[k[inside]], score[inside], ids[i[inside]])
        return found


def _ranked(df: DataFrame, keys: list[str], score: str, ids: str, length: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ids)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)


def _mined(file: DataFrame, grid: Grid, batch: Batch, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of one batch."""

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = batch.best_positives(parts, grid, positives)
        yield pd.DataFrame({"anchor": found.at, "positive_id": found.id, "positive_score": found.score})

    read = file.select("vec_id", "label", "v", "cells")
    chosen = _ranked(read.mapInPandas(near, "anchor long, positive_id long, positive_score long"), ["anchor"], "positive_score", "positive_id", positives)
    pairs = chosen.toPandas().sort_values(["anchor", "rank"])  # a few rows for each anchor of the batch
    score = pairs["positive_score"].to_numpy(dtype=np.int64)
    windows = np.stack([pairs["anchor"].to_numpy(dtype=np.int64), -((-low * score) // 100), high * score // 100], axis=1)
    anchor_id, positive_id = batch.ids[windows[:, 0]], pairs["positive_id"].to_numpy(dtype=np.int64)

    def hard(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = batch.best_negatives(parts, grid, windows, negatives)
        w = found.at
        yield pd.DataFrame(
            {"w": w, "anchor_id": anchor_id[w], "positive_id": positive_id[w], "negative_id": found.id, "positive_score": score[w], "negative_score": found.score}
        )

    kinds = "w long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    best = _ranked(read.mapInPandas(hard, kinds), ["w"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    batch_size: int = BATCH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    is_anchor is a condition on vec_id, label and v (the integer components). An anchor's positives are the rows of its
    label with the highest inner products, its negatives those of other labels within low to high per cent of the
    positive's score; ties go to the smaller id. A positive score of zero admits scores of zero, a negative one nothing.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Repeated rows (same
    id, label and components) count once; rows that share only an id are different rows. A vector shorter than the
    widest is filled up with zeros, and an empty one scores zero. Components are held to +-LARGEST. Labels and ids are
    integers. Other columns aren't read; an empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(integer_rows(vectors, id_col, label_col, vector_col))
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    asked = rows.where(is_anchor)
    batches = -(-asked.count() // batch_size)
    if not batches:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    grid = fit_grid(rows, dims)
    file = cut(approximation_file(rows, grid))
    dealt = asked.withColumn("batch", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(batches)))
    found = []
    for k in range(batches):
        own = dealt.where(F.col("batch") == k).select("vec_id", "label", "v").toPandas()
        if len(own):
            batch = Batch(own["vec_id"].to_numpy(), own["label"].to_numpy(), _matrix(own["v"], dims))
            mined = _mined(file, grid, batch, positives, negatives, low, high)
            found.append(cut(mined) if batches > 1 else mined)
    return reduce(DataFrame.unionByName, found)


def digest(vectors: DataFrame) -> DataFrame:
    """Hard negatives for every hundredth id, after the label of every seventh has moved on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)

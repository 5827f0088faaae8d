"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.operators.lineage import bounded, cut

#: Rows of one key that one task may take from the left side.
MOST = 50_000
#: Pairs of rows that one task compares, by aim, and the most tasks of a join.
WORK, TASKS = 20_000_000, 8192
#: Rows that in_blocks holds in one, by aim.
BLOCK = 64


def dealt(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """left and right with a column salt to join on beside the keys.

    Keys with more than `most` rows of left are dealt to several salts: each row of left has one of them, each row of
    right all. Every other key has one salt. left is read once more for the counts, which are combined before the shuffle.
    """
    most = most or MOST
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = bounded(cut(hot.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("parts"))))
    parts = F.coalesce("parts", F.lit(1))
    one = left.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("parts")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    return one, right.join(hot, keys, "left").withColumn("salt", every).drop("parts")


def in_blocks(df: DataFrame, keys: list[str], held: Column, *more: Column) -> DataFrame:
    """df's rows of equal keys in arrays `held` of about BLOCK, with their number `size` and further aggregates.

    A null key has no block. Keys with many rows are dealt to several blocks by a hash of the whole row. df is read twice.
    """
    sizes = bounded(cut(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))))
    dealt_out = df.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(*df.columns), F.col("parts")))
    blocks = dealt_out.groupBy(*keys, "part").agg(F.collect_list(held).alias("held"), F.count(F.lit(1)).alias("size"), *more)
    return cut(blocks.drop("part"))


def spread(left: DataFrame, right: DataFrame, keys: list[str], size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """left and right with a column salt to join on beside the keys, dealt by the pairs that they make.

    A row counts as one, or as many as its column `size` says.

    A key of over WORK pairs, or of over MOST rows of left, becomes a grid of salts: a row of left goes to one row of the
    grid, a row of right to one column. Where there is more than one task's work, both sides lie in as many partitions as
    it takes, whatever their bytes. Both are read once more for the counts, which are combined before the shuffle.
    """
    number = F.sum(size) if size else F.count(F.lit(1))
    sizes = [df.groupBy(*keys).agg(number.alias(n)) for df, n in ((left, "n"), (right, "m"))]
    sized = cut(sizes[0].join(sizes[1], keys).withColumn("work", F.col("n").cast("double") * F.col("m")))
    total = sized.agg(F.sum("work")).first()[0] or 0.0
    share = max(WORK, total / TASKS)
    parts = F.ceil(F.greatest(F.col("work") / share, F.col("n") / MOST))
    down = F.ceil(F.sqrt(parts)).cast("int")
    hot = bounded(sized.where(parts > 1).select(*keys, down.alias("down"), F.ceil(parts / down).cast("int").alias("across")))
    own, every = F.pmod(F.xxhash64(*left.columns), F.col("down")), F.pmod(F.xxhash64(*right.columns), F.col("across"))

    def salted(df: DataFrame, salts: Column) -> DataFrame:
        made = df.join(hot, keys, "left").withColumn("salt", F.explode(F.when(F.col("down").isNull(), F.array(F.lit(0))).otherwise(salts)))
        made = made.drop("down", "across")
        return made.repartition(min(TASKS, math.ceil(total / WORK) + 1), *keys, "salt") if total > WORK else made

    one = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda k: (own * F.col("across") + k).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda k: (k * F.col("across") + every).cast("int"))
    return salted(left, one), salted(right, other)

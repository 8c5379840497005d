"""Joins to a unique side that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above this many rows, or above this share of all rows if that is more.
HOT_ROWS = 200_000
#: So at most 1 / HOT_SHARE keys are ever hot: the bound of what is broadcast for them.
HOT_SHARE = 0.002


def hot_threshold(total_rows: int) -> int:
    """Rows above which a key counts as hot; no more than ``1 / HOT_SHARE`` keys can exceed it."""
    return int(max(HOT_ROWS, total_rows * HOT_SHARE))


def hot_keys(counts: DataFrame, key: str, total_rows: int) -> list:
    """Keys of ``counts(key, n)`` above the threshold; their number is bounded by construction."""
    limit = hot_threshold(total_rows)
    if total_rows <= limit:
        return []
    return [r[0] for r in counts.filter(F.col("n") > limit).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, whose ``key`` is unique, without moving rows of hot keys.

    Rows with a hot key meet a broadcast of the at most ``1 / HOT_SHARE`` matching rows of
    ``right`` where they lie; all other rows take a shuffled join.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot: Column = F.col(key).isin(hot)
    warm = left.filter(~is_hot | F.col(key).isNull()).join(right.filter(~is_hot), key, how)
    return warm.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))


def number_rows(rows: DataFrame, key: str, scratch: Scratch, tag: str) -> DataFrame:
    """The distinct rows with a dense number ``n`` from 0, in order of ``key``.

    Range partitions number their own rows; their starts are sums of partition sizes, which is all
    that reaches the driver.
    """
    placed = scratch.keep(rows.distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()), tag)
    part = F.shiftrightunsigned("at", 33)
    start, starts = 0, {}
    for p, count in sorted(placed.groupBy(part).count().collect()):  # a row per partition
        starts[p] = start
        start += count
    at = F.create_map(*[F.lit(x) for pair in (starts or {0: 0}).items() for x in pair])
    return placed.withColumn("n", F.element_at(at, part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")

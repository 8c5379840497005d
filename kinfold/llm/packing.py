"""Filling containers of fixed capacity, with a certificate of how close to optimal they are.

Items are spread over partitions by hash and each partition is packed best-fit decreasing.  A
dual feasible function f maps sizes so that whatever fits into one container sums to at most 1;
the sum of f over a partition's items, rounded up, is therefore a lower bound on its containers.
A partition that needs no more than its best such bound is certified optimal and left alone.
Partitions with a gap give the contents of their containers with room left into a common pool,
are spread anew over fewer partitions, and packed again, for as long as a round saves at least
REPACK_GAIN of the containers it opens.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import Scratch

#: Items packed by one task: bounds its memory and keeps partitions large enough to pack well.
ITEMS_PER_PARTITION = 40_000
#: A further round must save this share of the containers it opens.
REPACK_GAIN = 0.001


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Least number of containers for ``counts`` items of ``sizes`` (1..capacity), by dual feasible functions.

    Two families: items above ``capacity - k`` count as whole containers while items below ``k``
    count nothing (every k up to half the capacity); and sizes rounded down to multiples of 1/k
    after scaling by (k + 1).
    """
    keep = (sizes > 0) & (counts > 0)
    sizes, counts = sizes[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(sizes):
        return 0
    number = np.zeros(capacity + 2, np.int64)
    np.add.at(number, sizes, counts)
    n_upto = np.cumsum(number)
    s_upto = np.cumsum(number * np.arange(capacity + 2))
    k = np.arange(0, capacity // 2 + 1)
    big = n_upto[capacity] - n_upto[capacity - k]
    middle = s_upto[capacity - k] - np.where(k > 0, s_upto[np.maximum(k - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 25):
        scaled = sizes * (k + 1)
        f = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * capacity * (k + 1))
        # f / (k (k + 1) capacity) is the image of a size; integers keep the sum exact
        best = max(best, int(-(-int((f * counts).sum()) // (k * (k + 1) * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container number of each item, and how many containers there are; sizes 0..capacity."""
    place = np.zeros(len(sizes), np.int64)
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a container with room r exists
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            container = at_room[room].pop()
            if not at_room[room]:
                rooms &= ~(1 << room)
        else:
            room, container, used = capacity, used, used + 1
        place[i] = container
        at_room[room - size].append(container)
        rooms |= 1 << (room - size)
    return place, used


def pieces(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(spec_name, item, doc_id, first_token, n_tokens, whole): each item once per capacity.

    An item above the capacity is cut into full containers (``whole``) and one remainder; no other
    item is cut.
    """
    specs = F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(capacities.items())])
    each = items.select("item", "doc_id", "n_tokens", F.explode(specs).alias("s")).select("item", "doc_id", "n_tokens", "s.*")
    cut = F.when(F.col("n_tokens") <= F.col("capacity"), F.array(F.lit(0).cast("long"))).otherwise(
        F.expr("sequence(0L, (n_tokens - 1) div capacity)"))
    size = F.least(F.col("capacity"), F.col("n_tokens") - F.col("part") * F.col("capacity"))
    return each.withColumn("part", F.explode(cut)).select(
        "spec_name", "item", "doc_id", (F.col("part") * F.col("capacity")).alias("first_token"), size.alias("n_tokens"), (size == F.col("capacity")).alias("whole"))


PACKED = "spec_name string, item {item}, doc_id long, first_token long, n_tokens long, container long, filled long, certified boolean, bucket long"


def _pack_round(items: DataFrame, capacities: dict[str, int], lanes: dict[str, int], seed: int) -> DataFrame:
    """One packing of every (spec, bucket); buckets are as many as ``lanes`` says."""

    def pack(key, group):
        capacity = capacities[key[0].as_py()]
        group = group.sort_by([("n_tokens", "descending"), ("item", "ascending"), ("first_token", "ascending")])
        sizes = group.column("n_tokens").to_numpy()
        place, used = best_fit_decreasing(sizes, capacity)
        values, counts = np.unique(sizes, return_counts=True)
        filled = np.bincount(place, weights=sizes, minlength=used).astype(np.int64)
        certified = used <= max(1, lower_bound(values, counts, capacity))
        for name, column in (("container", place), ("filled", filled[place]), ("certified", np.full(len(place), certified))):
            group = group.append_column(name, pa.array(column))
        return group.select(["spec_name", "item", "doc_id", "first_token", "n_tokens", "container", "filled", "certified", "bucket"])

    number = F.create_map(*[F.lit(x) for name, n in lanes.items() for x in (name, n)])
    spread = F.pmod(F.xxhash64(F.lit(seed), "item", "first_token"), F.element_at(number, F.col("spec_name")))
    return items.select("spec_name", "item", "doc_id", "first_token", "n_tokens", spread.cast("long").alias("bucket")).groupBy("spec_name", "bucket").applyInArrow(pack, PACKED.format(item=items.schema["item"].dataType.simpleString()))


def _numbers(df: DataFrame, *aggregates) -> dict[str, tuple]:
    return {r[0]: tuple(r)[1:] for r in df.groupBy("spec_name").agg(*aggregates).collect()}  # a row per spec


def fill_containers(items: DataFrame, capacities: dict[str, int], scratch: Scratch, per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(spec_name, container_id, doc_id, first_token, n_tokens, certified) over ``items(item, doc_id, n_tokens)``.

    ``certified`` says of a container that it is full, or that its partition needs no more
    containers than its lower bound.  ``item`` is unique.  Every item is in exactly one container per spec, unless it is above the
    capacity and was cut; an item of no tokens takes no room but is placed.  An empty input gives
    no rows.  Repeated documents are items of their own.
    """
    cut = scratch.keep(pieces(items, capacities), "pieces")
    done = [cut.filter("whole").select("spec_name", F.concat_ws("-", "spec_name", F.lit("full"), "item", "first_token").alias("container_id"), "doc_id", "first_token", "n_tokens", F.lit(True).alias("certified"))]
    open_items = cut.filter("not whole")
    key = F.struct("bucket", "container")
    best: dict[str, int] = {}
    for n in count():
        sizes = _numbers(open_items, F.count(F.lit(1)))
        if not sizes:
            break
        lanes = {name: max(1, math.ceil(s[0] / per_partition)) for name, s in sizes.items()}
        packed = scratch.keep(_pack_round(open_items, capacities, lanes, n + 1), f"packed-{n}")
        capacity = F.element_at(F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair]), F.col("spec_name"))
        if best:
            # a repacking that saves nothing is dropped in favour of the one it started from
            got = _numbers(packed, F.count_distinct(key))
            worse = [s for s in got if got[s][0] > best[s] * (1 - REPACK_GAIN) or got[s][0] >= best[s]]
            if worse:
                done.append(_named(previous.filter(F.col("spec_name").isin(worse) & reopen), n - 1))
                packed = packed.filter(~F.col("spec_name").isin(worse))
        reopen = ~F.col("certified") & (F.col("filled") < capacity)
        room = _numbers(packed.filter(reopen), F.count_distinct(key))
        again = [s for s, (c,) in room.items() if c > 1 and lanes[s] > 1]
        stay = packed if not again else packed.filter(~(F.col("spec_name").isin(again) & reopen))
        done.append(_named(stay, n))
        if not again:
            break
        best = {s: room[s][0] for s in again}
        previous = packed.filter(F.col("spec_name").isin(again))
        open_items = previous.filter(reopen).select("spec_name", "item", "doc_id", "first_token", "n_tokens")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _named(packed: DataFrame, n: int) -> DataFrame:
    return packed.select("spec_name", F.concat_ws("-", "spec_name", F.lit(n), "bucket", "container").alias("container_id"), "doc_id", "first_token", "n_tokens", "certified")


def packing_report(packed: DataFrame, capacities: dict[str, int], spark: SparkSession) -> DataFrame:
    """(spec_name, capacity_tokens, containers, lower_bound, certified_containers, tokens, fill) of a finished packing.

    The bound is over all items together: their sizes form at most ``capacity`` distinct values
    per spec, which is all that reaches the driver.
    """
    counts = packed.groupBy("spec_name", "n_tokens").count().collect()
    per = packed.groupBy("spec_name", "container_id").agg(F.max("certified").alias("sure")).groupBy("spec_name").agg(F.count(F.lit(1)), F.count(F.when(F.col("sure"), 1)))
    used = {r[0]: (r[1], r[2]) for r in per.collect()}
    rows = []
    for name, capacity in sorted(capacities.items()):
        own = [(r["n_tokens"], r["count"]) for r in counts if r["spec_name"] == name]
        sizes, number = (np.array([x[i] for x in own], np.int64) for i in (0, 1))
        tokens = int((sizes * number).sum())
        n, sure = used.get(name, (0, 0))
        rows.append((name, capacity, n, lower_bound(sizes, number, capacity), sure, tokens, tokens / (n * capacity) if n else None))
    return spark.createDataFrame(rows, "spec_name string, capacity_tokens int, containers long, lower_bound long, certified_containers long, tokens long, fill double")

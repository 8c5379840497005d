"""Partitions that keep entities and households whole, by greedy filling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.session import Scratch

UNITS_PER_TASK = 50_000


def _place(filled: dict, shares: dict, n: int) -> str:
    """The partition that a unit of ``n`` records goes to; ``filled`` counts it."""
    name = min(sorted(shares), key=lambda p: ((filled[p] + n) / shares[p], filled[p], p))
    filled[name] += n
    return name


def advance(filled: dict, shares: dict, n: int, count: int) -> dict:
    """``filled`` after ``count`` units of ``n`` records, without placing them one by one.

    Greedy filling takes the units' levels ``(filled + n) / share`` in rising order.  A level that
    at most ``count`` units reach is searched for; the few units left are placed singly.
    """
    reached = lambda x: {p: max(0, math.floor((x * shares[p] - filled[p]) / n) - 1) for p in shares}
    low, high = 0.0, max((filled[p] + n * (count + 2)) / shares[p] for p in shares)
    for _ in range(100):
        middle = (low + high) / 2
        if sum(max(0, math.floor((middle * shares[p] - filled[p]) / n)) for p in shares) <= count:
            low = middle
        else:
            high = middle
    taken = reached(low)
    out = {p: filled[p] + n * taken[p] for p in shares}
    for _ in range(count - sum(taken.values())):
        _place(out, shares, n)
    return out


def entity_household_split(records: DataFrame, fractions: dict[str, float], seed: int, scratch: Scratch) -> DataFrame:
    """(record_key, partition) for ``records(record_key, entity, household)``; a record may have many rows.

    Records, entities and households are vertices of one graph.  Its components are taken by
    falling size and hash, each to the partition filled least for its target.  Components lie in
    that order in tasks; the driver holds a row per task and size, and sizes differ at most
    ``sqrt(2 * records)`` times.
    """
    r = F.concat(F.lit("r"), "record_key").alias("u")
    edges = records.select(r, F.explode(F.array(F.concat(F.lit("r"), "record_key"), F.concat(F.lit("e"), "entity"), F.concat(F.lit("h"), "household"))).alias("v"))
    roots = connected_components(edges.filter("v is not null").distinct(), scratch, "split")
    named = scratch.keep(roots.filter(F.col("node").startswith("r")).select(F.expr("substring(node, 2)").alias("record_key"), "component"), "members")
    sizes = scratch.keep(named.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = named.count()
    shares = {p: f * total for p, f in fractions.items() if f > 0}
    token = F.sha2(F.concat_ws("\x00", "component", F.lit(str(seed))), 256)
    tasks = max(1, math.ceil(sizes.count() / UNITS_PER_TASK))
    ordered = scratch.keep(sizes.withColumn("token", token).repartitionByRange(tasks, F.desc("n"), F.col("token")).withColumn("task", F.spark_partition_id()), "ordered")
    filled, starts = dict.fromkeys(shares, 0), {}
    for x in ordered.groupBy("task", "n").count().orderBy("task", F.desc("n")).collect():
        starts.setdefault(x["task"], dict(filled))
        filled = advance(filled, shares, x["n"], x["count"])

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        state = dict(starts[int(rows["task"].iloc[0])])
        rows = rows.sort_values(["n", "token"], ascending=[False, True])
        return pd.DataFrame({"component": rows["component"], "partition": [_place(state, shares, int(n)) for n in rows["n"]]})

    placed = ordered.groupBy("task").applyInPandas(place, "component string, partition string")
    return named.join(placed, "component").select("record_key", "partition")

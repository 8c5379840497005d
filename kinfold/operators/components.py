"""Connected components by alternating stars, for clustering at a threshold.

Each round ties every vertex's larger neighbours to the smallest vertex it knows, then its smaller
neighbours likewise, until the edges form stars around the smallest vertex of each component.
Minima are combining aggregations and go back to the edges by joins that spare hot vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.skew import hot_keys, join_unique
from kinfold.session import Scratch

MAX_ROUNDS = 60


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(least, "u", total)
    return join_unique(edges, least.select("u", "m"), "u", hot).withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Null ends are ignored, loops make a node of their own, no edges give no rows.
    """
    edges = edges.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    kind = edges.schema["u"].dataType
    nodes = scratch.keep(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{tag}-nodes")
    state = scratch.keep(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(state)
    for n in range(1, MAX_ROUNDS + 1):
        both = state.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = _with_least(both, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        ties = _with_least(large, seen[0])
        small = ties.select("u", F.col("m").alias("v")).unionByName(ties.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        after = scratch.keep(small, f"{tag}-{n}")
        scratch.drop(f"{tag}-{n - 1}")
        state, before, seen = after, seen, mark(after)
        if seen == before:
            root = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").cast(kind).alias("component"))
    raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")

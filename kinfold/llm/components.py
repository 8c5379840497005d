"""Connected components by hash-to-min, over links that never leave the executors.

State: rows ``(v, u)``, meaning that ``u`` is in the cluster of ``v``.  In a round every vertex
sends its cluster to the cluster's minimum and that minimum to every member; the union of what a
vertex receives is its next cluster.  When nothing changes, the minimum of a component holds all
its vertices and every other vertex holds the minimum.

The cluster of a component's minimum can hold a third of all vertices, so a cluster is never
gathered into a row: minima come from a combining aggregation, vertices with very large clusters
get theirs by a broadcast of bounded size, and the union is a distinct over pairs, which no single
vertex can skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.operators.skew import hot_keys, join_unique
from kinfold.session import Scratch

MAX_ROUNDS = 60


def vertex_id(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def build_vertices(keys: DataFrame, scratch: Scratch, tag: str = "vertices") -> tuple[DataFrame, int]:
    """Distinct ``key`` strings with 64-bit ids, and the seed under which no two of them collide.

    The ids are hashes; whether any two keys share one is checked, and if so another seed is
    tried, so that components are never merged by accident.
    """
    for seed in range(1, 9):
        table = scratch.keep(keys.select("key", vertex_id(F.col("key"), seed).alias("id")).distinct(), f"{tag}-{seed}")
        if table.groupBy("id").count().filter("count > 1").isEmpty():
            return table, seed
        scratch.drop(f"{tag}-{seed}")
    raise RuntimeError("vertex ids collide under every seed")


def _marks() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")]


def _fingerprint(state: DataFrame) -> tuple:
    row = state.agg(*_marks()).first()
    return row["n"], row["x"]


def _keep_marked(state: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, tuple]:
    """The state as written, and its fingerprint as observed while it was written."""
    seen = Observation()
    kept = scratch.keep(state.observe(seen, *_marks()), tag)
    return kept, (seen.get["n"], seen.get["x"])


def hash_to_min(edges: DataFrame, scratch: Scratch, tag: str = "state") -> DataFrame:
    """(id, root) for every vertex of ``edges(a, b)``: one root, the smallest id, per component.

    Ids are longs.  Rows with a null end are ignored; a loop ``(a, a)`` makes ``a`` a vertex;
    repeated and mirrored edges change nothing; without edges the result is empty.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ends = F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in ("aa", "ab", "ba", "bb")])
    state, seen = _keep_marked(edges.select(F.inline(ends)).distinct(), scratch, f"{tag}-0")
    for n in range(1, MAX_ROUNDS + 1):
        mins = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = hot_keys(mins, "v", seen[0])
        sent = join_unique(state, mins.select("v", "m"), "v", hot)
        both = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        # a third struct would only repeat (m, m): it arises from u = m
        after, marks = _keep_marked(sent.select(F.inline(both)).distinct(), scratch, f"{tag}-{n}")
        # what is observed can count a retried task twice, so the end is confirmed from the tables
        stable = marks == seen and _fingerprint(after) == _fingerprint(state)
        scratch.drop(f"{tag}-{n - 1}")
        state, seen = after, marks
        if stable:
            return state.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root"))
    raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")


def groups_by_smallest(members: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(root, key) to (group_key, key, size): groups named by their smallest key.

    A group may hold a third of all rows: sizes and smallest keys come from a combining
    aggregation and go back to the rows of large groups by a bounded broadcast.
    """
    members = scratch.keep(members.select("root", "key"), tag)
    named = scratch.keep(members.groupBy("root").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("n")), f"{tag}-named")
    hot = hot_keys(named, "root", members.count())
    return join_unique(members, named, "root", hot).select("group_key", "key", F.col("n").alias("size"))

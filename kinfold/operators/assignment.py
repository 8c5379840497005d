"""Assignment of sources to targets under the constraints a plan names."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.kernels import sparse_assignment
from kinfold.functions.normalise import pair_digest
from kinfold.operators.clustering import utility
from kinfold.operators.components import connected_components
from kinfold.session import Scratch

TIE = 1_000_003


def tie_rank(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % TIE


def edge_costs(edges: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Edges (source, target, probability) with digest, utility and an integer cost without ties."""
    base = edges.withColumn("digest", pair_digest(F.col("source"), F.col("target"))).withColumn("utility", utility(F.col("probability")))
    return base.withColumn("cost", -F.bround(F.col("utility") * scale).cast("long") * TIE + tie_rank(F.col("digest")))


def independent_top1(costed: DataFrame, no_match_utility: float = 0.0) -> DataFrame:
    """(source, target): each source's best target by (utility, digest); none where no match is as good."""
    best = costed.groupBy("source").agg(F.min_by(F.struct("target", "utility"), F.struct((-F.col("utility")).alias("u"), "digest")).alias("b"))
    return best.filter(F.col("b.utility") > no_match_utility).select("source", "b.target")


def _best_per(costed: DataFrame, side: str, no_match_utility: float, capacity: int = 1) -> DataFrame:
    live = costed.filter(F.col("utility") > no_match_utility)
    if capacity == 1:
        return live.groupBy(side).agg(F.min_by(F.struct("source", "target", "probability", "cost"), "cost").alias("b")).select("b.*")
    order = Window.partitionBy(side).orderBy("cost", "digest")
    return live.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= capacity).select("source", "target", "probability", "cost")


EDGE = "source string, target string, probability double, cost long"
#: Edges a task takes at once: many small components share one call of the solver.
EDGES_PER_TASK = 50_000


def assign_edges(edges: pa.Table, free: int, source_capacity: int, target_capacity: int) -> pa.Table:
    """Rows of ``edges(source, target, probability, cost)`` that the assignment of greatest total gain takes.

    Ends are numbered in order of their keys, and edges go to the solver as numbers, one by one:
    in Python a large component is its adjacency and no text.
    """
    def numbered(side: str) -> tuple[np.ndarray, int]:
        codes = edges[side].combine_chunks().dictionary_encode()
        names = np.array(codes.dictionary.to_pylist(), dtype=object)
        place = np.empty(len(names), dtype=np.int64)
        place[np.argsort(names)] = np.arange(len(names))
        return place[codes.indices.to_numpy(zero_copy_only=False)], len(names)

    (s, n_s), (t, n_t) = numbered("source"), numbered("target")
    cost = edges["cost"].to_numpy()
    copies_s, copies_t = np.minimum(np.bincount(s, minlength=n_s), source_capacity), np.minimum(np.bincount(t, minlength=n_t), target_capacity)
    first_s, first_t = np.cumsum(copies_s) - copies_s, np.cumsum(copies_t) - copies_t
    gains = ((first_s[a] + x, first_t[b] + y, free - c) for a, b, c in ((int(a), int(b), int(c)) for a, b, c in zip(s, t, cost, strict=True)) for x in range(copies_s[a]) for y in range(copies_t[b]))
    pairs = sparse_assignment((int(i), int(j), g) for i, j, g in gains if g > 0)
    if not pairs:
        return edges.slice(0, 0).select(["source", "target", "probability", "cost"])
    owner_s, owner_t = np.repeat(np.arange(n_s), copies_s), np.repeat(np.arange(n_t), copies_t)
    wanted = np.unique([int(owner_s[i]) * n_t + int(owner_t[j]) for i, j in pairs])
    key = s * n_t + t
    order = np.lexsort((cost, key))
    return edges.select(["source", "target", "probability", "cost"]).take(pa.array(order[np.searchsorted(key[order], wanted)]))


def _with_ends(costed: DataFrame) -> DataFrame:
    """Edges with their ends u and v as 64-bit numbers, which no two ends share."""
    for seed in range(8):
        number = lambda side: F.xxhash64(F.lit(f"{side}{seed}"), F.col(side))  # noqa: B023, E731
        ends = [costed.select(side).distinct().select(number(side).alias("end")) for side in ("source", "target")]
        if ends[0].unionByName(ends[1]).groupBy("end").count().filter("count > 1").isEmpty():
            return costed.withColumns({"u": number("source"), "v": number("target")})
    raise RuntimeError("ends of edges share their numbers under every seed")


def _by_component(costed: DataFrame, scratch: Scratch, solve, columns: tuple = (), arrow: bool = False) -> DataFrame:
    """Solve each component of the candidate graph by itself: the objective is a sum over components.

    A component of one edge needs no solver and stays in the JVM.  The others are dealt to buckets
    by hash, so that a task works through many small components in one batch.
    """
    columns = columns or ("source", "target", "probability", "cost", "digest")
    costed = _with_ends(scratch.keep(costed.select(*columns), "costed"))
    roots = connected_components(costed.select("u", "v"), scratch, "assign")
    coloured = scratch.keep(costed.join(roots.withColumnRenamed("node", "u"), "u").select("component", *columns), "coloured")
    sizes = scratch.keep(coloured.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    alone = coloured.join(sizes.filter("n = 1"), "component", "left_semi").select("source", "target", "probability", "cost")
    several = coloured.join(sizes.filter("n > 1"), "component", "left_semi")
    buckets = max(1, math.ceil(coloured.count() / EDGES_PER_TASK), costed.sparkSession.sparkContext.defaultParallelism)

    dealt = several.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).select("bucket", *((() if arrow else ("component",)) + columns)).repartition(buckets, "bucket").groupBy("bucket")
    if arrow:
        return alone.unionByName(dealt.applyInArrow(solve, EDGE))

    def solve_all(group: pd.DataFrame) -> pd.DataFrame:
        rows: dict = {}
        for r in group.itertuples(index=False):
            rows.setdefault(r.component, []).append(r)
        return pd.DataFrame([x for key in sorted(rows) for x in solve(rows[key])], columns=["source", "target", "probability", "cost"])

    return alone.unionByName(dealt.applyInPandas(solve_all, EDGE))


def one_to_one(costed: DataFrame, scratch: Scratch, no_match_utility: float = 0.0, source_capacity: int = 1, target_capacity: int = 1, scale: int = 1_000_000) -> DataFrame:
    """(source, target, probability, cost) of greatest total utility; ends stay free where no match is better.

    Capacities above 1 enter an end several times.  Every component is solved exactly, over its edges
    alone, in one task.
    """
    free = -round(no_match_utility * scale) * TIE

    def solve(group: pa.Table) -> pa.Table:
        return assign_edges(group, free, source_capacity, target_capacity)

    return _by_component(costed.filter(F.col("cost") < free), scratch, solve, ("source", "target", "probability", "cost"), arrow=True)


def many_to_one(costed: DataFrame, scratch: Scratch | None = None, no_match_utility: float = 0.0, target_capacity: int | None = None) -> DataFrame:
    """Each source has one target at most, a target up to ``target_capacity`` sources (None: any number)."""
    if target_capacity is None:
        return _best_per(costed, "source", no_match_utility)
    return one_to_one(costed, scratch, no_match_utility, 1, target_capacity)


def one_to_many(costed: DataFrame, scratch: Scratch | None = None, no_match_utility: float = 0.0, source_capacity: int | None = None) -> DataFrame:
    """Each target has one source at most, a source up to ``source_capacity`` targets."""
    if source_capacity is None:
        return _best_per(costed, "target", no_match_utility)
    return one_to_one(costed, scratch, no_match_utility, source_capacity, 1)


def unconstrained(costed: DataFrame, scratch: Scratch | None = None, no_match_utility: float = 0.0, source_capacity: int | None = None, target_capacity: int | None = None) -> DataFrame:
    """All edges better than no match; with capacities greedily in the order (source, cost)."""
    live = costed.filter(F.col("utility") > no_match_utility)
    if target_capacity is None:
        if source_capacity is None:
            return live.select("source", "target", "probability", "cost")
        return _best_per(costed, "source", no_match_utility, source_capacity)

    def solve(group: list) -> list[tuple]:
        left_s: dict = {}
        left_t: dict = {}
        out = []
        for r in sorted(group, key=lambda r: (r.source, r.cost, r.digest)):
            if left_s.get(r.source, 0) < (source_capacity or math.inf) and left_t.get(r.target, 0) < target_capacity:
                left_s[r.source] = left_s.get(r.source, 0) + 1
                left_t[r.target] = left_t.get(r.target, 0) + 1
                out.append((r.source, r.target, r.probability, r.cost))
        return out

    return _by_component(live, scratch, solve)


def assemble(sources: DataFrame, chosen: DataFrame, costed: DataFrame, no_match_utility: float = 0.0) -> DataFrame:
    """(source, target, probability, is_no_match, changed_from_top1) with every source present."""
    top = independent_top1(costed, no_match_utility).withColumnRenamed("target", "top")
    rows = sources.select("source").distinct().join(chosen.select("source", "target", "probability"), "source", "left").join(top, "source", "left")
    return rows.select("source", "target", "probability", F.col("target").isNull().alias("is_no_match"), (~F.col("target").eqNullSafe(F.col("top"))).alias("changed_from_top1"))


def integrity(edges: DataFrame) -> DataFrame:
    """Counts of what is wrong with edges (source, target, probability, rank): duplicates, bad probabilities, ranks not 1..n."""
    per = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    ranks = per.agg(F.coalesce(F.sum(F.when((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n")), 0).otherwise(1)), F.lit(0)).alias("incomplete_ranks"))
    pairs = edges.groupBy("source", "target").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_edges"))
    bad = edges.agg(F.coalesce(F.sum(F.when(F.col("probability").between(0, 1), 0).otherwise(1)), F.lit(0)).alias("bad_probabilities"))
    return reduce(DataFrame.crossJoin, [ranks, pairs, bad])  # three single rows


@dataclass(frozen=True)
class AssignmentPlan:
    """A constraint with its bounds; an input beyond the edge budget is refused before anything is solved."""

    constraint: str = "one_to_one"
    no_match_utility: float = 0.0
    scale: int = 1_000_000
    edge_budget: int = 10_000_000
    source_capacity: int | None = None
    target_capacity: int | None = None

    def __post_init__(self):
        if self.constraint not in ("one_to_one", "many_to_one", "one_to_many", "unconstrained"):
            raise ValueError(f"unknown constraint {self.constraint}")
        if self.scale < 1 or self.edge_budget < 1 or any(c is not None and c < 1 for c in (self.source_capacity, self.target_capacity)):
            raise ValueError("scale, budget and capacities must be at least 1")
        if self.constraint == "one_to_one" and (self.source_capacity or 1, self.target_capacity or 1) != (1, 1):
            raise ValueError("one to one has no capacities")

    def solve(self, edges: DataFrame, scratch: Scratch) -> DataFrame:
        """(source, target, probability, cost) chosen from ``edges(source, target, probability)``."""
        costed = scratch.keep(edge_costs(edges, self.scale), "plan-edges")
        n = costed.count()
        if n > self.edge_budget:
            raise ValueError(f"{n} edges exceed the budget of {self.edge_budget}")
        if self.constraint == "one_to_one":
            return one_to_one(costed, scratch, self.no_match_utility, scale=self.scale)
        if self.constraint == "many_to_one":
            return many_to_one(costed, scratch, self.no_match_utility, self.target_capacity)
        if self.constraint == "one_to_many":
            return one_to_many(costed, scratch, self.no_match_utility, self.source_capacity)
        return unconstrained(costed, scratch, self.no_match_utility, self.source_capacity, self.target_capacity)

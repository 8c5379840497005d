"""Profiles of linkage tasks, distances between them, and advice from benchmark records."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_band(pairs: int) -> str:
    """Band of a candidate budget: small, medium, large or very_large."""
    return "small" if pairs <= 100_000 else "medium" if pairs <= 1_000_000 else "large" if pairs <= 10_000_000 else "very_large"


def mechanism_profile(left: DataFrame, right: DataFrame, label: str, group: str, columns: list[str]) -> DataFrame:
    """One row of rates that describe how two tables differ: one aggregation per table.

    script and punctuation rates, mean words per label, mean missing share and its asymmetry, share
    of the commonest group, share of repeated labels.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        missing = [F.avg(F.when(F.col(c).isNull() | F.col(c).rlike(r"^[ \t\n\x0b\f\r]*$"), 1.0).otherwise(0.0)) for c in columns]
        base = df.agg(F.count(F.lit(1)).alias(f"n{s}"), F.avg(F.col(label).rlike(r"[^\x00-\x7f]").cast("double")).alias(f"script{s}"), F.avg(F.col(label).rlike(r"\p{Punct}").cast("double")).alias(f"punctuation{s}"),
                      F.avg(F.size(F.split(label, r"\s+"))).alias(f"words{s}"), (reduce(lambda a, b: a + b, missing) / len(columns)).alias(f"missing{s}"))
        top = df.groupBy(group).count().agg((F.max("count") / F.sum("count")).alias(f"top{s}"))
        twice = df.groupBy(label).count().agg((F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)) / F.sum("count")).alias(f"repeated{s}"))
        return base.crossJoin(top).crossJoin(twice)  # three single rows

    both = side(left, "_l").crossJoin(side(right, "_r"))  # two single rows
    mean = lambda c: ((F.col(f"{c}_l") + F.col(f"{c}_r")) / 2).alias(c)
    return both.select(mean("script"), mean("punctuation"), mean("words"), mean("missing"), F.abs(F.col("missing_l") - F.col("missing_r")).alias("missing_asymmetry"),
                       mean("top").alias("group_concentration"), mean("repeated").alias("duplicate_rate"), F.log10(F.col("n_l") + F.col("n_r") + 1).alias("size_scale"))


def gower(task: dict, numeric: dict[str, float], categorical: list[str]) -> Column:
    """Distance in [0, 1] of a row to ``task``: mean of differences by range and of mismatches."""
    terms = [F.least(F.abs(F.col(c) - F.lit(float(task[c]))) / span, F.lit(1.0)) for c, span in numeric.items()]
    terms += [F.when(F.col(c) == task[c], 0.0).otherwise(1.0) for c in categorical]
    return reduce(lambda a, b: a + b, terms) / len(terms)


def nearest(families: DataFrame, task: dict, numeric: dict[str, float], categorical: list[str], k: int) -> DataFrame:
    """The k nearest families with their distance, ties by id; k is the feature."""
    return families.withColumn("distance", gower(task, numeric, categorical)).orderBy("distance", "family_id").limit(k)


def family_means(instances: DataFrame, numeric: list[str]) -> DataFrame:
    return instances.groupBy("family_id").agg(*[F.avg(c).alias(c) for c in numeric])


def conformal_threshold(distances: list[float], coverage: float = 0.9) -> float:
    """The ceil((n + 1) coverage)-th smallest distance; infinite where n is too small."""
    rank = math.ceil((len(distances) + 1) * coverage)
    return sorted(distances)[rank - 1] if rank <= len(distances) else math.inf


def pareto(options: DataFrame, costs: list[str], benefits: list[str]) -> DataFrame:
    """Options that no other beats: at least as good everywhere and better somewhere.

    Options are recipes, a few hundred at most; the dominance test is a join of their table with
    itself.
    """
    a, b = options.alias("a"), F.broadcast(options).alias("b")
    no_worse = reduce(lambda x, y: x & y, [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in costs] + [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in benefits])
    better = reduce(lambda x, y: x | y, [F.col(f"b.{c}") < F.col(f"a.{c}") for c in costs] + [F.col(f"b.{c}") > F.col(f"a.{c}") for c in benefits])
    return a.join(b, no_worse & better, "left_anti")


def shortlist(ranked: list[dict], size: int) -> list[dict]:
    """Baseline first, then options of families not yet listed, then the rest, in given order."""
    out = [o for o in ranked if o.get("baseline")][:1]
    for fresh in (True, False):
        for o in ranked:
            if len(out) < size and o not in out and (not fresh or o["family"] not in {x["family"] for x in out}):
                out.append(o)
    return out[:size]


def utility(recall: Column, ppv: Column, brier: Column, failed: Column) -> Column:
    """0.4 recall + 0.4 PPV + 0.2 (1 - Brier), less 0.2 for a failed run, within [0, 1]."""
    raw = 0.4 * recall + 0.4 * ppv + 0.2 * (1 - brier) - F.when(failed, 0.2).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def recipe_evidence(runs: DataFrame) -> DataFrame:
    """(family_id, recipe, mean_utility, runs) from (family_id, recipe, utility)."""
    return runs.groupBy("family_id", "recipe").agg(F.avg("utility").alias("mean_utility"), F.count(F.lit(1)).alias("runs"))


def advise(evidence: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(recipe, expected_utility, families, advice_rank): recipes by their mean over the nearest families."""
    mean = evidence.join(F.broadcast(neighbours.select("family_id")), "family_id").groupBy("recipe").agg(F.avg("mean_utility").alias("expected_utility"), F.count(F.lit(1)).alias("families"))  # k rows
    return mean.withColumn("advice_rank", F.row_number().over(Window.orderBy(F.desc("expected_utility"), "recipe")))  # a row per recipe


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Coefficients and, last, the unpenalised intercept."""
    full = np.hstack([x, np.ones((len(x), 1))])
    penalty = alpha * np.eye(full.shape[1])
    penalty[-1, -1] = 0
    return np.linalg.solve(full.T @ full + penalty, full.T @ y)


def conformal_interval(predicted: float, residuals: list[float], coverage: float = 0.9) -> tuple[float, float]:
    """Interval around a prediction from held-out absolute residuals, within [0, 1]."""
    n = len(residuals)
    width = sorted(residuals)[min(n - 1, math.ceil((n + 1) * coverage) - 1)]
    return max(0.0, predicted - width), min(1.0, predicted + width)


def coverage_report(runs: DataFrame) -> DataFrame:
    """(recipe, runs, families, failure_rate) of a benchmark registry."""
    return runs.groupBy("recipe").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("family_id").alias("families"), F.avg(F.col("failed").cast("double")).alias("failure_rate"))


def co_occurrence(runs: DataFrame) -> DataFrame:
    """(recipe_a, recipe_b, families): families that have runs of both recipes."""
    own = runs.select("family_id", "recipe").distinct()
    return own.toDF("family_id", "recipe_a").join(own.toDF("family_id", "recipe_b"), "family_id").filter("recipe_a < recipe_b").groupBy("recipe_a", "recipe_b").agg(F.count(F.lit(1)).alias("families"))


def coverage_gaps(families: DataFrame, axes: list[str], bands: int = 5) -> DataFrame:
    """(axis, band, families) for every cell of equal width within [0, 1], zeros included, sparsest first."""
    spark = families.sparkSession
    cells = reduce(DataFrame.unionByName, [families.select(F.lit(a).alias("axis"), F.least(F.floor(F.col(a) * bands), F.lit(bands - 1)).cast("int").alias("band")) for a in axes])
    seen = cells.groupBy("axis", "band").agg(F.count(F.lit(1)).alias("families"))
    grid = spark.createDataFrame([(a, b) for a in axes for b in range(bands)], "axis string, band int")
    return grid.join(seen, ["axis", "band"], "left").select("axis", "band", F.coalesce("families", F.lit(0)).alias("families")).orderBy("families", "axis", "band")


def regret(evidence: DataFrame) -> DataFrame:
    """(recipe, mean_regret, oracle_share): distance to each family's best recipe."""
    best = evidence.groupBy("family_id").agg(F.max("mean_utility").alias("best"))
    gap = F.col("best") - F.col("mean_utility")
    return evidence.join(best, "family_id").groupBy("recipe").agg(F.avg(gap).alias("mean_regret"), F.avg((gap == 0).cast("double")).alias("oracle_share"))

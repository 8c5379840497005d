"""Candidate ranks, training groups and samples for rankers and pair models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_candidates(scored: DataFrame, query: str, k: int) -> DataFrame:
    """Rows with candidate_rank 1..n per query by (score falling, pair_digest) and in_top_k."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), "pair_digest")
    return scored.withColumn("candidate_rank", F.row_number().over(order)).withColumn("in_top_k", F.col("candidate_rank") <= k)


def training_groups(labelled: DataFrame, query: str) -> DataFrame:
    """Rows of queries that have more than one row and both labels."""
    good = labelled.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("n > 1 and lo < hi").select(query)
    return labelled.join(good, query, "left_semi")


def top_target(scored: DataFrame) -> DataFrame:
    """(source, target) with the greatest score, ties by digest."""
    return scored.groupBy("source").agg(F.min_by("target", F.struct((-F.col("score")).alias("s"), "pair_digest")).alias("target"))


def model_disagreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """Sources whose top target differs between two scorings."""
    a, b = top_target(one).withColumnRenamed("target", "t1"), top_target(two).withColumnRenamed("target", "t2")
    return a.join(b, "source").filter("t1 != t2").select("source", "t1", "t2")


def hardness(exact: list[Column], levels: list[Column], missing: list[Column]) -> Column:
    """4 per exact agreement, 1 per level above 0, less 0.5 per missing value."""
    total = F.lit(0.0)
    for e in exact:
        total = total + F.when(F.coalesce(e, F.lit(0.0)) >= 0.5, 4.0).otherwise(0.0)
    for lv in levels:
        total = total + F.when(lv > 0, lv.cast("double")).otherwise(0.0)
    for m in missing:
        total = total - F.when(m, 0.5).otherwise(0.0)
    return total


def sample_hard_negatives(labelled: DataFrame, budget: int, hard_share: float, seed: int) -> DataFrame:
    """All positives and, within the budget, the hardest negatives and a seeded choice of the rest.

    The budget bounds a training sample, which is the feature.  ``labelled`` has pair_digest, label
    and hardness.  More positives than the budget stop the job.
    """
    positives = labelled.filter("label = 1")
    n = positives.count()
    if n > budget:
        raise ValueError("more positives than the budget")
    room = budget - n
    hard = int(room * hard_share + 0.5)
    tie = F.sha2(F.concat_ws(":", "pair_digest", F.lit(str(seed))), 256)
    negatives = labelled.filter("label = 0")
    top = negatives.orderBy(F.desc("hardness"), tie).limit(hard)
    rest = negatives.join(top.select("pair_digest"), "pair_digest", "left_anti").orderBy(tie).limit(room - hard)
    return positives.unionByName(top).unionByName(rest)


def label_budget(labelled: DataFrame, budget: int, seed: int) -> DataFrame:
    """At most ``budget`` rows, stratified by class in proportion, each class kept, in hash order."""
    counts = dict(labelled.groupBy("label").count().collect())  # two classes
    total = sum(counts.values())
    out = None
    for label, n in sorted(counts.items()):
        take = max(1, round(budget * n / total)) if total > budget else n
        part = labelled.filter(F.col("label") == label).orderBy(F.sha2(F.concat_ws(":", "pair_digest", F.lit(str(seed))), 256)).limit(take)
        out = part if out is None else out.unionByName(part)
    return labelled if out is None else out


def scoring_groups(scored: DataFrame, query: str) -> DataFrame:
    """Every candidate with the size of its query's group, whatever its label; rows are ordered by (query, pair_digest) when collected."""
    return scored.join(scored.groupBy(query).agg(F.count(F.lit(1)).alias("group_size")), query)

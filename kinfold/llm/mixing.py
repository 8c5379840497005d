"""Mixtures of sources with given shares of the tokens.

Within a source, texts are drawn by exponential keys ``-ln(u) / w``: smallest keys first is
weighted sampling without replacement, w being the text's quality.  A source that must give more
tokens than it has is used in complete epochs first; only the rest is a selection.

Prefix sums over a source never pass through one task: texts are range-partitioned by source and
key, so that buckets are about equal whatever the weights are; bucket sums are added up first, and
exact prefix sums run within buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.session import Scratch

#: Texts a range partition should have, and the most partitions: beyond, they grow, and their sorts spill.
ROWS_PER_BUCKET = 50_000
MOST_BUCKETS = 20_000


def source_name(source: Column) -> Column:
    """One spelling per source: without blanks around it, lower case, ``_`` for ``-`` and blanks."""
    bare = F.regexp_replace(source, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(bare), r"(?U)[-\s]", "_")


def plan_budgets(plans: list[tuple], available: dict[str, int]) -> list[tuple]:
    """(plan, source, target_share, max_repeats, budget, epochs, rest) for each named source.

    The total of a plan is the largest at which every source that is present can give its share
    within its repeats; shares of absent sources go to the others in proportion.
    """
    out = []
    for plan in sorted({p[0] for p in plans}):
        own = [p for p in plans if p[0] == plan]
        present = [p for p in own if available.get(p[1], 0) > 0 and p[2] > 0 and p[3] > 0]
        covered = sum(p[2] for p in present)
        total = min((p[3] * available[p[1]] * covered / p[2] for p in present), default=0)
        for _, source, share, repeats in own:
            has = available.get(source, 0)
            live = any(p[1] == source for p in present)
            budget = min(math.floor(total * share / covered + 0.5), has * repeats) if live else 0
            epochs = budget // has if has else 0
            out.append((plan, source, float(share), int(repeats), int(budget), int(epochs), int(budget - epochs * has)))
    return out


def mix_sources(documents: DataFrame, plans: list[tuple], scratch: Scratch, spark: SparkSession, seed: int = 29,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Uses of texts per plan, and the shares reached.

    ``documents(item, doc_id, source, n_tokens, quality)`` with unique ``item``; ``plans`` holds
    (plan, source, share, max_repeats), a few rows.  The first result is (plan_name, source,
    doc_id, n_tokens, uses); the second (plan_name, source, target_share, available_tokens,
    mixed_tokens, actual_share, most_uses), one row per row of the plan, with zeros for sources
    that are absent.  Texts without tokens are never drawn.  Sources not named by a plan, or null,
    take no part.  A rest is met to within half the text at its end.
    """
    plans = [(p, _plain(s), share, repeats) for p, s, share, repeats in plans]
    named = sorted({p[1] for p in plans})
    own = source_name(F.col("source"))
    drawn = documents.filter("n_tokens > 0").select("item", "doc_id", own.alias("source"), "n_tokens", "quality").filter(F.col("source").isin(named))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    buckets = max(spark.sparkContext.defaultParallelism, min(MOST_BUCKETS, documents.count() // rows_per_bucket))
    keyed = drawn.withColumn("key", -F.log(u) / F.greatest("quality", F.lit(1e-3))).repartitionByRange(buckets, "source", "key", "doc_id", "item")
    placed = scratch.keep(keyed.withColumn("bucket", F.spark_partition_id()), "drawn")
    # a row per named source
    available = dict(placed.groupBy("source").agg(F.sum("n_tokens")).collect())
    budgets = spark.createDataFrame(
        plan_budgets(plans, available), "plan_name string, source string, target_share double, max_repeats int, budget long, epochs long, rest long")

    # a row per source and partition
    starts = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("inside")).select(
        "source", "bucket", (F.sum("inside").over(Window.partitionBy("source").orderBy("bucket")) - F.col("inside")).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.join(starts, ["source", "bucket"]).withColumn("middle", F.col("start") + F.sum("n_tokens").over(within) - F.col("n_tokens") / 2)
    # a few rows per plan: the configuration does not grow with the data
    uses = (ordered.join(F.broadcast(budgets), "source")
            .withColumn("uses", F.col("epochs") + F.when(F.col("middle") <= F.col("rest"), 1).otherwise(0))
            .filter("uses > 0").select("plan_name", "source", "doc_id", "n_tokens", F.col("uses").cast("int").alias("uses")))
    reached = uses.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed"), F.max("uses").alias("most"))
    have = F.create_map(*[F.lit(x) for pair in (available or {"": 0}).items() for x in pair])
    report = budgets.join(reached, ["plan_name", "source"], "left").select(
        "plan_name", "source", "target_share", F.coalesce(F.try_element_at(have, F.col("source")), F.lit(0)).cast("long").alias("available_tokens"),
        F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.col("mixed") / F.sum("mixed").over(Window.partitionBy("plan_name")), F.lit(0.0)).alias("actual_share"),
        F.coalesce("most", F.lit(0)).alias("most_uses"))
    return uses, report


def _plain(source: str | None) -> str | None:
    import re

    return None if source is None else re.sub(r"[-\s]", "_", source.strip().lower())

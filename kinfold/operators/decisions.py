"""Relationship decisions from assignment evidence, review queues and their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.assignment import independent_top1


@dataclass(frozen=True)
class Policy:
    confirmed: float = 0.97
    margin: float = 0.15
    review: float = 0.60
    no_match: float = 0.20


#: Reason codes in the order in which they are listed; the first four are structural.
FLAGS = ("candidate_search_incomplete", "candidate_search_truncated", "calibration_invalid", "insufficient_data_quality", "anchor_conflict", "model_disagreement", "assignment_conflict")
STRUCTURAL = FLAGS[:4]


def top_two(edges: DataFrame) -> DataFrame:
    """(source, top_target, top_probability, second_probability, margin) by (-probability, digest).

    Two combining aggregates per source, no window: a source with very many candidates is no
    sorted group.  ``edges(source, target, probability, digest)``; the second is 0 for one edge.
    """
    best = edges.groupBy("source").agg(F.max("probability").alias("top_probability"))
    at_top = edges.join(best, "source")
    per = at_top.groupBy("source", "top_probability").agg(
        F.min_by("target", F.when(F.col("probability") == F.col("top_probability"), F.col("digest"))).alias("top_target"),
        F.sum(F.when(F.col("probability") == F.col("top_probability"), 1).otherwise(0)).alias("ties"),
        F.max(F.when(F.col("probability") < F.col("top_probability"), F.col("probability"))).alias("lower"))
    second = F.coalesce(F.when(F.col("ties") > 1, F.col("top_probability")).otherwise(F.col("lower")), F.lit(0.0))
    return per.select("source", "top_target", "top_probability", second.alias("second_probability"),
                      F.greatest(F.col("top_probability") - second, F.lit(0.0)).alias("margin"))


def evidence(sources: DataFrame, costed: DataFrame, chosen: DataFrame, no_match_utility: float = 0.0, ranked: DataFrame | None = None) -> DataFrame:
    """One row per chosen edge, or per source without one: what ``classify`` needs, but for flags from elsewhere.

    ``chosen(source, target, probability)`` may hold several targets of a source; a source without
    candidates has a top probability and a margin of 0.  ``assignment_conflict`` is set where the
    assignment is not each source's own first choice: another target than the one of candidate
    rank 1, or none although the best candidate alone is better than no match.  Candidates rank by
    probability, or as ``ranked(source, first_ranked)`` tells.
    """
    best = top_two(costed)
    own = independent_top1(costed, no_match_utility).withColumnRenamed("target", "own_choice")
    rows = (sources.select("source").distinct().join(best, "source", "left")
            .join(chosen.select("source", F.col("target").alias("assigned_target"), "probability"), "source", "left").join(own, "source", "left"))
    assigned = F.col("assigned_target")
    rows = rows.withColumn("first_ranked", F.col("top_target")) if ranked is None else rows.join(ranked, "source", "left")
    conflict = ~assigned.eqNullSafe(F.col("own_choice")) | (assigned.isNotNull() & (assigned != F.col("first_ranked")))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("top_probability", "second_probability", "margin")}
    return rows.withColumns(zero).withColumn("assignment_conflict", conflict).drop("own_choice", "first_ranked")


def classify(evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Evidence with status, decision_rule_id and reasons (comma-separated).

    ``evidence`` has source, assigned_target (null for no match), probability (of the assigned
    edge), top_probability, margin and the boolean FLAGS; null flags count as false.
    """
    flag = lambda f: F.coalesce(F.col(f), F.lit(False))
    anyof = lambda fs: F.array_contains(F.array(*[flag(f) for f in fs]), True)
    structural, conflict = anyof(STRUCTURAL), anyof(FLAGS[4:])
    top, p = F.coalesce("top_probability", F.lit(0.0)), F.coalesce("probability", F.lit(0.0))
    none = F.col("assigned_target").isNull()
    rule = (
        F.when(structural, "unresolved_structural_evidence")
        .when(none & ((top >= policy.review) | conflict), "review_no_match_with_plausible_candidate")
        .when(none & (top <= policy.no_match), "no_match_explicit_assignment")
        .when(none, "unresolved_no_match_margin")
        .when(conflict, "review_conflicting_evidence")
        .when((p >= policy.confirmed) & (F.col("margin") >= policy.margin), "confirmed_calibrated_assigned_margin")
        .when(p >= policy.review, "review_probability_region")
        .otherwise("unresolved_insufficient_probability"))
    status = (F.when(rule.startswith("unresolved"), "unresolved").when(rule.startswith("review"), "review_required")
              .when(rule.startswith("no_match"), "no_match").otherwise("confirmed"))
    out = evidence.withColumn("decision_rule_id", rule).withColumn("status", status)
    reasons = F.array_compact(F.array(*[F.when(flag(f), F.lit(f)) for f in FLAGS]))
    fallback = (F.size(reasons) == 0) & F.col("status").isin("review_required", "unresolved")
    return out.withColumn("reasons", F.when(fallback, F.col("decision_rule_id")).otherwise(F.array_join(reasons, ",")))


def relationship_id(run_id: str) -> Column:
    """sha256 over the decision in canonical JSON (sorted keys)."""
    text = F.format_string('{"decision_rule_id":"%s","run_id":"%s","source":"%s","status":"%s","target":"%s"}',
                           F.col("decision_rule_id"), F.lit(run_id), F.col("source"), F.col("status"), F.coalesce("assigned_target", F.lit("NO_MATCH")))
    return F.sha2(text, 256)


def review_queue(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("status").isin("review_required", "unresolved"))


def uncertainty(p: Column, threshold: float) -> Column:
    """1 at the threshold, falling with the distance from it; 1 for an unknown probability."""
    t = min(max(threshold, 0.01), 0.99)
    inside = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(p.isNull() | F.isnan(p), 1.0).otherwise(F.greatest(1 - F.abs(inside - t) / max(t, 1 - t), F.lit(0.0)))


def margin_score(m: Column) -> Column:
    return F.when(m.isNull() | F.isnan(m) | (m < 0), 1.0).otherwise(1 - F.least(m, F.lit(1.0)))


def committee(*probabilities: Column) -> Column:
    """Spread of the given probabilities; 0 with fewer than two."""
    have = F.filter(F.array(*probabilities), lambda p: p.isNotNull() & ~F.isnan(p))
    return F.when(F.size(have) >= 2, F.array_max(have) - F.array_min(have)).otherwise(0.0)


#: Weight of the most pressing reason; reasons not listed count 0.5.
REASON_WEIGHTS = {
    "review_anchor_conflict": 1.0,
    "review_model_disagreement": 0.95,
    "review_assignment_contention": 0.90,
    "review_probability_region": 0.80,
    "review_candidate_budget_truncated": 0.70,
    "unresolved_insufficient_probability": 0.60,
}
#: Shares of uncertainty, margin, committee and reason in a hybrid priority.
HYBRID = (0.40, 0.30, 0.20, 0.10)


def reason_score(reasons: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for pair in REASON_WEIGHTS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(F.split(reasons, ","), lambda r: F.coalesce(F.try_element_at(weight, r), F.lit(0.5)))), F.lit(0.5))


def priority(u: Column, m: Column, c: Column, reasons: Column, strategy: str = "hybrid", weights: tuple = HYBRID) -> Column:
    """One of the scores by itself, or their weighted mean with that of the strongest reason."""
    alone = {"uncertainty": u, "margin": m, "committee": c}
    if strategy in alone:
        return alone[strategy]
    if strategy != "hybrid":
        raise ValueError(f"unknown strategy {strategy}")
    a, b, d, e = weights
    return (a * u + b * m + d * c + e * reason_score(reasons)) / (sum(weights) if sum(weights) > 0 else 1.0)


def prioritise(queue: DataFrame, budget: int, temperature: float = 1.0) -> DataFrame:
    """The ``budget`` rows of highest priority with queue_rank and softmax sampling_probability.

    The budget is the feature: reviewers can take so many.  ``queue`` has relationship_id, which
    settles ties, and priority, at most 1.  The softmax runs over the whole queue, from one combining
    aggregate; only at a very low temperature must priorities be shifted by their true maximum.
    """
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    top_priority = 1.0 if temperature >= 0.01 else queue.agg(F.max("priority")).first()[0] or 0.0
    shifted = lambda p: F.exp((p - top_priority) / temperature)
    total = queue.agg(F.sum(shifted(F.col("priority"))).alias("z"))  # one row
    top = queue.orderBy(F.desc("priority"), "relationship_id").limit(budget)
    ranked = top.withColumn("queue_rank", F.row_number().over(Window.orderBy(F.desc("priority"), "relationship_id")))  # at most ``budget`` rows
    return ranked.join(F.broadcast(total)).withColumn("sampling_probability", shifted(F.col("priority")) / F.col("z")).drop("z")

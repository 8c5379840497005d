"""Reviews by several people: supersession, consensus, promotion to labels, audit chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.normalise import pair_digest
from kinfold.session import Scratch


def active_events(events: DataFrame) -> DataFrame:
    """Events that no other event supersedes."""
    gone = events.filter(F.col("superseded_event_id").isNotNull() & (F.col("superseded_event_id") != F.col("event_id"))).select(F.col("superseded_event_id").alias("event_id")).distinct()
    return events.join(gone, "event_id", "left_anti")


def supersession_cycles(events: DataFrame, scratch: Scratch) -> DataFrame:
    """(event_id) of events on, or leading into, a cycle of supersessions.

    Links are joined with themselves, so that each round doubles the steps they span; events whose
    chain ends sooner drop out, until nothing changes.
    """
    known = events.select("event_id").distinct()
    links = events.filter("superseded_event_id is not null").select("event_id", F.col("superseded_event_id").alias("to")).distinct()
    links = scratch.keep(links.join(known.withColumnRenamed("event_id", "to"), "to", "left_semi").select("event_id", "to"), "links-0")
    n, i = links.select("event_id").distinct().count(), 0
    while True:
        i += 1
        after = links.withColumnRenamed("to", "by").join(links.withColumnRenamed("event_id", "by"), "by").select("event_id", "to").distinct()
        left = scratch.keep(after, f"links-{i}")
        scratch.drop(f"links-{i - 1}")
        m = left.select("event_id").distinct().count()
        if m == n or m == 0:
            return left.select("event_id").distinct()
        links, n = left, m


POLICIES = ("majority_vote", "senior_reviewer_override", "unanimous_only", "strict_double_review")


@dataclass(frozen=True)
class ConsensusPolicy:
    """How reviews of a pair become one decision."""

    method: str = "majority_vote"
    minimum_reviewers: int = 1
    seniors: tuple = ()

    def __post_init__(self):
        if self.method not in POLICIES:
            raise ValueError(f"unknown consensus policy {self.method}")


def consensus(events: DataFrame, policy: ConsensusPolicy = ConsensusPolicy()) -> DataFrame:
    """One row per pair: left_record_key, right_record_key, outcome, confidence, method, dispute_reason, reviewers, agreement, has_conflict, protocol_version.

    Every active event with a decision is a review and counts, also several by one reviewer;
    ``reviewers`` is their number; a review without confidence has confidence 0.  In order: too few reviews, all agree, seniors decide (not under ``unanimous_only``;
    seniors at odds leave the pair unresolved), more than half agree (``majority_vote`` only), else
    unresolved.  An unresolved pair has no outcome, a confidence of 0 and a dispute reason.
    ``protocol_version`` is "mixed" where reviews differ in it.  Everything is a combining aggregate
    per pair, so a pair with very many reviews is no gathered group.
    """
    key = ["left_record_key", "right_record_key"]
    version = F.col("protocol_version") if "protocol_version" in events.columns else F.lit("")
    senior = F.coalesce(F.col("reviewer_id").isin(list(policy.seniors)), F.lit(False)) if policy.seniors else F.lit(False)
    rows = events.filter("decision is not null").select(F.least(*key).alias(key[0]), F.greatest(*key).alias(key[1]), "decision", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), senior.alias("senior"), version.alias("version"))
    votes = rows.groupBy(*key, "decision").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.count(F.when(F.col("senior"), 1)).alias("s"), F.avg(F.when(F.col("senior"), F.col("confidence"))).alias("sc"),
        F.min("version").alias("v0"), F.max("version").alias("v1"))
    pair = votes.groupBy(*key).agg(
        F.sum("n").alias("reviewers"), F.count(F.lit(1)).alias("options"), F.max(F.struct("n", "c", "decision")).alias("top"),
        F.count(F.when(F.col("s") > 0, 1)).alias("senior_options"), F.max(F.when(F.col("s") > 0, F.struct("s", "sc", "decision"))).alias("senior"),
        F.min("v0").alias("v0"), F.max("v1").alias("v1"))
    needed = max(policy.minimum_reviewers, 2 if policy.method == "strict_double_review" else 1)
    split = F.col("options") > 1
    method = (F.when(F.col("reviewers") < needed, "unresolved").when(~split & (F.col("reviewers") == 1), "single_reviewer").when(~split, "unanimous"))
    dispute = F.when(F.col("reviewers") < needed, F.when(split, "insufficient_reviewers_with_conflict").otherwise("insufficient_reviewers")).when(~split, F.lit(None))
    if policy.method != "unanimous_only":
        method = method.when(F.col("senior_options") == 1, "senior_override").when(F.col("senior_options") > 1, "unresolved")
        dispute = dispute.when(F.col("senior_options") == 1, F.lit(None)).when(F.col("senior_options") > 1, "conflicting_senior_reviewers")
    if policy.method == "majority_vote":
        most = F.col("top.n") * 2 > F.col("reviewers")
        method = method.when(most, "majority")
        dispute = dispute.when(most, F.lit(None)).otherwise("tied_vote")
    else:
        dispute = dispute.otherwise("unanimous_policy_conflict" if policy.method == "unanimous_only" else "double_review_conflict")
    out = pair.withColumn("method", method.otherwise("unresolved")).withColumn("dispute_reason", dispute)
    by_votes, by_senior = F.col("method").isin("single_reviewer", "unanimous", "majority"), F.col("method") == "senior_override"
    return out.select(
        *key, F.when(by_votes, F.col("top.decision")).when(by_senior, F.col("senior.decision")).alias("outcome"),
        F.when(by_votes, F.col("top.c")).when(by_senior, F.col("senior.sc")).otherwise(0.0).alias("confidence"), "method", "dispute_reason", "reviewers",
        (F.col("top.n") / F.col("reviewers")).alias("agreement"), split.alias("has_conflict"), F.when(F.col("v0") != F.col("v1"), "mixed").otherwise(F.col("v0")).alias("protocol_version"))


def require_agreement(resolved: DataFrame, threshold: float) -> DataFrame:
    """Outcomes with less agreement than the threshold become unresolved."""
    weak = F.col("agreement") < threshold
    return resolved.withColumns({"outcome": F.when(~weak, F.col("outcome")), "confidence": F.when(weak, 0.0).otherwise(F.col("confidence")), "method": F.when(weak, "unresolved").otherwise(F.col("method"))})


def disagreement_report(resolved: DataFrame) -> DataFrame:
    """(method, pairs, conflicts, mean_agreement)."""
    return resolved.groupBy("method").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("has_conflict").cast("int")).alias("conflicts"), F.avg("agreement").alias("mean_agreement"))


@dataclass(frozen=True)
class PromotionPolicy:
    """What a reviewed pair needs to become a verified label of ``target_partition``."""

    target_partition: str = "training"
    minimum_confidence: float = 0.80
    minimum_reviewers: int = 1
    double_review: bool = False
    protocols: tuple = ()

    def __post_init__(self):
        if self.target_partition not in ("training", "validation", "calibration", "decision", "test"):
            raise ValueError(f"unknown partition {self.target_partition}")
        if not 0 <= self.minimum_confidence <= 1 or self.minimum_reviewers < 1:
            raise ValueError("confidence must be within 0..1, reviewers at least 1")


def promotion(resolved: DataFrame, locked: DataFrame, policy: PromotionPolicy = PromotionPolicy()) -> DataFrame:
    """Pairs with ``reasons`` against promotion (comma-separated, empty if eligible), ``eligible`` and ``label``.

    ``locked(left_record_key, right_record_key)`` are pairs of the locked test partition, in
    either order.  A pair without outcome has both of the first two reasons.
    """
    key = ["left_record_key", "right_record_key"]
    mark = locked.select(F.least(*key).alias(key[0]), F.greatest(*key).alias(key[1]), F.lit(True).alias("locked")).distinct()
    rows = resolved.join(mark, key, "left")
    outcome, because = F.col("outcome"), lambda when, code: F.when(when, F.lit(code))
    binary = F.coalesce(outcome.isin("match", "nonmatch"), F.lit(False))
    found = [
        because(outcome.isNull(), "unresolved_dispute"), because(~binary, "non_binary_outcome_audit_only"),
        because(F.col("confidence") < policy.minimum_confidence, "insufficient_confidence"), because(F.col("reviewers") < policy.minimum_reviewers, "insufficient_reviewers")]
    if policy.double_review:
        found.append(because(F.col("reviewers") < 2, "requires_double_review"))
    if policy.protocols:
        found.append(because(~F.coalesce(F.col("protocol_version").isin(list(policy.protocols)), F.lit(False)), "unapproved_protocol_version"))
    if policy.target_partition != "test":
        found.append(because(F.coalesce("locked", F.lit(False)), "locked_test_partition_violation"))
    reasons = F.array_compact(F.array(*found))
    eligible = F.size(reasons) == 0
    return rows.withColumns({"reasons": F.array_join(reasons, ","), "eligible": eligible, "label": F.when(eligible, (outcome == "match").cast("int"))}).drop("locked")


def promotion_summary(evaluated: DataFrame) -> DataFrame:
    """(evaluated, eligible, positives, negatives, audit_only, rejected) in one row; what is not eligible is kept for audit only."""
    ok = F.col("eligible")
    return evaluated.agg(F.count(F.lit(1)).alias("evaluated"), F.count(F.when(ok, 1)).alias("eligible"), F.count(F.when(F.col("label") == 1, 1)).alias("positives"),
                         F.count(F.when(F.col("label") == 0, 1)).alias("negatives"), F.count(F.when(~ok, 1)).alias("audit_only"), F.count(F.when(~ok, 1)).alias("rejected"))


def promoted_labels(evaluated: DataFrame, protocol: str, components: DataFrame | None = None) -> DataFrame:
    """Eligible pairs as verified labels: pair_digest, keys, label, entity_components, household_components, verification_protocol.

    ``components(left_record_key, right_record_key, entity_components, household_components)`` says
    what is known of a pair's components; a pair without any gets an entity component of its own.
    """
    key = ["left_record_key", "right_record_key"]
    none = F.array().cast("array<string>")
    good = evaluated.filter("eligible").select(*key, "label").withColumn("pair_digest", pair_digest(F.col(key[0]), F.col(key[1])))
    if components is None:
        good = good.withColumns({"entity_components": none, "household_components": none})
    else:
        good = good.join(components.select(*key, "entity_components", "household_components"), key, "left")
    entity = F.coalesce("entity_components", none)
    own = F.array(F.sha2(F.concat(F.lit("adjudicated-entity:"), "pair_digest"), 256))
    return good.select("pair_digest", *key, "label", F.when(F.size(entity) > 0, entity).otherwise(own).alias("entity_components"),
                       F.coalesce("household_components", none).alias("household_components"), F.lit(protocol).alias("verification_protocol"))


def append_ledger(entries: list[dict], records: list[dict]) -> list[dict]:
    """A hash chain extended by records: every digest covers the one before.  Sequential by nature."""
    import hashlib
    import json

    out = list(entries)
    previous = out[-1]["entry_digest"] if out else "0" * 64
    for record in records:
        body = json.dumps(record, sort_keys=True, separators=(",", ":"), default=str)
        digest = hashlib.sha256(f"{len(out)}\x00{previous}\x00{body}".encode()).hexdigest()
        out.append({"entry_index": len(out), "previous_digest": previous, "body": body, "entry_digest": digest})
        previous = digest
    return out


def ledger_breaks(ledger: DataFrame) -> DataFrame:
    """Entries that do not follow from their predecessor: a join on the index, in parallel.

    ``ledger(entry_index, previous_digest, body, entry_digest)``.
    """
    before = ledger.select((F.col("entry_index") + 1).alias("entry_index"), F.col("entry_digest").alias("expected"))
    own = F.sha2(F.concat(F.col("entry_index").cast("string"), F.lit("\x00"), F.col("previous_digest"), F.lit("\x00"), F.col("body")), 256)
    rows = ledger.join(before, "entry_index", "left").withColumn("expected", F.when(F.col("entry_index") == 0, "0" * 64).otherwise(F.col("expected")))
    return rows.filter(~F.col("previous_digest").eqNullSafe(F.col("expected")) | (F.col("entry_digest") != own)).select("entry_index")

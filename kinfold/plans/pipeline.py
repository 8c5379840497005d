"""A compiled plan run from files to decisions or clusters; every stage is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.normalise import check_identities, pair_digest, prepare
from kinfold.operators import assignment as A
from kinfold.operators import calibration as K
from kinfold.operators import clustering as C
from kinfold.operators import decisions as D
from kinfold.operators import fellegi as FS
from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators.blocking import candidate_pairs, check_bounds, check_budget, random_pairs
from kinfold.operators.components import connected_components
from kinfold.operators.features import anchor_conflicts, anchor_evidence, comparison_features
from kinfold.operators.splitting import entity_household_split
from kinfold.plans.config import LinkagePlan
from kinfold.session import Scratch
from kinfold.sources.readers import read_source


@dataclass
class Run:
    """What a run leaves behind: tables by stage."""

    prepared: dict
    candidates: DataFrame
    features: DataFrame
    scores: DataFrame
    result: DataFrame
    model: dict
    calibrator: K.Calibrator = K.Calibrator()
    judged: DataFrame | None = None
    #: Validation figures of the models that stood for selection, and the name of the one taken.
    reports: tuple = ()
    champion: str = "fellegi_sunter"

    def quality(self, partition: str = "test") -> DataFrame:
        """Metrics of the calibrated scores on labelled candidates of a partition that nothing was fitted on."""
        return M.pair_metrics(self.judged.filter(F.col("partition") == partition).select(self.calibrator.apply(F.col("score")).alias("score"), "label"))


#: What a candidate tells of the rules that found it.
RULES = ("retrieval_rule_ids", "retrieval_rule_count")
#: Random pairs, of all pairs, from which chance agreement is estimated: the size of a sample.
U_PAIRS = 20_000


def _model(features: DataFrame, chance: DataFrame, plan: LinkagePlan) -> dict:
    """u from random pairs, m by expectation-maximisation over the candidates' patterns."""
    levels = {f"{c.id}_level": len(c.levels) for c in plan.comparisons}
    missing = {f"{c.id}_level": next((i for i, lv in enumerate(c.levels) if lv[0] == "missing"), None) for c in plan.comparisons}
    u: dict = {c: [0.0] * n for c, n in levels.items()}
    for r in FS.u_probabilities(chance, levels).collect():  # a row per level
        u[r["comparison"]][r["level"]] = r["probability"]
    rows = [(tuple(r[c] for c in levels), r["pairs"]) for r in FS.patterns(features, list(levels)).collect()]  # at most the product of the levels
    m = FS.expectation_maximisation(rows, levels, u, missing, plan.prior)
    return {"u": u, "m": m, "weights": FS.level_weights(m, u, missing)}


PAIR = ["left_record_key", "right_record_key"]


def judged_candidates(matched: DataFrame, left: DataFrame, right: DataFrame, plan: LinkagePlan, scratch: Scratch) -> DataFrame:
    """Candidates between records of judged matches: partition, label and features.

    ``matched(record_key, entities, households)`` has a row per judged match and record.  Records
    that share an entity component, also through others, are one entity; candidates are labelled by
    whether their records are.  Records are dealt to the plan's partitions with entities and
    households kept whole, and candidates across partitions are left out.
    """
    # numbers for names within the split: two that are equal by chance only keep more together
    short = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    each = lambda c: matched.select("record_key", F.explode(c).alias("x")).filter("x is not null").distinct()
    tied = each("entities").select(short("record", "record_key").alias("u"), short("entity", "x").alias("v"))
    roots = connected_components(tied, scratch, "entities")
    records = matched.select("record_key").distinct().withColumn("node", short("record", "record_key"))
    known = scratch.keep(records.join(roots, "node").select("record_key", F.hex("node").alias("name"), F.hex("component").alias("entity")), "known")
    none = F.lit(None).cast("string")
    homes = each("households").select(F.hex(short("record", "record_key")).alias("record_key"), none.alias("entity"), F.hex(short("household", "x")).alias("household"))
    parts = entity_household_split(known.select(F.col("name").alias("record_key"), "entity", none.alias("household")).unionByName(homes), plan.fractions, 1, scratch)
    dealt = scratch.keep(known.join(parts.withColumnRenamed("record_key", "name"), "name").select("record_key", F.col("entity").alias("v__entity"), F.col("partition").alias("v__part")), "dealt")
    sides = [table.join(dealt, "record_key") for table in (left, right)]
    compared = sorted({c.variable for c in plan.comparisons})
    pairs = candidate_pairs(*sides, plan.rules, unique=True, carry=(*compared, "_entity", "_part")).filter("l__part = r__part")
    labelled = pairs.withColumns({"label": (F.col("l__entity") == F.col("r__entity")).cast("double"), "partition": F.col("l__part")})
    rows = comparison_features(labelled, left, right, list(plan.comparisons), keep=("label", "partition"))
    return scratch.keep(rows.repartition(4, *PAIR).sortWithinPartitions(*PAIR), "judged")  # one order of rows, so that fits repeat


def _supervised(features: DataFrame, judged: DataFrame, model: dict, plan: LinkagePlan, scratch: Scratch) -> tuple[DataFrame, DataFrame, str, tuple]:
    """(scores, judged scores, champion, reports): boosted trees beside the estimated model, and a ranker.

    Trees and ranker are fitted on ``training`` alone; the champion is the model with the higher
    average precision on ``validation``.  Without both labels in ``training``, or any in
    ``validation``, nothing is fitted and the estimated model stands.
    """
    columns = [f"{c.id}_{x}" for c in plan.comparisons for x in ("value", "level", "exact", "missing_left", "missing_right")]
    fs = lambda rows: FS.score(rows, model["weights"], plan.prior)
    wide = lambda rows, *keep: L.matrix(fs(rows), columns, [*PAIR, "match_weight", "match_probability", *keep])
    rows = wide(judged, "label", "partition")
    seen = {r["partition"]: r for r in rows.groupBy("partition").agg(F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    if any(p not in seen or seen[p]["low"] == seen[p]["high"] for p in ("training", "validation")):
        return scratch.keep(fs(features).select(*PAIR, "match_weight", "match_probability"), "scores"), rows.withColumn("score", F.col("match_probability")), "fellegi_sunter", ()
    training = rows.filter("partition = 'training'")
    trees = L.fit_gbt(training.select("x", "label"))
    weights = L.pairwise_ranker(training.withColumn("pair_digest", pair_digest(*map(F.col, PAIR))), PAIR[0], scratch)
    tested = scratch.keep(L.gbt_score(trees, rows, "gbt_probability"), "judged-scores")
    reports = []
    for family, score in (("fellegi_sunter", "match_probability"), ("boosted_trees", "gbt_probability")):
        r = M.pair_metrics(tested.filter("partition = 'validation'").select(F.col(score).alias("score"), "label")).first()
        reports.append({"family": family, "id": score, "version": "1", "contract": plan.digest, "average_precision": r["average_precision"], "brier": r["brier"]})
    best = K.select_champion(reports)
    scored = L.gbt_score(trees, wide(features).withColumn("rank_score", L.linear_score(weights)), "gbt_probability")
    return scratch.keep(scored, "scores"), tested.withColumn("score", F.col(best["id"])), best["family"], tuple(reports)


def first_choices(scores: DataFrame) -> DataFrame:
    """(source, first_ranked, model_disagreement): the ranker's first target, and whether the two models' first targets differ; ties by digest."""
    digest = pair_digest(*map(F.col, PAIR))
    first = lambda c: F.min_by("right_record_key", F.struct((-F.col(c)).alias("s"), "digest"))
    per = scores.withColumn("digest", digest).groupBy(F.col("left_record_key").alias("source")).agg(
        first("rank_score").alias("first_ranked"), first("match_probability").alias("one"), first("gbt_probability").alias("two"))
    return per.select("source", "first_ranked", (F.col("one") != F.col("two")).alias("model_disagreement"))


def run_plan(spark: SparkSession, plan: LinkagePlan, roots: list[str] | None = None, truth: DataFrame | None = None, matched: DataFrame | None = None) -> Run:
    """Prepare, block, compare, estimate, score, calibrate, then assign and decide, or cluster.

    With ``matched(record_key, entities, households)``, the records of judged matches under the keys
    of the prepared tables, boosted trees and a ranker are trained, the better model is selected,
    its scores are calibrated, and sources on whose first target the models differ are flagged;
    each step on a partition of its own.

    With ``truth(record_key, entity, household)``, keys being those of the prepared tables, records
    are dealt to the plan's partitions with entities and households kept whole; scores are
    calibrated on labelled candidates of ``calibration``, the calibrator chosen on ``validation``,
    and ``test`` is left for ``Run.quality``.

    More candidates than the plan's budget stop the run before features are made.
    """
    scratch = Scratch(spark, "run")
    prepared = {}
    for d in plan.datasets:
        rows = read_source(spark, d.path, d.format, [d.identity, *[c for _, c in d.columns]], roots)
        table = scratch.keep(prepare(rows, d.id, d.identity, {v: (c, plan.variables[v]) for v, c in d.columns}, strict=True), f"prepared-{d.id}")
        check_identities(table)
        prepared[d.id] = table
    tables = list(prepared.values())
    left, right = tables[0], tables[-1]
    dedupe = plan.mode == "dedupe_only"
    other = None if dedupe else right
    open_count = check_bounds(left, other, plan.rules, plan.pair_budget)
    compared = tuple(sorted({c.variable for c in plan.comparisons}))
    candidates = candidate_pairs(left, other, plan.rules, unique=True, carry=compared)
    if open_count:
        check_budget(candidates, plan.pair_budget)
    found = scratch.keep(comparison_features(candidates, left, right, list(plan.comparisons), keep=RULES), "features")
    candidates, features = found.select("left_record_key", "right_record_key", *RULES), found.drop(*RULES)
    chance = comparison_features(random_pairs(left, right, U_PAIRS, seed=1, scratch=scratch), left, right, list(plan.comparisons))
    model = _model(features, chance, plan)
    calibrator, judged, champion, reports = K.Calibrator(), None, "fellegi_sunter", ()
    if matched is not None and plan.fractions:
        scores, judged, champion, reports = _supervised(features, judged_candidates(matched, left, right, plan, scratch), model, plan, scratch)
        calibrator = K.choose_calibrator(judged.filter("partition = 'calibration'"), judged.filter("partition = 'validation'"))
    else:
        scores = scratch.keep(FS.score(features, model["weights"], plan.prior).select(*PAIR, "match_weight", "match_probability"), "scores")
    score = "gbt_probability" if champion == "boosted_trees" else "match_probability"
    if truth is not None and plan.fractions:
        parts = scratch.keep(entity_household_split(truth, plan.fractions, 1, scratch), "partitions")
        pairs = M.labels_within(candidates.select("left_record_key", "right_record_key"), parts, truth.select("record_key", "entity").distinct())
        judged = scratch.keep(pairs.join(scores, ["left_record_key", "right_record_key"]).select("left_record_key", "right_record_key", "partition", "label", F.col("match_probability").alias("score")), "judged")
        calibrator = K.choose_calibrator(judged.filter("partition = 'calibration'"), judged.filter("partition = 'validation'"))
    edges = scores.select(F.col("left_record_key").alias("source"), F.col("right_record_key").alias("target"), calibrator.apply(F.col(score)).alias("probability"))
    if dedupe:
        weighted = edges.toDF("u", "v", "weight")
        result = C.dedupe_components(left.select("record_key"), weighted, 0.5, scratch)
        return Run(prepared, candidates, features, scores, result, model, calibrator, judged)
    costed = A.edge_costs(edges)
    solver = {"one_to_one": A.one_to_one, "many_to_one": A.many_to_one, "one_to_many": A.one_to_many, "unconstrained": A.unconstrained}[plan.constraint]
    if plan.mode == "link_and_dedupe":
        own = {}
        for name, table in prepared.items():
            pairs = candidate_pairs(table, None, plan.rules, unique=True, carry=compared)
            inner = FS.score(comparison_features(pairs, table, table, list(plan.comparisons)), model["weights"], plan.prior)
            weighted = inner.select(F.col("left_record_key").alias("u"), F.col("right_record_key").alias("v"), F.col("match_probability").alias("weight"))
            own[name] = C.dedupe_components(table.select("record_key"), weighted, 0.5, Scratch(spark, f"own-{name}")).select("record_key", F.col("canonical_key").alias("cluster_key"))
        first, second = list(own.values())
        result = C.link_and_dedupe(edges, first, second, lambda e: solver(A.edge_costs(e), scratch))
        return Run(prepared, candidates, features, scores, result, model, calibrator, judged)
    firsts = scratch.keep(first_choices(scores), "first-choices") if reports else None
    evidence = D.evidence(left.select(F.col("record_key").alias("source")), costed, scratch.keep(solver(costed, scratch), "assigned"), ranked=firsts.select("source", "first_ranked") if reports else None)
    if reports:
        evidence = evidence.join(firsts.select("source", "model_disagreement"), "source", "left")
    if plan.anchors:
        flagged = anchor_conflicts(anchor_evidence(left, right, list(plan.anchors))).select(F.col("left_record_key").alias("source"), F.lit(True).alias("anchor_conflict"))
        evidence = evidence.join(flagged, "source", "left")
    if judged is not None:
        evidence = evidence.withColumn("calibration_invalid", F.lit(calibrator.name == "none"))
    for f in D.FLAGS:
        if f not in evidence.columns:
            evidence = evidence.withColumn(f, F.lit(False))
    decided = D.classify(evidence, plan.policy).withColumn("relationship_id", D.relationship_id(plan.digest[:12]))
    return Run(prepared, candidates, features, scores, decided, model, calibrator, judged, reports, champion)

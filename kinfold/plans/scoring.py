"""Queries from scores to decisions: model, clusters, assignment, decisions, reviews, metrics, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.normalise import pair_digest
from kinfold.operators import adjudication as J
from kinfold.operators import assignment as A
from kinfold.operators import calibration as K
from kinfold.operators import clustering as C
from kinfold.operators import decisions as D
from kinfold.operators import fellegi as FS
from kinfold.operators import metrics as M
from kinfold.operators import ranking as R
from kinfold.operators.changefeed import apply_changes
from kinfold.operators.splitting import entity_household_split
from kinfold.plans.general import _FOLD, ADJUDICATION_PAYLOAD, _feed, _newest
from kinfold.plans.linkage import latest
from kinfold.session import Scratch, read_table

LEVELS = {"label_similarity_level": 5, "date_difference_level": 5, "group_agreement_level": 3}
MISSING = {"label_similarity_level": 0, "date_difference_level": 0, "group_agreement_level": 0}
#: A fixed model for the scoring query.
WEIGHTS = {"label_similarity_level": [0.0, 9.5, 6.25, 2.5, -4.75], "date_difference_level": [0.0, 8.0, 4.5, 1.25, -3.5], "group_agreement_level": [0.0, 5.5, -2.75]}
PRIOR = 0.01
THRESHOLD = 0.95
#: Reviewers whose word settles conflicts, and the protocols whose reviews may become labels.
SENIORS = ("reviewer-007", "reviewer-010", "reviewer-011")
PROTOCOLS = ("protocol_v1",)


def newest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l, r, p): every unordered pair of different records with the probability of its newest run, if any."""
    f = read_table(spark, sf_dir, "comparison_features").filter("left_record_key != right_record_key")
    newest = f.groupBy(F.least("left_record_key", "right_record_key").alias("l"), F.greatest("left_record_key", "right_record_key").alias("r")).agg(
        F.max(F.struct("run_no", F.coalesce("match_probability", F.lit(-1.0)).alias("p"))).alias("x"))
    return newest.select("l", "r", F.col("x.p").alias("p")).filter("p >= 0")


def edges(spark, sf_dir):
    return newest_pairs(spark, sf_dir).filter(F.col("l").startswith("source-a") & F.col("r").startswith("source-b")).select(F.col("l").alias("source"), F.col("r").alias("target"), F.col("p").alias("probability"))


def graph(spark, sf_dir):
    return newest_pairs(spark, sf_dir).select(F.col("l").alias("u"), F.col("r").alias("v"), F.col("p").alias("weight"))


def nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.select(F.explode(F.array("u", "v")).alias("record_key")).distinct().withColumn("dataset_id", F.substring("record_key", 1, 8))


def fs_u(spark, sf_dir):
    u = FS.u_probabilities(read_table(spark, sf_dir, "comparison_features"), LEVELS)
    return u.select("comparison", "level", "pairs", F.round("probability", 9).alias("probability"))


def fs_patterns(spark, sf_dir):
    return FS.patterns(read_table(spark, sf_dir, "comparison_features"), list(LEVELS))


def fs_em(spark, sf_dir):
    f = read_table(spark, sf_dir, "comparison_features")
    u: dict = {c: [0.0] * n for c, n in LEVELS.items()}
    for r in FS.u_probabilities(f, LEVELS).collect():  # a row per level
        u[r["comparison"]][r["level"]] = r["probability"]
    rows = [(tuple(r[c] for c in LEVELS), r["pairs"]) for r in FS.patterns(f, list(LEVELS)).collect()]  # at most the product of the levels
    m = FS.expectation_maximisation(rows, LEVELS, u, MISSING, PRIOR)
    w = FS.level_weights(m, u, MISSING)
    return spark.createDataFrame([(c, i, m[c][i], u[c][i], w[c][i]) for c in LEVELS for i in range(LEVELS[c])], "comparison string, level int, m double, u double, weight double")


def fs_score(spark, sf_dir):
    s = FS.score(read_table(spark, sf_dir, "comparison_features"), WEIGHTS, PRIOR)
    return s.select("left_record_key", "right_record_key", "run_no", F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 6).alias("match_probability"))


def dedupe_components(spark, sf_dir):
    out = C.dedupe_components(nodes(spark, sf_dir), graph(spark, sf_dir), THRESHOLD, Scratch(spark, "dedupe"))
    return out.withColumn("mean_probability", F.round("mean_probability", 9))


def dedupe_summary(spark, sf_dir):
    return C.size_distribution(dedupe_components(spark, sf_dir).withColumnRenamed("canonical_key", "cluster_key"))


def _solver(name, **kw):
    return lambda spark, sf_dir: C.solve_components(nodes(spark, sf_dir), graph(spark, sf_dir), Scratch(spark, name), name, THRESHOLD, **kw)


def multi_components(spark, sf_dir):
    scratch = Scratch(spark, "multi")
    n, g = nodes(spark, sf_dir), C.build_graph(graph(spark, sf_dir)).filter(F.col("weight") >= THRESHOLD)
    found = C.dedupe_components(n, g, THRESHOLD, scratch).select("record_key", F.col("canonical_key").alias("cluster_key"))
    return C.crosswalk(n, found, g).withColumn("confidence", F.round("confidence", 9))


def cluster_entities(spark, sf_dir):
    scratch = Scratch(spark, "entities")
    n, g = nodes(spark, sf_dir), scratch.keep(C.build_graph(graph(spark, sf_dir)).filter(F.col("weight") >= THRESHOLD), "graph")
    found = scratch.keep(C.dedupe_components(n, g, THRESHOLD, scratch).select("record_key", F.col("canonical_key").alias("cluster_key")), "found")
    return C.cluster_entities(n, found, g).withColumn("mean_weight", F.round("mean_weight", 9))


def crosswalk_agglomerative(spark, sf_dir):
    n = nodes(spark, sf_dir)
    apart = read_table(spark, sf_dir, "verified_labels").filter("label = 0").select(F.least("left_record_key", "right_record_key").alias("u"), F.greatest("left_record_key", "right_record_key").alias("v")).distinct()
    scratch = Scratch(spark, "entities")
    solved = scratch.keep(C.solve_components(n, graph(spark, sf_dir), scratch, "agglomerative", 0.8, cannot_link=apart), "solved")
    return C.crosswalk(n, solved, graph(spark, sf_dir).filter("weight >= 0.8"))


def violations(spark, sf_dir):
    v = read_table(spark, sf_dir, "verified_labels").select(F.least("left_record_key", "right_record_key").alias("u"), F.greatest("left_record_key", "right_record_key").alias("v"), "label").distinct()
    n = nodes(spark, sf_dir)
    found = C.dedupe_components(n, graph(spark, sf_dir), THRESHOLD, Scratch(spark, "violations")).select("record_key", F.col("canonical_key").alias("cluster_key"))
    return C.constraint_violations(found, n, v.filter("label = 0"), v.filter("label = 1"))


def costed(spark, sf_dir):
    return A.edge_costs(edges(spark, sf_dir))


def _out(df):
    return df.select("source", "target", F.round("probability", 6).alias("probability"))


def assign_one_to_one(spark, sf_dir):
    e = edges(spark, sf_dir)
    scratch = Scratch(spark, "assign")
    costed = scratch.keep(A.edge_costs(e), "all")
    return A.assemble(costed.select("source"), A.one_to_one(costed, scratch), costed)


def assign_result(spark, sf_dir):
    e = A.edge_costs(edges(spark, sf_dir))
    return A.assemble(e.select("source"), A.many_to_one(e), e).select("source", "target", F.round("probability", 6).alias("probability"), "is_no_match", "changed_from_top1")


def assign_capped(spark, sf_dir):
    return _out(A.many_to_one(costed(spark, sf_dir), Scratch(spark, "capped"), target_capacity=1))


def link_and_dedupe(spark, sf_dir):
    n = nodes(spark, sf_dir)
    own = lambda p: graph(spark, sf_dir).filter(F.col("u").startswith(p) & F.col("v").startswith(p))
    part = lambda p, t: C.dedupe_components(n.filter(F.col("record_key").startswith(p)), own(p), THRESHOLD, Scratch(spark, t)).select("record_key", F.col("canonical_key").alias("cluster_key"))
    return C.link_and_dedupe(edges(spark, sf_dir), part("source-a", "left"), part("source-b", "right"), lambda e: A.many_to_one(A.edge_costs(e)))


def evidence(spark, sf_dir):
    e = A.edge_costs(edges(spark, sf_dir))
    rows = D.evidence(e, e, A.many_to_one(e, no_match_utility=-1.5), -1.5)
    v = read_table(spark, sf_dir, "verified_labels")
    conflict = v.filter("label = 0").select(F.col("left_record_key").alias("source"), F.lit(True).alias("anchor_conflict")).distinct()
    rows = rows.join(conflict, "source", "left")
    poor = latest(spark, sf_dir, "source_a").filter("label_value is null").select(F.col("record_key").alias("source"), F.lit(True).alias("insufficient_data_quality"))
    rows = rows.join(poor, "source", "left")
    for f in D.FLAGS:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(False))
    return rows


def decisions(spark, sf_dir):
    d = D.classify(evidence(spark, sf_dir))
    return d.withColumn("relationship_id", D.relationship_id("run-1")).select(
        "source", "assigned_target", "status", "decision_rule_id", "reasons", "relationship_id", *[F.round(c, 6).alias(c) for c in ("top_probability", "margin")])


def review_priority(spark, sf_dir):
    q = D.review_queue(decisions(spark, sf_dir))
    p = D.priority(D.uncertainty(F.col("top_probability"), 0.5), D.margin_score(F.col("margin")), D.committee(F.col("top_probability"), F.lit(0.5)), F.col("reasons"))
    return q.select("source", "relationship_id", "status", F.round(p, 6).alias("priority"))


def review_queue(spark, sf_dir):
    return D.prioritise(review_priority(spark, sf_dir), 100).select("source", "relationship_id", "priority", "queue_rank", F.round("sampling_probability", 9).alias("sampling_probability"))


def events(spark, sf_dir):
    return apply_changes(read_table(spark, sf_dir, "adjudication_feed"), _feed(ADJUDICATION_PAYLOAD))


def active(spark, sf_dir):
    return J.active_events(events(spark, sf_dir)).select("event_id", "left_record_key", "right_record_key", "decision")


def consensus(spark, sf_dir):
    return J.consensus(J.active_events(events(spark, sf_dir))).withColumns({"confidence": F.round("confidence", 6), "agreement": F.round("agreement", 6)})


def senior_consensus(spark, sf_dir):
    """Two reviews at least; seniors settle conflicts."""
    policy = J.ConsensusPolicy("strict_double_review", seniors=SENIORS)
    return J.consensus(J.active_events(events(spark, sf_dir)), policy).withColumns({"confidence": F.round("confidence", 6), "agreement": F.round("agreement", 6)})


def promotion(spark, sf_dir):
    p = promotion_rows(spark, sf_dir)
    return p.select("left_record_key", "right_record_key", "outcome", "reasons", "eligible", F.col("label").cast("string").alias("label"))


def promotion_rows(spark, sf_dir):
    return J.promotion(J.require_agreement(consensus(spark, sf_dir), 0.6), read_table(spark, sf_dir, "verified_labels"), J.PromotionPolicy(double_review=True, protocols=PROTOCOLS))


def promoted(spark, sf_dir):
    """Eligible pairs as labels, with the components that verified labels know of their pair."""
    p = J.promoted_labels(promotion_rows(spark, sf_dir), "adjudication")
    return p.select("pair_digest", "left_record_key", "right_record_key", "label", F.array_join("entity_components", ",").alias("entity_components"))


def disagreement(spark, sf_dir):
    return J.disagreement_report(consensus(spark, sf_dir)).withColumn("mean_agreement", F.round("mean_agreement", 6))


def cycles(spark, sf_dir):
    return J.supersession_cycles(events(spark, sf_dir), Scratch(spark, "cycles"))


def scored_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("source", "target", F.col("probability").alias("score"), pair_digest(F.col("source"), F.col("target")).alias("pair_digest"))


def labelled(spark, sf_dir):
    """(l, r, label, score, digest): judged pairs that have a probability."""
    v = read_table(spark, sf_dir, "verified_labels").select(F.least("left_record_key", "right_record_key").alias("l"), F.greatest("left_record_key", "right_record_key").alias("r"), "label").distinct()
    return v.join(newest_pairs(spark, sf_dir), ["l", "r"]).select("l", "r", "label", F.col("p").alias("score"), pair_digest(F.col("l"), F.col("r")).alias("pair_digest"))


def from_a_to_b(pairs: DataFrame) -> DataFrame:
    """Pairs of source-a and source-b in whichever order they stand, turned to source-a on the left."""
    l, r = F.least("left_record_key", "right_record_key"), F.greatest("left_record_key", "right_record_key")  # noqa: E741
    return pairs.withColumns({"left_record_key": l, "right_record_key": r}).filter(F.col("left_record_key").startswith("source-a") & F.col("right_record_key").startswith("source-b"))


def retrieval(spark, sf_dir):
    f = from_a_to_b(read_table(spark, sf_dir, "comparison_features"))
    truth = from_a_to_b(read_table(spark, sf_dir, "verified_labels").filter("label = 1"))
    a = latest(spark, sf_dir, "source_a").select(F.col("record_key").alias("left_record_key"))
    m = M.retrieval(a, f, truth, latest(spark, sf_dir, "source_b").count())
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


def rule_yield(spark, sf_dir):
    f = read_table(spark, sf_dir, "comparison_features")
    norm = f.withColumn("retrieval_rule_ids", F.lower(F.regexp_replace(F.regexp_replace("retrieval_rule_ids", r"\s", ""), "[;|]", ",")))
    either = {"left_record_key": F.least("left_record_key", "right_record_key"), "right_record_key": F.greatest("left_record_key", "right_record_key")}
    one = norm.withColumns(either).groupBy("left_record_key", "right_record_key").agg(F.array_join(F.array_sort(F.collect_set("retrieval_rule_ids")), ",").alias("retrieval_rule_ids"))
    return M.rule_yield(one, read_table(spark, sf_dir, "verified_labels").filter("label = 1").withColumns(either))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pair_metrics(spark, sf_dir):
    return _rounded(M.pair_metrics(labelled(spark, sf_dir)))


def ranking_metrics(spark, sf_dir):
    ranked = R.rank_candidates(labelled(spark, sf_dir), "l", 5).select(F.col("l").alias("query"), F.col("candidate_rank").alias("rank"), "label")
    return _rounded(M.ranking_metrics(ranked, ranked.filter("label = 1").select("query")))


def assignment_metrics(spark, sf_dir):
    e = A.edge_costs(edges(spark, sf_dir))
    got = A.assemble(e.select("source"), A.many_to_one(e), e)
    return M.assignment_metrics(got, true_pairs(spark, sf_dir))


def true_pairs(spark, sf_dir):
    v = from_a_to_b(read_table(spark, sf_dir, "verified_labels").filter("label = 1"))
    return M.truth_pairs(v.select(F.col("left_record_key").alias("source"), F.col("right_record_key").alias("target")))


def threshold_metrics(spark, sf_dir):
    d = D.classify(evidence(spark, sf_dir)).select(F.col("source"), "top_target", "status")
    v = read_table(spark, sf_dir, "verified_labels").select(F.col("left_record_key").alias("source"), F.col("right_record_key").alias("top_target"), "label").distinct()
    return _rounded(M.threshold_metrics(d.join(v, ["source", "top_target"])))


def stratified(spark, sf_dir):
    sizes = edges(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    s = labelled(spark, sf_dir).join(sizes, F.col("l") == F.col("source"))
    return _rounded(s.groupBy(M.size_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("label").alias("positive_rate"), F.avg("score").alias("mean_score")))


def clusters(spark, sf_dir):
    g = F.regexp_replace("group_value", "[^A-Za-z0-9]", "")
    return latest(spark, sf_dir, "source_a").select("record_key", F.coalesce(F.upper(g), F.lit("?")).alias("predicted"), F.coalesce(F.substring("date_value", 1, 4), F.lit("?")).alias("true"))


def cluster_metrics(spark, sf_dir):
    return _rounded(M.cluster_metrics(clusters(spark, sf_dir)))


def split_records(spark, sf_dir):
    """(record_key, entity, household): every component that any row with label 1 names, one a row and the other null."""
    v = read_table(spark, sf_dir, "verified_labels").filter("label = 1").select(F.explode(F.array("left_record_key", "right_record_key")).alias("record_key"), "entity_components", "household_components")
    none = F.lit(None).cast("string")
    e = v.select("record_key", F.explode_outer("entity_components").alias("entity"), none.alias("household"))
    h = v.select("record_key", none.alias("entity"), F.explode("household_components").alias("household"))
    return e.unionByName(h).distinct()


def split(spark, sf_dir):
    config = read_table(spark, sf_dir, "split_config").collect()  # a row per partition
    return entity_household_split(split_records(spark, sf_dir), {r["partition_name"]: r["fraction"] for r in config}, 3, Scratch(spark, "split"))


def split_disjoint(spark, sf_dir):
    named = split(spark, sf_dir).join(split_records(spark, sf_dir), "record_key")
    units = named.select("partition", F.col("entity")).unionByName(named.select("partition", F.concat(F.lit("household "), "household").alias("entity")))
    return M.disjointness(units.filter("entity is not null"), "entity", "partition")


def calib_apply(spark, sf_dir):
    s, steps = F.col("score"), [(0.1, 0.02), (0.35, 0.2), (0.6, 0.45), (0.85, 0.8), (0.99, 0.97)]
    return labelled(spark, sf_dir).select("l", "r", F.round(K.sigmoid_apply(s, 1.25, -0.3), 6).alias("sigmoid"), F.round(K.beta_apply(s, 1.1, 0.8, 0.2), 6).alias("beta"), K.isotonic_apply(s, steps).alias("isotonic"))


def calib_fit(spark, sf_dir):
    s = Scratch(spark, "calibrate").keep(labelled(spark, sf_dir), "labelled")
    iso = K.fit_isotonic(s)
    rows = [("sigmoid", *K.fit_sigmoid(s), None), ("beta", *K.fit_beta(s)), ("isotonic", float(len(iso)), iso[0][1], iso[-1][1])]
    return spark.createDataFrame(rows, "calibrator string, a double, b double, c double")


def reliability(spark, sf_dir):
    return _rounded(K.reliability(labelled(spark, sf_dir)))


def brier_ece(spark, sf_dir):
    return _rounded(K.calibration_errors(labelled(spark, sf_dir)))


def rank_topk(spark, sf_dir):
    return R.rank_candidates(scored_edges(spark, sf_dir), "source", 3).select("source", "target", "candidate_rank", "in_top_k")


def rank_groups(spark, sf_dir):
    return R.training_groups(labelled(spark, sf_dir), "l").select("l", "r", "label")


def model_disagreement(spark, sf_dir):
    f = from_a_to_b(FS.score(read_table(spark, sf_dir, "comparison_features"), WEIGHTS, PRIOR))
    two = f.groupBy(F.col("left_record_key").alias("source"), F.col("right_record_key").alias("target")).agg(F.round(F.max("match_weight"), 6).alias("score"))
    return R.model_disagreement(scored_edges(spark, sf_dir), two.withColumn("pair_digest", pair_digest(F.col("source"), F.col("target"))))


def hard_negatives(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("hardness", F.round("score", 4))
    n = rows.filter("label = 1").count()
    return R.sample_hard_negatives(rows, n + 100, 0.5, 11).select("pair_digest", "label")


QUERIES = {
    "fs_u_probabilities": fs_u, "fs_patterns": fs_patterns, "fs_em": fs_em, "fs_score": fs_score,
    "dedupe_components": dedupe_components, "dedupe_cluster_summary": dedupe_summary, "clique": _solver("clique"), "correlation": _solver("correlation", one_per_dataset=False),
    "agglomerative": _solver("agglomerative", one_per_dataset=True), "multi_components": multi_components, "cluster_entities": cluster_entities, "crosswalk": crosswalk_agglomerative, "constraint_violations": violations,
    "assign_top1": lambda s, d: A.independent_top1(costed(s, d)), "assign_many_to_one": lambda s, d: _out(A.many_to_one(costed(s, d))), "assign_one_to_many": lambda s, d: _out(A.one_to_many(costed(s, d))),
    "assign_unconstrained": lambda s, d: _out(A.unconstrained(costed(s, d), source_capacity=2)), "assign_one_to_one": assign_one_to_one, "assign_capped": assign_capped,
    "assign_result": assign_result, "link_and_dedupe": link_and_dedupe,
    "decision_evidence": lambda s, d: _rounded(D.top_two(costed(s, d))), "decisions": decisions, "decision_counts": lambda s, d: decisions(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("sources")),
    "review_priority": review_priority, "review_queue": review_queue,
    "adjudication_active": active, "adjudication_consensus": consensus, "adjudication_senior": senior_consensus, "adjudication_promotion": promotion, "adjudication_promotion_summary": lambda s, d: J.promotion_summary(promotion_rows(s, d)), "adjudication_promoted": promoted, "adjudication_disagreement": disagreement, "adjudication_cycles": cycles,
    "metric_retrieval": retrieval, "metric_rule_yield": rule_yield, "metric_pairs": pair_metrics, "metric_ranking": ranking_metrics, "metric_assignment": assignment_metrics, "truth_pairs": true_pairs,
    "metric_threshold": threshold_metrics, "metric_stratified": stratified, "metric_clusters": cluster_metrics, "split_entities": split, "split_disjoint": split_disjoint,
    "calib_apply": calib_apply, "calib_fit": calib_fit, "calib_reliability_bins": reliability, "calib_brier_ece": brier_ece,
    "rank_topk": rank_topk, "rank_groups": rank_groups, "model_disagreement": model_disagreement, "hard_negatives": hard_negatives,
}

_NEWEST = """with np as materialized (select l, r, p from (select least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, match_probability as p,
  row_number() over (partition by least(left_record_key, right_record_key), greatest(left_record_key, right_record_key) order by run_no desc, coalesce(match_probability, -1) desc) as rn
  from comparison_features where left_record_key <> right_record_key) where rn = 1 and p is not null),
e as materialized (select l as source, r as target, p as probability from np where l like 'source-a%' and r like 'source-b%'),
nd as (select distinct record_key, substr(record_key, 1, 8) as dataset_id from (select l as record_key from np union all select r from np)),
c as materialized (select *, greatest(-30.0, least(30.0, ln(q / (1 - q)))) as utility from (select *, sha256(source || chr(0) || target) as digest, least(greatest(probability, 1e-12), 1 - 1e-12) as q from e)),
k as materialized (select *, (-round_even(utility * 1000000, 0)::bigint * 1000003 + ('0x' || substr(digest, 1, 12))::bigint % 1000003)::bigint as cost from c),
lab as materialized (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, label from verified_labels),
sc as materialized (select lab.l, lab.r, label, p as score, sha256(lab.l || chr(0) || lab.r) as pair_digest from lab join np on lab.l = np.l and lab.r = np.r)"""
_COMPONENTS = _NEWEST.replace("with np", "with recursive np", 1) + f""", g as materialized (select l as u, r as v, p as w from np where p >= {THRESHOLD}),
  sym as materialized (select u, v from g union select v, u from g),
  reach as (select u as a, u as b from sym union select a, v from reach join sym on b = u),
  comp as materialized (select nd.record_key, coalesce(min(b), nd.record_key) as canonical_key from nd left join reach on a = nd.record_key group by nd.record_key),
  size as (select canonical_key, count(*) as cluster_size from comp group by 1),
  inner_e as (select canonical_key, count(*) as edge_count, avg(w) as mean from g join comp on record_key = u group by 1),
  full_c as materialized (select record_key, canonical_key, cluster_size, coalesce(edge_count, 0) as edge_count, round(coalesce(mean, 1.0), 9) as mean_probability
    from comp join size using (canonical_key) left join inner_e using (canonical_key))"""
_TOP1 = "top1 as (select source, target from (select *, row_number() over (partition by source order by utility desc, digest) as rn from c) where rn = 1 and utility > 0)"
_EVENTS = _FOLD.strip() + ", ev as materialized (select event_id, " + ", ".join(f"{_newest(x)} as {x}" for x in ADJUDICATION_PAYLOAD) + """ from f join alive using (event_id) group by event_id),
  act as materialized (select * from ev where event_id not in (select superseded_event_id from ev where superseded_event_id is not null and superseded_event_id <> event_id)),
  rv as materialized (select least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, decision, coalesce(confidence, 0.0) as confidence, protocol_version,
    coalesce(reviewer_id in ('reviewer-007', 'reviewer-010', 'reviewer-011'), false) as senior from act where decision is not null),
  vt as (select l, r, decision, count(*) as n, avg(confidence) as cf, count(*) filter (where senior) as s, avg(confidence) filter (where senior) as sc from rv group by 1, 2, 3),
  pv as (select l, r, case when min(protocol_version) <> max(protocol_version) then 'mixed' else min(protocol_version) end as protocol_version from rv group by 1, 2),
  pr as materialized (select l, r, sum(n)::bigint as reviewers, count(*) as options, max(n) as best, arg_max(decision, n) as top, arg_max(cf, n) as cf,
    count(*) filter (where s > 0) as senior_options, any_value(decision) filter (where s > 0) as sd, any_value(sc) filter (where s > 0) as scf from vt group by 1, 2),
  mv as (select *, case when options = 1 and reviewers = 1 then 'single_reviewer' when options = 1 then 'unanimous' when best * 2 > reviewers then 'majority' else 'unresolved' end as method from pr),
  cs as materialized (select l as left_record_key, r as right_record_key, case when method <> 'unresolved' then top end as outcome, round(case when method <> 'unresolved' then cf else 0.0 end, 6) as confidence, method,
    case when method = 'unresolved' then 'tied_vote' end as dispute_reason, reviewers, round(best / reviewers, 6) as agreement, options > 1 as has_conflict, protocol_version from mv join pv using (l, r))"""
_PROMOTED = _EVENTS + """, ag as (select * replace (case when agreement >= 0.6 then outcome end as outcome, case when agreement >= 0.6 then confidence else 0.0 end as confidence) from cs),
  lk as (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from verified_labels),
  rs as (select ag.*, concat_ws(',', case when outcome is null then 'unresolved_dispute' end, case when outcome is null or outcome not in ('match', 'nonmatch') then 'non_binary_outcome_audit_only' end,
    case when confidence < 0.8 then 'insufficient_confidence' end, case when reviewers < 1 then 'insufficient_reviewers' end, case when reviewers < 2 then 'requires_double_review' end,
    case when protocol_version is distinct from 'protocol_v1' then 'unapproved_protocol_version' end, case when lk.l is not null then 'locked_test_partition_violation' end) as reasons
    from ag left join lk on lk.l = left_record_key and lk.r = right_record_key),
  pm as materialized (select *, reasons = '' as eligible, case when reasons = '' then (outcome = 'match')::int end as label from rs)"""
_LATEST_A = """la as (select * from (select *, row_number() over (partition by record_key order by load_id desc, updated_at desc nulls last, coalesce(label_value, ''), coalesce(date_value, ''), coalesce(group_value, '')) as rn
  from source_a) where rn = 1)"""
_EVID = _NEWEST + ", " + _LATEST_A + """, tt as (select source, max(probability) as top_probability from c group by 1),
  t2 as (select c.source, tt.top_probability, arg_min(target, digest) filter (where probability = tt.top_probability) as top_target,
    sum((probability = tt.top_probability)::int) as ties, max(probability) filter (where probability < tt.top_probability) as lower from c join tt using (source) group by 1, 2),
  top as materialized (select source, top_target, top_probability, coalesce(case when ties > 1 then top_probability else lower end, 0.0) as second_probability,
    greatest(top_probability - coalesce(case when ties > 1 then top_probability else lower end, 0.0), 0.0) as margin from t2)"""
_DECIDED = _EVID + """, ch as (select source, arg_min(target, cost) as assigned_target, arg_min(probability, cost) as probability from k where utility > -1.5 group by 1),
  own as (select source, target as own_choice from (select *, row_number() over (partition by source order by utility desc, digest) as rn from c) where rn = 1 and utility > -1.5),
  ev as (select top.*, assigned_target, coalesce(probability, 0.0) as p, source in (select left_record_key from verified_labels where label = 0) as anchor, source in (select record_key from la where label_value is null) as poor,
    assigned_target is distinct from own_choice or coalesce(assigned_target <> top_target, false) as moved from top left join ch using (source) left join own using (source)),
  d1 as (select *, case when poor then 'unresolved_structural_evidence' when assigned_target is null and (top_probability >= 0.6 or anchor or moved) then 'review_no_match_with_plausible_candidate'
    when assigned_target is null and top_probability <= 0.2 then 'no_match_explicit_assignment' when assigned_target is null then 'unresolved_no_match_margin' when anchor or moved then 'review_conflicting_evidence'
    when p >= 0.97 and margin >= 0.15 then 'confirmed_calibrated_assigned_margin' when p >= 0.6 then 'review_probability_region' else 'unresolved_insufficient_probability' end as decision_rule_id from ev),
  d2 as (select *, case when decision_rule_id like 'unresolved%' then 'unresolved' when decision_rule_id like 'review%' then 'review_required' when decision_rule_id like 'no_match%' then 'no_match' else 'confirmed' end as status,
    concat_ws(',', case when poor then 'insufficient_data_quality' end, case when anchor then 'anchor_conflict' end, case when moved then 'assignment_conflict' end) as found from d1),
  dec as materialized (select source, top_target, assigned_target, status, decision_rule_id, case when found = '' and status in ('review_required', 'unresolved') then decision_rule_id else found end as reasons,
    sha256('{"decision_rule_id":"' || decision_rule_id || '","run_id":"run-1","source":"' || source || '","status":"' || status || '","target":"' || coalesce(assigned_target, 'NO_MATCH') || '"}') as relationship_id,
    round(top_probability, 6) as top_probability, round(margin, 6) as margin from d2)"""
_PRIORITY = _DECIDED + """, pq as materialized (select source, relationship_id, status, round(0.4 * (1 - abs(top_probability - 0.5) / 0.5) + 0.3 * (1 - least(margin, 1.0)) + 0.2 * abs(top_probability - 0.5)
  + 0.1 * list_max(list_transform(string_split(reasons, ','), lambda x: case x when 'review_anchor_conflict' then 1.0 when 'review_model_disagreement' then 0.95 when 'review_assignment_contention' then 0.9
  when 'review_probability_region' then 0.8 when 'review_candidate_budget_truncated' then 0.7 when 'unresolved_insufficient_probability' then 0.6 else 0.5 end)), 6) as priority from dec where status in ('review_required', 'unresolved'))"""
_SCORE = " + ".join(["log2(0.01 / 0.99)"] + [f"(case {c} " + " ".join(f"when {i} then {w}::double" for i, w in enumerate(ws)) + " else 0.0 end)" for c, ws in WEIGHTS.items()])
_cells = " union all ".join(f"select '{c}' as comparison, {c}::integer as level from comparison_features" for c in LEVELS)
_grid = ", ".join(f"('{c}', {i}, {n})" for c, n in LEVELS.items() for i in range(n))


ORACLE = {
    "fs_u_probabilities": f"""with x as ({_cells}), g(comparison, level, n) as (values {_grid}), s as (select comparison, level, count(*) as pairs from x where level is not null group by 1, 2),
      a as (select g.comparison, g.level, n, coalesce(pairs, 0)::bigint as pairs from g left join s on g.comparison = s.comparison and g.level = s.level)
      select comparison, level, pairs, round((pairs + 1.0::double) / (sum(pairs) over (partition by comparison) + n), 9) as probability from a""",
    "fs_patterns": f"select {', '.join(LEVELS)}, count(*) as pairs from comparison_features group by all",
    "fs_score": f"""select left_record_key, right_record_key, run_no, round(w, 6) as match_weight, round(case when w >= 0 then 1 / (1 + power(2.0, -w)) else power(2.0, w) / (1 + power(2.0, w)) end, 6) as match_probability
      from (select *, {_SCORE} as w from comparison_features)""",
    "dedupe_components": _COMPONENTS + " select * from full_c",
    "dedupe_cluster_summary": _COMPONENTS + " select cluster_size, count(*) as clusters from size group by 1",
    "multi_components": _COMPONENTS + """ select record_key, dataset_id, global_entity_id, record_key = canonical_key as is_canonical, cluster_size,
      round(case when cluster_size = 1 then 1.0 else mean_probability end, 9) as confidence from full_c join nd using (record_key)
      join (select canonical_key, sha256(string_agg(record_key || chr(0) || dataset_id || chr(10), '' order by record_key)) as global_entity_id from comp join nd using (record_key) group by 1) using (canonical_key)""",
    "cluster_entities": _COMPONENTS + """, ds as (select canonical_key, dataset_id, count(*) as n from comp join nd using (record_key) group by 1, 2),
      dd as (select canonical_key, string_agg(dataset_id || '=' || n, ',' order by dataset_id) as datasets from ds group by 1),
      h as (select canonical_key, sha256(string_agg(record_key || chr(0) || dataset_id || chr(10), '' order by record_key)) as global_entity_id from comp join nd using (record_key) group by 1)
      select distinct canonical_key as cluster_key, global_entity_id, cluster_size, datasets, edge_count, mean_probability as mean_weight from full_c join dd using (canonical_key) join h using (canonical_key)""",
    "constraint_violations": _COMPONENTS + """, j as (select lab.label, a.canonical_key as ca, b.canonical_key as cb from lab join comp a on a.record_key = lab.l join comp b on b.record_key = lab.r),
      dc as (select canonical_key, dataset_id, count(*) - 1 as x from comp join nd using (record_key) group by 1, 2)
      select (select count(*) from j where label = 0 and ca = cb) as cannot_link_violations, (select count(*) from j where label = 1 and ca <> cb) as must_link_violations, (select sum(x)::bigint from dc) as dataset_collisions""",
    "assign_top1": _NEWEST + ", " + _TOP1 + " select * from top1",
    "assign_many_to_one": _NEWEST + " select source, arg_min(target, cost) as target, round(arg_min(probability, cost), 6) as probability from k where utility > 0 group by source",
    "assign_one_to_many": _NEWEST + " select arg_min(source, cost) as source, target, round(arg_min(probability, cost), 6) as probability from k where utility > 0 group by target",
    "assign_unconstrained": _NEWEST + """ select source, target, round(probability, 6) as probability from (select *, row_number() over (partition by source order by cost, digest) as rn from k where utility > 0) where rn <= 2""",
    "assign_result": _NEWEST + ", " + _TOP1 + """, m as (select source, arg_min(target, cost) as target, arg_min(probability, cost) as probability from k where utility > 0 group by source)
      select s.source, m.target, round(m.probability, 6) as probability, m.target is null as is_no_match, m.target is distinct from top1.target as changed_from_top1
      from (select distinct source from e) s left join m on m.source = s.source left join top1 on top1.source = s.source""",
    "decision_evidence": _EVID + " select source, top_target, round(top_probability, 6) as top_probability, round(second_probability, 6) as second_probability, round(margin, 6) as margin from top",
    "decisions": _DECIDED + " select * exclude (top_target) from dec",
    "decision_counts": _DECIDED + " select status, count(*) as sources from dec group by 1",
    "review_priority": _PRIORITY + " select * from pq",
    "review_queue": _PRIORITY + """ select source, relationship_id, priority, row_number() over (order by priority desc, relationship_id)::integer as queue_rank,
      round(exp(priority - (select max(priority) from pq)) / (select sum(exp(priority - (select max(priority) from pq))) from pq), 9) as sampling_probability from pq order by priority desc, relationship_id limit 100""",
    "adjudication_active": _EVENTS + " select event_id, left_record_key, right_record_key, decision from act",
    "adjudication_consensus": _EVENTS + " select * from cs",
    "adjudication_disagreement": _EVENTS + " select method, count(*) as pairs, sum(has_conflict::int)::bigint as conflicts, round(avg(agreement), 6) as mean_agreement from cs group by 1",
    "adjudication_senior": _EVENTS + """, sv as (select *, case when reviewers < 2 then 'unresolved' when options = 1 then 'unanimous' when senior_options = 1 then 'senior_override' else 'unresolved' end as method,
      case when reviewers < 2 and options > 1 then 'insufficient_reviewers_with_conflict' when reviewers < 2 then 'insufficient_reviewers' when options = 1 or senior_options = 1 then null
        when senior_options > 1 then 'conflicting_senior_reviewers' else 'double_review_conflict' end as dispute_reason from pr)
      select l as left_record_key, r as right_record_key, case method when 'unanimous' then top when 'senior_override' then sd end as outcome, round(case method when 'unanimous' then cf when 'senior_override' then scf else 0.0 end, 6) as confidence,
        method, dispute_reason, reviewers, round(best / reviewers, 6) as agreement, options > 1 as has_conflict, protocol_version from sv join pv using (l, r)""",
    "adjudication_promotion": _PROMOTED + " select left_record_key, right_record_key, outcome, reasons, eligible, label::varchar as label from pm",
    "adjudication_promotion_summary": _PROMOTED + """ select count(*) as evaluated, count(*) filter (where eligible) as eligible, count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives,
      count(*) filter (where not eligible) as audit_only, count(*) filter (where not eligible) as rejected from pm""",
    "adjudication_promoted": _PROMOTED + """ select sha256(left_record_key || chr(0) || right_record_key) as pair_digest, left_record_key, right_record_key, label,
      sha256('adjudicated-entity:' || sha256(left_record_key || chr(0) || right_record_key)) as entity_components from pm where eligible""",
    "metric_retrieval": "with " + _LATEST_A + """, f as (select * from (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from comparison_features) where l like 'source-a%' and r like 'source-b%'),
      t as (select * from (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from verified_labels where label = 1) where l like 'source-a%' and r like 'source-b%'),
      s as (select record_key, (select count(*) from f where l = record_key) as n from la), tf as (select count(*) as tp, count(f.l) as tfound from t left join f on t.l = f.l and t.r = f.r)
      select sum(n)::bigint as candidate_pairs, any_value(tp) as true_pairs, any_value(tfound) as true_found, round(any_value(tfound) / any_value(tp), 6) as recall, sum((n = 0)::int)::bigint as zero_candidate_sources,
      round(avg(n), 6) as mean_size, round(quantile_cont(n, 0.5), 6) as median_size, round(quantile_cont(n, 0.95), 6) as p95_size, round(quantile_cont(n, 0.99), 6) as p99_size, max(n) as largest_size,
      round(1 - sum(n) / (count(*) * (select count(distinct record_key) from source_b)), 6) as reduction from s, tf""",
    "metric_rule_yield": r"""with n as (select least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, lower(regexp_replace(regexp_replace(retrieval_rule_ids, '\s', '', 'g'), '[;|]', ',', 'g')) as ids from comparison_features),
      x as (select distinct l, r, unnest(string_split(ids, ',')) as rule from n), t as (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from verified_labels where label = 1)
      select rule, count(*) as pairs, count(t.l) as true_pairs from x left join t on x.l = t.l and x.r = t.r group by rule""",
    "metric_pairs": _NEWEST + """, st as (select score, sum(label) as y, count(*) as n from sc group by 1), cu as (select *, sum(y) over (order by score desc) as cy, sum(n) over (order by score desc) as cn from st),
      t as (select sum(label) as p, count(*) as n, avg((score - label) ** 2) as brier, sum((score >= 0.5 and label = 1)::int) as tp, sum((score >= 0.5 and label = 0)::int) as fp from sc),
      a as (select sum(y * cy / cn) as ap, sum((n - y) * (cy - y / 2)) as auc from cu)
      select n as pairs, p::bigint as positives, round(ap / p, 6) as average_precision, round(auc / (p * (n - p)), 6) as roc_auc, round(brier, 6) as brier, round(tp / p, 6) as sensitivity, round(tp / (tp + fp), 6) as ppv,
      round(fp / (tp + fp), 6) as false_link_rate, round((p - tp) / p, 6) as missed_link_rate from t, a""",
    "metric_ranking": _NEWEST + """, rk as (select l, label, row_number() over (partition by l order by score desc, pair_digest) as rank from sc), q as (select l, min(rank) as best from rk where label = 1 group by l)
      select count(*) as queries, round(avg((best = 1)::int), 6) as top1, round(avg(1 / best), 6) as mrr, round(avg(best), 6) as mean_rank, round(quantile_cont(best, 0.5), 6) as median_rank,
      round(avg((best <= 1)::int), 6) as recall_at_1, round(avg((best <= 5)::int), 6) as recall_at_5, round(avg((best <= 10)::int), 6) as recall_at_10 from q""",
    "metric_assignment": _NEWEST + """, m as (select source, arg_min(target, cost) as target from k where utility > 0 group by source), g as (select s.source, target as got from (select distinct source from e) s left join m using (source)),
      w as (select l as source, min(r) as want from (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from verified_labels where label = 1) where l like 'source-a%' and r like 'source-b%' group by 1 having count(*) = 1),
      b as (select got, want, coalesce(got = want, false) as hit from g full join w using (source))
      select sum(hit::int)::bigint as correct_links, sum((got is not null and not hit)::int)::bigint as false_links, sum((want is not null and not hit)::int)::bigint as missed_links,
      sum((got is null and want is null)::int)::bigint as correct_no_match, count(*) as sources from b""",
    "truth_pairs": "select l as source, min(r) as target from (select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from verified_labels where label = 1) where l like 'source-a%' and r like 'source-b%' group by 1 having count(*) = 1",
    "metric_threshold": _DECIDED + """, j as (select status, label from dec join (select distinct left_record_key, right_record_key, label from verified_labels) v on v.left_record_key = source and v.right_record_key = top_target),
      s as (select count(*) as n, sum((label = 1)::int) as p, sum((status = 'confirmed')::int) as c, sum((status = 'confirmed' and label = 1)::int) as ct, sum((status = 'no_match')::int) as m,
        sum((status = 'no_match' and label = 0)::int) as mt, sum((status = 'review_required')::int) as r from j)
      select n as decisions, round(case when p > 0 then ct / p else 0 end, 6) as confirmed_sensitivity, round(case when c > 0 then ct / c else 0 end, 6) as confirmed_ppv, round(case when c > 0 then (c - ct) / c else 0 end, 6) as false_link_rate,
      round(case when n > p then mt / (n - p) else 0 end, 6) as no_match_specificity, round(case when m > 0 then (m - mt) / m else 0 end, 6) as false_no_match_rate, round(case when n > 0 then r / n else 0 end, 6) as review_fraction from s""",
    "metric_stratified": _NEWEST + """, z as (select source, count(*) as n from e group by 1)
      select case when n <= 1 then '1' when n <= 5 then '2-5' when n <= 10 then '6-10' else '11+' end as band, count(*) as pairs, round(avg(label), 6) as positive_rate, round(avg(score), 6) as mean_score from sc join z on l = source group by 1""",
    "metric_clusters": "with " + _LATEST_A + """, x as (select coalesce(upper(regexp_replace(group_value, '[^A-Za-z0-9]', '', 'g')), '?') as p, coalesce(substr(date_value, 1, 4), '?') as t from la),
      cell as (select p, t, count(*) as n from x group by 1, 2), pn as (select p, sum(n) as pn, max(n) as top from cell group by 1), tn as (select t, sum(n) as tn, max(n) as top from cell group by 1),
      a as (select sum(n) as n, sum(n * n / pn) / sum(n) as bp, sum(n * n / tn) / sum(n) as br, sum(n * (n - 1) / 2) as tp from cell join pn using (p) join tn using (t)),
      b as (select sum(top) as ptop, sum(pn * (pn - 1) / 2) as pp from pn), c as (select sum(top) as ttop, sum(tn * (tn - 1) / 2) as tt from tn)
      select n::bigint as records, round(bp, 6) as bcubed_precision, round(br, 6) as bcubed_recall, round(2 * bp * br / (bp + br), 6) as bcubed_f1, round(ptop / n, 6) as purity, round(ttop / n, 6) as inverse_purity,
      tp::bigint as true_pairs, (pp - tp)::bigint as false_pairs, (tt - tp)::bigint as missed_pairs, (n * (n - 1) / 2 - pp - tt + tp)::bigint as true_negative_pairs, round(case when pp > 0 then tp / pp else 1 end, 6) as pair_precision, round(case when tt > 0 then tp / tt else 1 end, 6) as pair_recall from a, b, c""",
    "calib_apply": _NEWEST + """, q as (select *, least(greatest(score, 1e-9), 1 - 1e-9) as s from sc) select l, r, round(1 / (1 + exp(-(1.25 * ln(s / (1 - s)) - 0.3))), 6) as sigmoid,
      round(1 / (1 + exp(-(1.1 * ln(s) - 0.8 * ln(1 - s) + 0.2))), 6) as beta,
      (case when score <= 0.1 then 0.02 when score <= 0.35 then 0.2 when score <= 0.6 then 0.45 when score <= 0.85 then 0.8 else 0.97 end)::double as isotonic from q""",
    "calib_reliability_bins": _NEWEST + """ select (case when score < 0.1 then 0 when score < 0.2 then 1 when score < 0.3 then 2 when score < 0.4 then 3 when score < 0.5 then 4 when score < 0.6 then 5 when score < 0.7 then 6
      when score < 0.8 then 7 when score < 0.9 then 8 else 9 end)::integer as bin, count(*) as pairs, round(avg(score), 6) as mean_probability, round(avg(label), 6) as observed_rate from sc group by 1""",
    "calib_brier_ece": _NEWEST + """, b as (select case when score >= 0.9 then 9 else floor(score * 10) end as bin, count(*) as n, avg(score) as m, avg(label) as o from sc group by 1)
      select (select round(avg((score - label) ** 2), 6) from sc) as brier, round(sum(n * abs(m - o)) / sum(n), 6) as ece, round(max(abs(m - o)), 6) as mce from b""",
    "rank_topk": _NEWEST + " select source, target, rn::integer as candidate_rank, rn <= 3 as in_top_k from (select *, row_number() over (partition by source order by probability desc, digest) as rn from c)",
    "rank_groups": _NEWEST + " select l, r, label from sc where l in (select l from sc group by l having count(*) > 1 and min(label) < max(label))",
    "model_disagreement": _NEWEST + f""", w as (select source, target, round(max(s), 6) as score, sha256(source || chr(0) || target) as d from (select least(left_record_key, right_record_key) as source, greatest(left_record_key, right_record_key) as target, {_SCORE} as s from comparison_features)
      where source like 'source-a%' and target like 'source-b%' group by 1, 2),
      t1 as (select source, target as t1 from (select *, row_number() over (partition by source order by probability desc, digest) as rn from c) where rn = 1),
      t2 as (select source, target as t2 from (select *, row_number() over (partition by source order by score desc, d) as rn from w) where rn = 1) select source, t1, t2 from t1 join t2 using (source) where t1 <> t2""",
    "hard_negatives": _NEWEST + """, neg as (select *, round(score, 4) as h, sha256(pair_digest || ':11') as tie from sc where label = 0), hard as (select pair_digest, label from neg order by h desc, tie limit 50),
      rest as (select pair_digest, label from neg where pair_digest not in (select pair_digest from hard) order by tie limit 50)
      select pair_digest, label from sc where label = 1 union all select * from hard union all select * from rest""",
}

"""Queries of integrity checks, parity, diagnostics, reports and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import assignment as A
from kinfold.operators import calibration as K
from kinfold.operators import fellegi as FS
from kinfold.operators import metrics as M
from kinfold.operators import ranking as R
from kinfold.operators.blocking import Exact, Prefix, candidate_pairs
from kinfold.plans import scoring as S
from kinfold.plans.linkage import PREPARED, sides
from kinfold.session import Scratch, read_table

KEYS = ["left_record_key", "right_record_key"]


def ordered_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least(*KEYS).alias(KEYS[0]), F.greatest(*KEYS).alias(KEYS[1])).filter(F.col(KEYS[0]) != F.col(KEYS[1]))


def raw_edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the raw pairs taken as ranked edges: they repeat, lack probabilities, and their rule counts are no ranks."""
    f = read_table(spark, sf_dir, "comparison_features")
    return A.integrity(f.select(F.col(KEYS[0]).alias("source"), F.col(KEYS[1]).alias("target"), F.col("match_probability").alias("probability"), F.col("retrieval_rule_count").alias("rank")))


def score_integrity(spark, sf_dir):
    """Probabilities of all raw rows against the judged pairs as candidates."""
    f = read_table(spark, sf_dir, "comparison_features")
    scores = f.select(F.least(*KEYS).alias(KEYS[0]), F.greatest(*KEYS).alias(KEYS[1]), "match_probability").filter(F.col(KEYS[0]) != F.col(KEYS[1]))
    return FS.score_integrity(scores, ordered_pairs(read_table(spark, sf_dir, "verified_labels")))


def parity(spark, sf_dir):
    return FS.pair_parity(ordered_pairs(read_table(spark, sf_dir, "comparison_features")), ordered_pairs(read_table(spark, sf_dir, "verified_labels")))


def rule_model(spark, sf_dir):
    """m by retrieval rule, averaged and smoothed; weights against u over all rows."""
    f = read_table(spark, sf_dir, "comparison_features")
    ids = F.lower(F.regexp_replace(F.regexp_replace("retrieval_rule_ids", r"\s", ""), "[;|]", ","))
    u: dict = {c: [0.0] * n for c, n in S.LEVELS.items()}
    for r in FS.u_probabilities(f, S.LEVELS).collect():  # a row per level
        u[r["comparison"]][r["level"]] = r["probability"]
    m, _ = FS.fit_by_rule(f.withColumn("retrieval_rule_ids", ids), S.LEVELS, u, S.MISSING, S.PRIOR)
    w = FS.level_weights(m, u, S.MISSING)
    return spark.createDataFrame([(c, i, m[c][i], u[c][i], w[c][i]) for c in S.LEVELS for i in range(S.LEVELS[c])], "comparison string, level int, m double, u double, weight double")


def pair_hardness(spark, sf_dir):
    """How hard each raw pair is to tell apart, from its agreement, levels and gaps."""
    f = read_table(spark, sf_dir, "comparison_features")
    h = R.hardness([F.col("group_agreement_value")], [F.col("label_similarity_level"), F.col("date_difference_level"), F.col("group_agreement_level")], [F.coalesce("missing_any", F.lit(False))])
    return f.select(*KEYS, "run_no", h.alias("hardness"))


def subset(spark, sf_dir):
    """Feature rows of judged pairs only, in either order."""
    f = read_table(spark, sf_dir, "comparison_features").select(F.least(*KEYS).alias(KEYS[0]), F.greatest(*KEYS).alias(KEYS[1]), "run_no", "label_similarity_level")
    return f.join(ordered_pairs(read_table(spark, sf_dir, "verified_labels")).distinct(), KEYS, "left_semi")


def short_labels_blocked(spark, sf_dir):
    """Equal groups, or labels with the same first three letters; shorter labels block nothing."""
    a, b = (s.withColumn("v_label", F.when(F.length("v_label") >= 3, F.col("v_label"))) for s in sides(spark, sf_dir))
    return candidate_pairs(a, b, {"group": Exact("group"), "label": Prefix("label", 3)}, unique=True)


def multi_source(spark, sf_dir):
    return M.multi_source_report(S.clusters(spark, sf_dir), S.violations(spark, sf_dir))


def naive_overlaps(spark, sf_dir):
    """Entity components that a split by pair alone tears apart: what the disjointness check is for."""
    v = read_table(spark, sf_dir, "verified_labels").select(F.explode("entity_components").alias("entity"), F.substring("pair_digest", 1, 1).alias("partition"))
    return M.disjointness(v, "entity", "partition")


def plan_edges(spark, sf_dir):
    """Up to two sources a target, one target a source's best: a plan with capacities, unconstrained otherwise."""
    plan = A.AssignmentPlan("unconstrained", source_capacity=3)
    return plan.solve(S.edges(spark, sf_dir), Scratch(spark, "plan")).select("source", "target", F.round("probability", 6).alias("probability"))


QUERIES = {
    "assign_integrity": raw_edge_integrity, "assign_plan": plan_edges, "fs_score_integrity": score_integrity, "fs_pair_parity": parity, "fs_em_by_rule": rule_model, "pair_hardness": pair_hardness, "feature_subset": subset,
    "block_short_labels": short_labels_blocked, "metric_multi_source": multi_source, "metric_benchmark": lambda s, d: S._rounded(M.benchmark_metrics(S.labelled(s, d))), "split_overlaps": naive_overlaps,
    "calib_diagnostics": lambda s, d: S._rounded(K.calibration_diagnostics(Scratch(s, "diagnose").keep(S.labelled(s, d), "labelled"))),
    "rank_scoring_groups": lambda s, d: R.scoring_groups(S.scored_edges(s, d), "source").select("source", "target", "group_size"),
}

_ordered = lambda t: f"(select distinct least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r from {t} where left_record_key <> right_record_key)"
_MULTI = S.ORACLE["metric_clusters"]
ORACLE = {
    "assign_integrity": """with s as (select left_record_key as k, count(*) as n, count(distinct retrieval_rule_count) as d, min(retrieval_rule_count) as lo, max(retrieval_rule_count) as hi from comparison_features group by 1)
      select (select count(*) filter (where not coalesce(lo = 1 and hi = n and d = n, false)) from s) as incomplete_ranks, (select count(*) - count(distinct left_record_key || chr(0) || right_record_key) from comparison_features) as duplicate_edges,
      (select count(*) filter (where match_probability is null or match_probability < 0 or match_probability > 1) from comparison_features) as bad_probabilities""",
    "assign_plan": S._NEWEST + " select source, target, round(probability, 6) as probability from (select *, row_number() over (partition by source order by cost, digest) as rn from k where utility > 0) where rn <= 3",
    "fs_score_integrity": f"""with s as (select least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, match_probability as p from comparison_features where left_record_key <> right_record_key),
      n as (select l, r, count(*) as n from s group by 1, 2), c as {_ordered('verified_labels')}
      select (select count(*) from c anti join n using (l, r)) as missing_scores, (select count(*) from n anti join c using (l, r)) as foreign_scores, (select sum(n - 1)::bigint from n) as repeated_pairs,
      (select count(*) filter (where p is null or isnan(p) or p < 0 or p > 1) from s) as bad_probabilities""",
    "fs_pair_parity": f"""with a as {_ordered('comparison_features')}, b as {_ordered('verified_labels')}
      select (select count(*) from a semi join b using (l, r)) as shared, (select count(*) from a anti join b using (l, r)) as only_first, (select count(*) from b anti join a using (l, r)) as only_second""",
    "pair_hardness": """select left_record_key, right_record_key, run_no, (case when group_agreement_value >= 0.5 then 4.0 else 0.0 end + case when label_similarity_level > 0 then label_similarity_level else 0 end
      + case when date_difference_level > 0 then date_difference_level else 0 end + case when group_agreement_level > 0 then group_agreement_level else 0 end - case when missing_any then 0.5 else 0.0 end)::double as hardness from comparison_features""",
    "feature_subset": f"""with f as (select least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, run_no, label_similarity_level from comparison_features)
      select l as left_record_key, r as right_record_key, run_no, label_similarity_level from f semi join {_ordered('verified_labels')} v using (l, r)""",
    "block_short_labels": PREPARED + """, e as (select a.record_key as l, b.record_key as r, 'group' as rule from pa a join pb b on a.v_group = b.v_group
      union all select a.record_key, b.record_key, 'label' from pa a join pb b on substr(a.v_label, 1, 3) = substr(b.v_label, 1, 3) where length(a.v_label) >= 3 and length(b.v_label) >= 3)
      select l as left_record_key, r as right_record_key, string_agg(rule, ',' order by rule) as retrieval_rule_ids, count(*)::integer as retrieval_rule_count from (select distinct l, r, rule from e) group by l, r""",
    "metric_multi_source": f"""select metric, round(value::double, 6) as value from (unpivot (select columns(*)::double from ({_MULTI}) m, ({S.ORACLE['constraint_violations']}) v) on columns(*) into name metric value value)""",
    "metric_benchmark": S._NEWEST + """, rk as (select l, label, row_number() over (partition by l order by score desc, pair_digest) as rank from sc), q as (select l, min(rank) as best from rk where label = 1 group by l)
      select (select round(count(*) filter (where score >= 0.5 and label = 1) / count(*) filter (where label = 1), 6) from sc) as sensitivity, (select round(count(*) filter (where score >= 0.5 and label = 1) / count(*) filter (where score >= 0.5), 6) from sc) as ppv,
      (select round(avg((score - label) ** 2), 6) from sc) as brier, count(*) as queries, round(avg(1 / best), 6) as mean_reciprocal_rank, round(avg((best <= 1)::int), 6) as recall_at_1, round(avg((best <= 5)::int), 6) as recall_at_5,
      round(avg((best <= 10)::int), 6) as recall_at_10 from q""",
    "split_overlaps": "select entity, count(distinct p) as partitions from (select unnest(entity_components) as entity, substr(pair_digest, 1, 1) as p from verified_labels) group by 1 having count(distinct p) > 1",
    "rank_scoring_groups": S._NEWEST + " select source, target, count(*) over (partition by source) as group_size from e",
}

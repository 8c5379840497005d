"""Queries of sources and sinks, the compiled pipeline, supervised models and the advisor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.normalise import normalise_value, pair_digest, surrogate_key
from kinfold.operators import advisor as V
from kinfold.operators import models as L
from kinfold.plans.config import compile_config
from kinfold.plans.linkage import latest
from kinfold.plans.pipeline import run_plan
from kinfold.session import Scratch, read_table
from kinfold.sources.readers import read_source
from kinfold.sources.sinks import write_crosswalk
from kinfold.sources.synthetic import Scenario, generate


def _round_trip(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scratch = Scratch(spark, "scan")
        out = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment")
        path = f"{scratch.root}/{kind}"
        writer = out.write.mode("overwrite")
        if kind == "jsonl":
            writer.json(path)
        else:
            writer.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
        return read_source(spark, path, kind, ["c_custkey", "c_name", "c_mktsegment"])

    return query


def scan_parquet(spark, sf_dir):
    return read_source(spark, f"{sf_dir}/part.parquet", "parquet", ["p_partkey", "p_name"])


def crosswalk_sink(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("record_key"), F.lit("supplier").alias("dataset_id"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("global_entity_id"),
                                                     F.lit(True).alias("is_canonical"), F.lit(1).alias("cluster_size"), F.lit(1.0).alias("confidence"))
    path = f"{Scratch(spark, 'sink').root}/crosswalk"
    write_crosswalk(s, path, "csv")
    return spark.read.option("header", True).csv(path).select("record_key", "dataset_id", "global_entity_id")


#: The forms in which the sources write dates.
DATE = [{"parse_date": ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "dd-MMM-yyyy"]}]


def _config(paths: dict, mode: str = "link_only", constraint: str = "one_to_one") -> dict:
    columns = {"label": "label_value", "day": "date_value", "code": "group_value"}
    return {
        "schema_version": "0.1", "mode": mode, "constraint": constraint,
        "datasets": [{"id": n, "path": p, "format": "parquet", "identity": "record_key", "columns": columns} for n, p in paths.items()],
        "variables": {"label": {"type": "string", "transforms": ["nfkc", "casefold", "collapse_whitespace"]}, "day": {"type": "date", "transforms": DATE}, "code": {"type": "categorical", "transforms": ["strip"]}},
        "blocking": {"day": {"all": [{"kind": "exact", "variable": "day"}, {"kind": "prefix", "variable": "label", "length": 1}]},
                     "code": {"all": [{"kind": "exact", "variable": "code"}, {"any": [{"kind": "prefix", "variable": "label", "length": 3}, {"kind": "date_window", "variable": "day", "days": 3}]}]}},
        "comparisons": {"label": {"variable": "label", "function": "jaro_winkler", "levels": ["missing", "exact", {"threshold": 0.9}, {"threshold": 0.75}, "else"]},
                        "day": {"variable": "day", "function": "date_difference", "levels": ["missing", "exact", {"maximum_difference": 2}, "else"]},
                        "code": {"variable": "code", "function": "exact", "levels": ["missing", "exact", "else"]}},
        "anchors": {"all": {"predicate": {"all": [{"kind": "exact", "variable": "label"}, {"kind": "exact", "variable": "day"}]}}},
        "policy": {"confirmed": 0.97, "margin": 0.15, "review": 0.6, "no_match": 0.2}, "prior": 0.02, "pair_budget": 50_000_000,
        "partitions": {"training": 0.55, "validation": 0.15, "calibration": 0.1, "decision": 0.1, "test": 0.1},
    }


def without_non_dates(rows: DataFrame) -> DataFrame:
    """Strict preparation stops at a value that is no date in any accepted form; such values count as missing."""
    day = normalise_value(F.col("date_value"), [(k, v) for t in DATE for k, v in t.items()])
    return rows.withColumn("date_value", F.when(day.isNotNull(), F.col("date_value")))


def judged_matches(spark: SparkSession, sf_dir: str, datasets) -> DataFrame:
    """(record_key, entities, households) of the records of verified matches, under the keys of prepared tables.

    A record is given under each data set; of the two keys one names a record, the other none.
    """
    v = read_table(spark, sf_dir, "verified_labels").filter("label = 1")
    rows = v.select(F.explode(F.array("left_record_key", "right_record_key")).alias("k"), F.col("entity_components").alias("entities"), F.col("household_components").alias("households"))
    return rows.select(F.explode(F.array(*[surrogate_key(d, F.col("k")) for d in datasets])).alias("record_key"), "entities", "households")


def _run(mode: str, constraint: str = "one_to_one"):
    def query(spark, sf_dir):
        scratch = Scratch(spark, "pipeline")
        paths = {}
        for name in ("source_a", "source_b") if mode != "dedupe_only" else ("source_a",):
            rows = without_non_dates(latest(spark, sf_dir, name))
            scratch.keep(rows, name)
            paths[name] = f"{scratch.root}/{name}"
        matched = judged_matches(spark, sf_dir, paths) if mode == "link_only" else None
        return run_plan(spark, compile_config(_config(paths, mode, constraint)), matched=matched).result

    return query


def synthetic_linkage(spark, sf_dir, entities: int = 120, calibrated: bool = False):
    """Generated tables linked by the pipeline, whatever the folder holds."""
    scratch = Scratch(spark, "synthetic")
    tables, truth = generate(spark, Scenario(entities=entities, left_only=8, right_only=8, duplicates=8, competitors=20, seed=20260816))
    paths = {}
    for name, table in tables.items():
        scratch.keep(table, name)
        paths[name] = f"{scratch.root}/{name}"
    keyed = F.sha2(F.concat("dataset_id", F.lit("\x1f"), "record_key"), 256)
    known = truth.select(keyed.alias("record_key"), F.col("entity_key").alias("entity"), F.col("household_key").alias("household")) if calibrated else None
    run = run_plan(spark, compile_config(_config(paths)), truth=known)
    result = run.result
    side = lambda k, s: truth.select(keyed.alias(k), F.col("entity_key").alias(s))
    return result.join(side("source", "e1"), "source").join(side("assigned_target", "e2"), "assigned_target", "left").select("source", "assigned_target", "status", (F.col("e1") == F.col("e2")).alias("correct"))


FEATURES = ["label_similarity_value", "label_similarity_level", "date_difference_value", "date_difference_level", "group_agreement_value", "group_agreement_level", "missing_any"]


def training_rows(spark, sf_dir):
    """Judged pairs with the features of their newest run, one row per pair."""
    f = read_table(spark, sf_dir, "comparison_features")
    newest = f.groupBy(F.least("left_record_key", "right_record_key").alias("l"), F.greatest("left_record_key", "right_record_key").alias("r")).agg(F.max(F.struct("run_no", *FEATURES)).alias("x")).select("l", "r", *[F.col(f"x.{c}").alias(c) for c in FEATURES])
    v = read_table(spark, sf_dir, "verified_labels").groupBy(F.least("left_record_key", "right_record_key").alias("l"), F.greatest("left_record_key", "right_record_key").alias("r")).agg(
        F.max("label").cast("double").alias("label"), F.array_distinct(F.flatten(F.collect_list(F.concat("entity_components", F.coalesce("household_components", F.array().cast("array<string>")))))).alias("components"))
    return v.join(newest, ["l", "r"]).withColumn("pair_digest", pair_digest(F.col("l"), F.col("r"))).withColumn("source", F.col("l"))


def _model(kind: str):
    def query(spark, sf_dir):
        scratch = Scratch(spark, f"model-{kind}")
        rows = scratch.keep(L.grouped_folds(training_rows(spark, sf_dir), scratch), "rows")
        scored = L.out_of_fold(L.matrix(rows, FEATURES, ["l", "r", "label", "fold"]), kind)
        return scored.select("l", "r", "label", F.round("score", 6).alias("score"))

    return query


def grouped_folds(spark, sf_dir):
    return L.grouped_folds(training_rows(spark, sf_dir), Scratch(spark, "folds")).select("pair_digest", "fold")


def stacking(spark, sf_dir):
    scratch = Scratch(spark, "stack")
    parts = [_model(k)(spark, sf_dir).withColumnRenamed("score", k) for k in ("gbt", "logistic")]
    both = scratch.keep(parts[0].join(parts[1].drop("label"), ["l", "r"]), "both")
    return L.blend(both, ["gbt", "logistic"], L.stack(both, ["gbt", "logistic"])).select("l", "r", "label", F.round("score", 6).alias("score"))


def ranker(spark, sf_dir):
    scratch = Scratch(spark, "ranker")
    rows = scratch.keep(L.matrix(training_rows(spark, sf_dir), FEATURES, ["l", "r", "label", "pair_digest"]), "rows")
    # queries are the groups the hash of the left key forms, so that each has both labels
    weights = L.pairwise_ranker(rows.withColumn("query", F.pmod(F.xxhash64("l"), F.lit(16))), "query", scratch)
    return spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "feature int, weight double")


def mechanism(spark, sf_dir):
    a, b = (read_table(spark, sf_dir, t) for t in ("source_a", "source_b"))
    p = V.mechanism_profile(a, b, "label_value", "group_value", ["label_value", "date_value", "group_value"])
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


def families(spark, sf_dir):
    """A family per nation: shares of its customers' balances, as a stand-in for task features."""
    c = read_table(spark, sf_dir, "customer")
    per = c.groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 0).cast("double")).alias("x"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("y"), F.max("c_mktsegment").alias("kind"), F.round(F.avg("c_acctbal"), 4).alias("cost"))
    return per.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("family_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "kind", "cost")


def advisor_nearest(spark, sf_dir):
    n = V.nearest(families(spark, sf_dir), {"x": 0.9, "y": 0.2, "kind": "MACHINERY"}, {"x": 1.0, "y": 1.0}, ["kind"], 5)
    return n.select("family_id", F.round("distance", 6).alias("distance"))


def advisor_pareto(spark, sf_dir):
    return V.pareto(families(spark, sf_dir), ["cost"], ["x", "y"]).select("family_id", "cost", "x", "y")


def runs(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("family_id"), F.col("o_orderpriority").alias("recipe"), (F.col("o_orderstatus") == "F").alias("failed"),
                    V.utility(F.pmod(F.col("o_orderkey"), F.lit(101)) / 100.0, F.pmod(F.col("o_custkey"), F.lit(89)) / 100.0, F.lit(0.1), F.col("o_orderstatus") == "F").alias("utility"))


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    "scan_parquet": scan_parquet, "scan_csv": _round_trip("csv"), "scan_tsv": _round_trip("tsv"), "scan_jsonl": _round_trip("jsonl"), "sink_crosswalk": crosswalk_sink,
    "run_link_only": _run("link_only"), "run_many_to_one": _run("link_only", "many_to_one"), "run_dedupe_only": _run("dedupe_only"), "run_link_and_dedupe": _run("link_and_dedupe"), "run_synthetic": synthetic_linkage, "run_synthetic_500": lambda s, d: synthetic_linkage(s, d, 500), "run_calibrated": lambda s, d: synthetic_linkage(s, d, 120, True),
    "model_gbt": _model("gbt"), "model_forest": _model("forest"), "model_mlp": _model("mlp"), "model_stacking": stacking, "model_folds": grouped_folds, "model_ranker": ranker,
    "advisor_mechanism": mechanism, "advisor_nearest": advisor_nearest, "advisor_pareto": advisor_pareto,
    "advisor_evidence": lambda s, d: _r(V.recipe_evidence(runs(s, d))), "advisor_advice": lambda s, d: _r(V.advise(V.recipe_evidence(runs(s, d)), advisor_nearest(s, d))),
    "advisor_regret": lambda s, d: _r(V.regret(V.recipe_evidence(_r(runs(s, d))))), "registry_coverage": lambda s, d: _r(V.coverage_report(runs(s, d))), "registry_co_occurrence": lambda s, d: V.co_occurrence(runs(s, d)),
    "advisor_gaps": lambda s, d: V.coverage_gaps(families(s, d), ["x", "y"]),
}

_FAM = """with fam as materialized (select 'n' || c_nationkey as family_id, round(avg((c_acctbal > 0)::int), 6) as x, round(avg((c_mktsegment = 'BUILDING')::int), 6) as y, max(c_mktsegment) as kind, round(avg(c_acctbal), 4) as cost
  from customer group by c_nationkey), near as (select family_id, round((least(abs(x - 0.9), 1.0) + least(abs(y - 0.2), 1.0) + (kind <> 'MACHINERY')::int) / 3, 6) as distance from fam order by
  (least(abs(x - 0.9), 1.0) + least(abs(y - 0.2), 1.0) + (kind <> 'MACHINERY')::int) / 3, family_id limit 5),
runs as materialized (select 'n' || c_nationkey as family_id, o_orderpriority as recipe, o_orderstatus = 'F' as failed, least(greatest(0.4 * ((o_orderkey % 101) / 100.0::double) + 0.4 * ((o_custkey % 89) / 100.0::double) + 0.2 * 0.9::double
  - case when o_orderstatus = 'F' then 0.2 else 0.0 end, 0.0), 1.0) as utility from orders join customer on o_custkey = c_custkey),
ev as materialized (select family_id, recipe, avg(utility) as mean_utility, count(*) as runs from runs group by 1, 2)"""
_PROFILE = lambda t, s: f"""(select count(*) as n{s}, avg(regexp_matches(label_value, '[^\\x00-\\x7f]')::int) as script{s}, avg(regexp_matches(label_value, '[[:punct:]]')::int) as punctuation{s},
  avg(len(regexp_split_to_array(label_value, '[ \\t\\n\\x0b\\f\\r]+'))) as words{s}, (avg((label_value is null or regexp_matches(label_value, '^[ \\t\\n\\x0b\\f\\r]*$'))::int) + avg((date_value is null or regexp_matches(date_value, '^[ \\t\\n\\x0b\\f\\r]*$'))::int)
  + avg((group_value is null or regexp_matches(group_value, '^[ \\t\\n\\x0b\\f\\r]*$'))::int)) / 3 as missing{s} from {t}), (select max(c) / sum(c) as top{s} from (select count(*) as c from {t} group by group_value)),
  (select sum(case when c > 1 then c else 0 end) / sum(c) as repeated{s} from (select count(*) as c from {t} group by label_value))"""  # noqa: E731

_SCAN = "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer"
ORACLE = {
    "scan_parquet": "select p_partkey, p_name from part", "scan_csv": _SCAN, "scan_tsv": _SCAN, "scan_jsonl": _SCAN,
    "sink_crosswalk": "select s_suppkey::varchar as record_key, 'supplier' as dataset_id, sha256(s_nationkey::varchar) as global_entity_id from supplier",
    "advisor_mechanism": "select round((script_l + script_r) / 2, 6) as script, round((punctuation_l + punctuation_r) / 2, 6) as punctuation, round((words_l + words_r) / 2, 6) as words, round((missing_l + missing_r) / 2, 6) as missing, "
        "round(abs(missing_l - missing_r), 6) as missing_asymmetry, round((top_l + top_r) / 2, 6) as group_concentration, round((repeated_l + repeated_r) / 2, 6) as duplicate_rate, round(log10(n_l + n_r + 1), 6) as size_scale from "
        + _PROFILE("source_a", "_l") + ", " + _PROFILE("source_b", "_r"),
    "advisor_nearest": _FAM + " select * from near",
    "advisor_pareto": _FAM + " select family_id, cost, x, y from fam a where not exists (select 1 from fam b where b.cost <= a.cost and b.x >= a.x and b.y >= a.y and (b.cost < a.cost or b.x > a.x or b.y > a.y))",
    "advisor_evidence": _FAM + " select family_id, recipe, round(mean_utility, 6) as mean_utility, runs from ev",
    "advisor_advice": _FAM + " select recipe, round(avg(mean_utility), 6) as expected_utility, count(*) as families, row_number() over (order by avg(mean_utility) desc, recipe)::integer as advice_rank from ev join near using (family_id) group by recipe",
    "registry_coverage": _FAM + " select recipe, count(*) as runs, count(distinct family_id) as families, round(avg(failed::int), 6) as failure_rate from runs group by 1",
    "registry_co_occurrence": _FAM + ", o as (select distinct family_id, recipe from runs) select a.recipe as recipe_a, b.recipe as recipe_b, count(*) as families from o a join o b using (family_id) where a.recipe < b.recipe group by 1, 2",
    "advisor_gaps": _FAM + """, c as (select 'x' as axis, least(floor(x * 5), 4)::int as band from fam union all select 'y', least(floor(y * 5), 4)::int from fam)
      select axis, band, count(c2) as families from (select a.axis, b.band::int as band from (values ('x'), ('y')) a(axis), range(5) b(band)) g left join (select axis, band, 1 as c2 from c) using (axis, band) group by 1, 2""",
}

"""Queries of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import grouping, matching, mixing, packing, pii, tokens
from kinfold.session import Scratch, read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.record_groups(
        read_table(spark, sf_dir, "comparison_features"), read_table(spark, sf_dir, "verified_labels"), Scratch(spark, "groups"))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same thing with a confidence each."""
    return matching.match_sources(read_table(spark, sf_dir, "source_a"), read_table(spark, sf_dir, "source_b"), Scratch(spark, "match"), spark)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("left_record_key", "right_record_key").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = grouping.split_units(read_table(spark, sf_dir, "verified_labels"), Scratch(spark, "units"))
    return units.filter("size > 1").select("unit_digest", "pair_digest")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct pair with its partition."""
    scratch = Scratch(spark, "splits")
    units = grouping.split_units(read_table(spark, sf_dir, "verified_labels"), scratch)
    return grouping.assign_splits(units, _fractions(spark, sf_dir), scratch)


def _fractions(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    # one row per partition: the configuration does not grow with the data
    config = read_table(spark, sf_dir, "split_config").filter(F.col("method") == "entity_household_connected_components").collect()
    return {r["partition_name"]: r["fraction"] for r in config}


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and units per partition against the fractions asked for."""
    return grouping.split_shares(p4_splits(spark, sf_dir), _fractions(spark, sf_dir), spark)


def _sized(spark: SparkSession, sf_dir: str, scratch: Scratch, *keep: str) -> DataFrame:
    """Every document with its size; ``item`` tells rows apart, also those with the same id.

    Equal rows are counted and numbered, so that items do not depend on how the table is stored.
    """
    sized = tokens.measured(read_table(spark, sf_dir, "documents"), keep=keep)
    once = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("rows"))
    each = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
    return scratch.keep(each.withColumn("item", F.to_json(F.struct(*sized.columns, "copy"))).drop("copy"), "sized")


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["spec_name"]: r["capacity_tokens"] for r in read_table(spark, sf_dir, "container_specs").collect()}  # a few rows


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or every piece of one above the capacity, with its container, per capacity."""
    scratch = Scratch(spark, "containers")
    return packing.fill_containers(_sized(spark, sf_dir, scratch), _capacities(spark, sf_dir), scratch)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "containers")
    capacities = _capacities(spark, sf_dir)
    packed = scratch.keep(packing.fill_containers(_sized(spark, sf_dir, scratch), capacities, scratch), "all")
    return packing.packing_report(packed, capacities, spark)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "mix")
    plans = [tuple(r) for r in read_table(spark, sf_dir, "mix_targets").select("plan_name", "source", "target_share", "max_repeats").collect()]
    return mixing.mix_sources(_sized(spark, sf_dir, scratch, "source"), plans, scratch, spark)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text each plan uses how often."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def _names(spark: SparkSession, sf_dir: str) -> tuple[frozenset, frozenset]:
    # a fixed vocabulary of a few hundred words
    return pii.name_lists(read_table(spark, sf_dir, "name_parts").select("name_part", "part_kind").collect())


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(read_table(spark, sf_dir, "documents"), *_names(spark, sf_dir))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders in place of personal information."""
    return pii.redacted(read_table(spark, sf_dir, "documents"), *_names(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares, "p6_containers": p6_containers, "p6_report": p6_report,
    "p7_mix": p7_mix, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_redacted": p8_redacted,
}
#: Components as transitive closures, apart from the operators' method; meant for small tables.
ORACLE: dict[str, str] = {
    "p2_found": """with recursive n as (select least(left_record_key, right_record_key) as l, greatest(left_record_key, right_record_key) as r, match_probability as p,
    row_number() over (partition by least(left_record_key, right_record_key), greatest(left_record_key, right_record_key) order by run_no desc, coalesce(match_probability, -1) desc) as rn from comparison_features where left_record_key <> right_record_key),
  e as materialized (select l as a, r as b, 'e' as kind from n where rn = 1 and p >= 0.8
    union select left_record_key, right_record_key, 'e' from verified_labels where label = 1
    union select k, 'E ' || t, 'e' from (select unnest([left_record_key, right_record_key]) as k, entity_components as ts from verified_labels where label = 1), unnest(ts) as u(t)
    union select k, 'H ' || t, 'h' from (select unnest([left_record_key, right_record_key]) as k, household_components as ts from verified_labels where label = 1), unnest(ts) as u(t)),
  g as materialized (select 'entity' as g, a, b from e where kind = 'e' union all select 'household', a, b from e),
  s as materialized (select g, a, b from g union select g, b, a from g),
  reach as (select g, a, b from s union select r.g, r.a, s.b from reach r join s on s.g = r.g and s.a = r.b),
  m as (select g, a, min(b) as lo from (select g, a, b from reach union select g, a, a from s) where b not like 'E %' and b not like 'H %' group by 1, 2),
  k as (select g as group_kind, lo as group_key, a as record_key from m where a not like 'E %' and a not like 'H %')
select * from k semi join (select group_kind, group_key from k group by 1, 2 having count(*) > 1) z using (group_kind, group_key)""",
    "p4_found": """with recursive s as materialized (select distinct 'P' || pair_digest as a, t as b from (select pair_digest, unnest(list_transform(coalesce(entity_components, []), lambda x: 'E' || x) || list_transform(coalesce(household_components, []), lambda x: 'H' || x)) as t from verified_labels where pair_digest is not null) where t is not null),
  y as materialized (select a, b from s union select b, a from s),
  reach as (select a, b from y union select r.a, y.b from reach r join y on y.a = r.b),
  m as (select substr(a, 2) as pair_digest, substr(min(b), 2) as unit_digest from reach where a like 'P%' and b like 'P%' group by a)
select unit_digest, pair_digest from m semi join (select unit_digest from m group by 1 having count(*) > 1) z using (unit_digest)""",
}

"""Comparison features of candidate pairs, and deterministic anchors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.similarity import COMPARISONS, check_levels, level_index
from kinfold.operators.blocking import candidate_pairs, check_budget


@dataclass(frozen=True)
class Comparison:
    """One comparison: id, variable, function with arguments, and ordered levels."""

    id: str
    variable: str
    function: str
    levels: tuple
    arguments: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.function not in COMPARISONS:
            raise ValueError(f"unknown comparison {self.function}")
        check_levels(list(self.levels), self.function)


def comparison_features(pairs: DataFrame, left: DataFrame, right: DataFrame, comparisons: list[Comparison], check: bool = False, keep: tuple = ()) -> DataFrame:
    """Per pair and comparison: value, level, exact, missing_left/right/both/any.

    Values are bound first and levels second, so a metric is computed once.  ``check`` raises if a
    pair has no record on one side; otherwise such pairs are left out by the joins.  Pairs that
    carry the values of their records as l_ and r_ columns are not joined.  ``keep`` names further
    columns of the pairs.
    """
    names = sorted({c.variable for c in comparisons})
    if {f"{side}_{v}" for side in "lr" for v in names} <= set(pairs.columns):
        return _compared(pairs, comparisons, keep)
    l = left.select(F.col("record_key").alias("left_record_key"), *[F.col(f"v_{v}").alias(f"l_{v}") for v in names])  # noqa: E741
    r = right.select(F.col("record_key").alias("right_record_key"), *[F.col(f"v_{v}").alias(f"r_{v}") for v in names])
    if check:
        for side, key in ((l, "left_record_key"), (r, "right_record_key")):
            if not pairs.join(side, key, "left_anti").isEmpty():
                raise RuntimeError("FEATURES: a candidate pair names an unknown record")
    return _compared(pairs.join(l, "left_record_key").join(r, "right_record_key"), comparisons, keep)


def _compared(joined: DataFrame, comparisons: list[Comparison], keep: tuple = ()) -> DataFrame:
    a, b = (lambda c: F.col(f"l_{c.variable}")), (lambda c: F.col(f"r_{c.variable}"))
    valued = joined.select("*", *[COMPARISONS[c.function](a(c), b(c), **c.arguments).alias(f"{c.id}_value") for c in comparisons])
    out = [F.col("left_record_key"), F.col("right_record_key"), *[F.col(c) for c in keep]]
    for c in comparisons:
        ml, mr = a(c).isNull(), b(c).isNull()
        exact = F.when(~(ml | mr), a(c) == b(c))
        out += [F.col(f"{c.id}_value"), level_index(F.col(f"{c.id}_value"), exact, ml | mr, list(c.levels)).alias(f"{c.id}_level"), exact.alias(f"{c.id}_exact"),
                ml.alias(f"{c.id}_missing_left"), mr.alias(f"{c.id}_missing_right"), (ml & mr).alias(f"{c.id}_missing_both"), (ml | mr).alias(f"{c.id}_missing_any")]
    return valued.select(*out)


@dataclass(frozen=True)
class Anchor:
    """A deterministic rule and the sides on which its match must be unique."""

    id: str
    predicate: object
    unique_left: bool = True
    unique_right: bool = True
    #: Columns of either side by variable, where they are not called v_ and the variable.
    left_columns: dict | None = None
    right_columns: dict | None = None


ANCHOR_SCHEMA = ("left_record_key string, right_record_key string, anchor_id string, left_match_count long, right_match_count long, "
                 "left_unique boolean, right_unique boolean, uniqueness_pass boolean, evidence_role string, overrides_decision boolean")


def anchor_evidence(left: DataFrame, right: DataFrame, anchors: list[Anchor], budget: int | None = None) -> DataFrame:
    """One row per anchor and pair it matches, with match counts per side and uniqueness.

    Counts come from aggregations joined back rather than from windows: a key that matches a third
    of all rows is then a partial sum on every task instead of one task's window.  More distinct
    pairs than the budget stop the job.
    """
    if not anchors:
        return left.sparkSession.createDataFrame([], ANCHOR_SCHEMA)
    found = None
    for a in anchors:
        one = candidate_pairs(left, right, {a.id: a.predicate}, a.left_columns, a.right_columns).select(
            "left_record_key", "right_record_key", F.lit(a.id).alias("anchor_id"), F.lit(a.unique_left).alias("need_l"), F.lit(a.unique_right).alias("need_r"))
        found = one if found is None else found.unionByName(one)
    if budget is not None:
        check_budget(found.select("left_record_key", "right_record_key").distinct(), budget)
    n_left = found.groupBy("anchor_id", "left_record_key").agg(F.count(F.lit(1)).alias("left_match_count"))
    n_right = found.groupBy("anchor_id", "right_record_key").agg(F.count(F.lit(1)).alias("right_match_count"))
    both = found.join(n_left, ["anchor_id", "left_record_key"]).join(n_right, ["anchor_id", "right_record_key"])
    ul, ur = F.col("left_match_count") == 1, F.col("right_match_count") == 1
    return both.select("left_record_key", "right_record_key", "anchor_id", "left_match_count", "right_match_count", ul.alias("left_unique"), ur.alias("right_unique"),
                       ((~F.col("need_l") | ul) & (~F.col("need_r") | ur)).alias("uniqueness_pass"), F.lit("evidence_only").alias("evidence_role"), F.lit(False).alias("overrides_decision"))


def anchor_conflicts(evidence: DataFrame) -> DataFrame:
    """Sources with a failed uniqueness or more than one anchored target, and their rules."""
    return (evidence.groupBy("left_record_key")
            .agg(F.count_distinct("right_record_key").alias("targets"), F.bool_and("uniqueness_pass").alias("all_pass"),
                 F.array_join(F.array_sort(F.collect_set("anchor_id")), ",").alias("anchor_ids"))
            .filter((F.col("targets") > 1) | ~F.col("all_pass")).select("left_record_key", "anchor_ids"))


def count_window(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with the size of their group, as a window."""
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by)))

"""Candidate pairs from predicate trees, planned as equi-joins.

A rule is turned into a union of conjunctions; each conjunction joins on its equalities (whole
values or prefixes), so that no rule ends in a nested-loop join.  A conjunction with nothing but a
date window joins on day buckets as wide as the window, the right side entered in three of them.

Where record keys are known to be unique, pairs are never shuffled: each pair tells by its own two
records which rules found it, and large blocks are cut into cells that tasks share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.skew import number_rows
from kinfold.session import Scratch


@dataclass(frozen=True)
class Exact:
    variable: str


@dataclass(frozen=True)
class Prefix:
    variable: str
    length: int

    def __post_init__(self):
        if not 1 <= self.length <= 64:
            raise ValueError("prefix length must be within 1..64")


@dataclass(frozen=True)
class DateWindow:
    variable: str
    days: int

    def __post_init__(self):
        if not 1 <= self.days <= 36525:
            raise ValueError("window must be within 1..36525 days")


@dataclass(frozen=True)
class AllOf:
    parts: tuple

    def __post_init__(self):
        if not self.parts:
            raise ValueError("AllOf needs a part")


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def __post_init__(self):
        if not self.parts:
            raise ValueError("AnyOf needs a part")


def conjunctions(predicate) -> list[tuple]:
    """The predicate as alternatives, each a tuple of leaves that must all hold."""
    if isinstance(predicate, AnyOf):
        found = [c for p in predicate.parts for c in conjunctions(p)]
    elif isinstance(predicate, AllOf):
        found = [()]
        for p in predicate.parts:
            found = [a + b for a in found for b in conjunctions(p)]
    else:
        found = [(predicate,)]
    return list(dict.fromkeys(tuple(dict.fromkeys(c)) for c in found))


def _join_one(left: DataFrame, right: DataFrame, leaves: tuple, dedupe: bool, columns: tuple[dict, dict]) -> DataFrame:
    """(l, r) of one conjunction; every side brings record_key and its v_ columns."""
    on_left, on_right = columns
    name = lambda side, v: side.get(v, f"v_{v}")
    lk, rk, rest = [F.col("record_key").alias("l")], [F.col("record_key").alias("r")], []
    present_l: Column = F.col("record_key").isNotNull()
    present_r: Column = F.col("record_key").isNotNull()
    keys = []
    windows = [leaf for leaf in leaves if isinstance(leaf, DateWindow)]
    for i, leaf in enumerate(leaves):
        a, b = F.col(name(on_left, leaf.variable)), F.col(name(on_right, leaf.variable))
        present_l, present_r = present_l & a.isNotNull(), present_r & b.isNotNull()
        if isinstance(leaf, DateWindow):
            lk.append(a.alias(f"d{i}"))
            rk.append(b.alias(f"e{i}"))
            rest.append(F.abs(F.datediff(f"e{i}", f"d{i}")) <= leaf.days)
        else:
            if isinstance(leaf, Prefix):
                a, b = F.substring(a.cast("string"), 1, leaf.length), F.substring(b.cast("string"), 1, leaf.length)
            lk.append(a.alias(f"k{i}"))
            rk.append(b.alias(f"k{i}"))
            keys.append(f"k{i}")
    one, two = left.filter(present_l).select(*lk), right.filter(present_r).select(*rk)
    if not keys:
        w = windows[0]
        i = leaves.index(w)
        bucket = lambda c: F.floor(F.unix_date(c) / w.days)
        one = one.withColumn("bucket", bucket(f"d{i}"))
        two = two.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: bucket(f"e{i}") + s)))
        keys = ["bucket"]
    if dedupe:
        rest.append(F.col("l") < F.col("r"))
    joined = one.join(two, keys)
    return (joined.filter(reduce(lambda a, b: a & b, rest)) if rest else joined).select("l", "r")


#: Records of either side in a cell: larger blocks are cut.
CELL_SIDE = 4096
#: Pairs, before windows are looked at, that a task takes; a rule with no more than that is one plain join.
PAIRS_PER_TASK = 8_000_000
#: Tasks of a join at most; beyond that tasks take more pairs.
MOST_TASKS = 10_000


def unique_keys(rows: DataFrame) -> bool:
    """Whether no record key occurs twice, counted over all rows."""
    return rows.filter(F.col("record_key").isNotNull()).groupBy("record_key").count().filter("count > 1").isEmpty()


def _cells(one: DataFrame, two: DataFrame, keys: list[str], pairs: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with blocks cut into cells of about ``CELL_SIDE`` x ``CELL_SIDE`` pairs, so that no key is one task's work."""
    n, m = (side.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for side, c in ((one, "n"), (two, "m")))
    cut = n.join(m, keys).select(*keys, *[F.ceil(F.col(c) / CELL_SIDE).alias(a) for c, a in (("n", "n_l"), ("m", "n_r"))])
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys_cut = [*keys, "cell_l", "cell_r"]
    tasks = min(MOST_TASKS, max(one.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_PER_TASK)))
    one = one.join(cut, keys).withColumn("cell_l", own("l", "n_l")).withColumn("cell_r", every("n_r")).drop("n_l", "n_r")
    two = two.join(cut, keys).withColumn("cell_r", own("r", "n_r")).withColumn("cell_l", every("n_l")).drop("n_l", "n_r")
    return one.repartition(tasks, *keys_cut), two.repartition(tasks, *keys_cut), keys_cut


def block_join(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``one(l, ...)`` and ``two(r, ...)`` on few or uneven keys: blocks are counted, and large ones shared by tasks."""
    pairs = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(two.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    cut = _cells(one, two, keys, pairs) if pairs > PAIRS_PER_TASK else (one, two, keys)
    return cut[0].join(cut[1], cut[2])


def _found_by(rules: list[str], also: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Sorted ids and number of the rules that found a pair: constants chosen by case, so that no text is made pair by pair."""
    if len(also) > 4:
        every = [*[(r, F.lit(True)) for r in rules], *also]
        return F.concat_ws(",", *[F.when(c, F.lit(r)) for r, c in sorted(every, key=lambda x: x[0])]), reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for _, c in every])
    if not also:
        return F.lit(",".join(sorted(rules))), F.lit(len(rules))
    (rule, holds), rest = also[0], also[1:]
    return tuple(F.when(holds, a).otherwise(b) for a, b in zip(_found_by([*rules, rule], rest), _found_by(rules, rest), strict=True))


def _pairs_of_unique(left: DataFrame, right: DataFrame, rules: dict, dedupe: bool, columns: tuple[dict, dict], carry: tuple = ()) -> DataFrame:
    """Candidate pairs of tables without repeated record keys, with l_ and r_ columns of the variables to carry.

    A conjunction then meets a pair once.  The first one that holds for a pair gives it out and asks
    those after it whether they hold too, so neither repeats nor rules have to be gathered.
    """
    ways = [(rule, c) for rule, predicate in rules.items() for c in conjunctions(predicate)]
    numbers = {leaf: i for i, leaf in enumerate(dict.fromkeys(leaf for _, c in ways for leaf in c))}

    def value(leaf, side: int) -> Column:
        x = F.col(columns[side].get(leaf.variable, f"v_{leaf.variable}"))
        return F.substring(x.cast("string"), 1, leaf.length) if isinstance(leaf, Prefix) else x

    def holds(leaves) -> Column:
        of = lambda x: (F.col(f"a{numbers[x]}"), F.col(f"b{numbers[x]}"))
        each = [F.abs(F.datediff(*reversed(of(x)))) <= x.days if isinstance(x, DateWindow) else of(x)[0] == of(x)[1] for x in leaves]
        return F.coalesce(reduce(lambda a, b: a & b, each), F.lit(False))

    joins = []
    for at, (rule, own) in enumerate(ways):
        before = [[x for x in c if x not in own] for _, c in ways[:at]]
        if not all(before):
            continue  # a conjunction before it holds wherever this one does
        after: dict = {}
        for r, c in ways[at + 1:]:
            if r != rule:
                after.setdefault(r, []).append([x for x in c if x not in own])
        windows = [x for x in own if isinstance(x, DateWindow)]
        asked = [x for c in [*before, *[c for cs in after.values() for c in cs], windows] for x in c]
        sides = []
        for side, (rows, key, letter) in enumerate(((left, "l", "a"), (right, "r", "b"))):
            solid = reduce(lambda a, b: a & b, [value(x, side).isNotNull() for x in own], F.col("record_key").isNotNull())
            sides.append(rows.filter(solid).select(F.col("record_key").alias(key), *[value(x, side).alias(f"k{numbers[x]}") for x in own if x not in windows],
                                                   *[value(x, side).alias(f"{letter}{numbers[x]}") for x in dict.fromkeys(asked)],
                                                   *[F.col(columns[side].get(v, f"v_{v}")).alias(f"{key}_{v}") for v in carry]))
        one, two = sides
        keys = [f"k{numbers[x]}" for x in own if x not in windows]
        if windows:
            w = min(windows, key=lambda x: x.days)
            bucket = lambda c: F.floor(F.unix_date(c) / w.days)  # noqa: B023, E731
            one = one.withColumn("bucket", bucket(f"a{numbers[w]}"))
            two = two.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: bucket(f"b{numbers[w]}") + s)))  # noqa: B023
            keys.append("bucket")
        rest = [~holds(c) for c in before] + ([holds(windows)] if windows else []) + ([F.col("l") < F.col("r")] if dedupe else [])
        also = {r: F.lit(True) if not all(cs) else reduce(lambda a, b: a | b, [holds(c) for c in cs]) for r, cs in after.items()}
        joins.append((one, two, keys, rest, rule, also))

    counts = [one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(two.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
              .agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).withColumn("at", F.lit(i)) for i, (one, two, keys, *_) in enumerate(joins)]
    pairs = {r["at"]: r["pairs"] or 0 for r in reduce(DataFrame.unionByName, counts).collect()}  # a row per conjunction
    found = []
    for i, (one, two, keys, rest, rule, also) in enumerate(joins):
        if pairs[i] > PAIRS_PER_TASK:
            one, two, keys = _cells(one, two, keys, pairs[i])
        met = one.join(two, keys)
        for condition in rest:
            met = met.filter(condition)
        ids, count = _found_by([rule], [(r, c) for r, c in also.items()])
        found.append(met.select(F.col("l").alias("left_record_key"), F.col("r").alias("right_record_key"), ids.alias("retrieval_rule_ids"), count.alias("retrieval_rule_count"),
                                *[F.col(f"{side}_{v}") for side in "lr" for v in carry]))
    return reduce(DataFrame.unionByName, found)


def candidate_pairs(left: DataFrame, right: DataFrame | None, rules: dict, left_columns: dict | None = None, right_columns: dict | None = None, unique: bool = False, carry: tuple = ()) -> DataFrame:
    """(left_record_key, right_record_key, retrieval_rule_ids, retrieval_rule_count).

    Without ``right`` the left table is matched with itself, each unordered pair once and no record
    with itself.  Nulls match nothing; a pair found by several rules is one row with the sorted ids;
    pairs repeat for no reason.  With ``unique``, the caller knows that no table repeats a record
    key, and pairs need no shuffle; they then bring the values of the variables to ``carry`` with
    them, as l_ and r_ columns.  Otherwise one aggregation both removes repeats and gathers the
    rules, whose number bounds what is gathered.
    """
    if carry and not unique:
        raise ValueError("only pairs of unique records carry values")
    dedupe = right is None
    other = left if right is None else right
    columns = (left_columns or {}, left_columns or {} if right_columns is None else right_columns)
    if unique:
        return _pairs_of_unique(left, other, rules, dedupe, columns, carry)
    found = [
        _join_one(left, other, leaves, dedupe, columns).withColumn("rule", F.lit(rule))
        for rule, predicate in rules.items() for leaves in conjunctions(predicate)
    ]
    pairs = reduce(DataFrame.unionByName, found).groupBy("l", "r").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return pairs.select(F.col("l").alias("left_record_key"), F.col("r").alias("right_record_key"),
                        F.array_join("rules", ",").alias("retrieval_rule_ids"), F.size("rules").alias("retrieval_rule_count"))


class BudgetExceeded(RuntimeError):
    """More candidate pairs than the plan allows."""


def pair_bounds(left: DataFrame, right: DataFrame | None, rules: dict) -> tuple[int, int]:
    """Fewest and most pairs the rules can give, from histograms of the blocks instead of the join.

    A conjunction gives at most the sum of its blocks' products, and exactly that if it has no date
    window; with one, a block is a bucket of days and meets the buckets beside it.  The most is the
    sum over all conjunctions, the fewest the largest of the exact ones.
    """
    ways = [c for predicate in rules.values() for c in conjunctions(predicate)]
    found = []
    for at, leaves in enumerate(ways):
        windows = [x for x in leaves if isinstance(x, DateWindow)]
        keys = [F.substring(F.col(f"v_{x.variable}").cast("string"), 1, x.length) if isinstance(x, Prefix) else F.col(f"v_{x.variable}") for x in leaves if x not in windows]
        block = F.xxhash64(*keys) if keys else F.lit(0)
        solid = reduce(lambda a, b: a & b, [F.col(f"v_{x.variable}").isNotNull() for x in leaves])
        w = min(windows, key=lambda x: x.days) if windows else None
        bucket = F.floor(F.unix_date(f"v_{w.variable}") / w.days) if w else F.lit(0)
        sizes = [(left if side is None else side).filter(solid).groupBy(block.alias("b"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias(c)) for side, c in ((left, "n"), (right, "m"))]
        met = sizes[1].withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.col("bucket") + s))) if w else sizes[1]
        met = met.groupBy("b", "bucket").agg(F.sum("m").alias("m")) if w else met
        each = F.col("n") * F.col("m") if right is not None else F.col("n") * (F.col("m") - 1) / 2
        found.append(sizes[0].join(met, ["b", "bucket"]).agg(F.sum(each).alias("pairs")).withColumn("at", F.lit(at)))
    pairs = {r["at"]: int(r["pairs"] or 0) for r in reduce(DataFrame.unionByName, found).collect()}  # a row per conjunction
    return max([pairs[at] for at, c in enumerate(ways) if not any(isinstance(x, DateWindow) for x in c)], default=0), sum(pairs.values())


def check_bounds(left: DataFrame, right: DataFrame | None, rules: dict, budget: int) -> bool:
    """Whether pairs must still be counted; BudgetExceeded, before any join, if the blocks alone prove too many."""
    least, most = pair_bounds(left, right, rules)
    if least > budget:
        raise BudgetExceeded(f"at least {least} candidate pairs, more than {budget}")
    return most > budget


def check_budget(pairs: DataFrame, budget: int) -> DataFrame:
    """The pairs, or BudgetExceeded; nothing is ever cut to fit."""
    if pairs.count() > budget:
        raise BudgetExceeded(f"more than {budget} candidate pairs")
    return pairs


def candidate_diagnostics(pairs: DataFrame) -> DataFrame:
    """(candidate_count, multi_rule_count, maximum_rule_count), zeros for no pairs."""
    return pairs.agg(F.count(F.lit(1)).alias("candidate_count"),
                     F.coalesce(F.sum(F.when(F.col("retrieval_rule_count") > 1, 1).otherwise(0)), F.lit(0)).alias("multi_rule_count"),
                     F.coalesce(F.max("retrieval_rule_count"), F.lit(0)).alias("maximum_rule_count"))


def random_pairs(left: DataFrame, right: DataFrame, n: int, seed: int, scratch: Scratch) -> DataFrame:
    """``n`` different (l, r) pairs drawn from all pairs of the two tables, every pair as likely as any other.

    Records are numbered in order of their keys; a draw is a number from 0 and hashes to one number
    a side, so that the work grows with ``n`` and never with the product of the tables.  Where that
    product is at most four times ``n``, all of its cells are ordered by hash instead.  The sample's
    size is the operator's feature.
    """
    one = number_rows(left.select(F.col("record_key").alias("left_record_key")), "left_record_key", scratch, "sample-left").withColumnRenamed("n", "i")
    two = number_rows(right.select(F.col("record_key").alias("right_record_key")), "right_record_key", scratch, "sample-right").withColumnRenamed("n", "j")
    many, much = one.count(), two.count()
    text = lambda *parts: F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))
    if many * much <= 4 * n:
        cells = left.sparkSession.range(many * much).withColumns({"i": F.expr(f"id div {max(much, 1)}"), "j": F.col("id") % max(much, 1)})
        drawn = cells.orderBy(text(F.col("id").cast("string")), "id").limit(n)
    else:
        number = lambda side, size: F.conv(F.substring(text(F.col("id").cast("string"), F.lit(side)), 1, 15), 16, 10).cast("long") % size
        draws = left.sparkSession.range(2 * n + 100).withColumns({"i": number("l", many), "j": number("r", much)})
        drawn = draws.groupBy("i", "j").agg(F.min("id").alias("id")).orderBy("id").limit(n)
    return drawn.join(one, "i").join(two, "j").select("left_record_key", "right_record_key")

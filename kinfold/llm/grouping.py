"""Groups of records from pairwise matches, and splits that keep related pairs together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.components import build_vertices, groups_by_smallest, hash_to_min, vertex_id
from kinfold.session import Scratch

#: A pair counts as a match from this probability on.
MATCH_PROBABILITY = 0.8
#: Units with at least this share of all pairs are placed one by one; there are at most 500.
LARGE_UNIT_SHARE = 0.002


def predicted_links(pairs: DataFrame, threshold: float = MATCH_PROBABILITY) -> DataFrame:
    """Unordered pairs (a, b) of different records whose newest run has a probability >= threshold.

    Of rows with the same run the larger probability counts, so order never matters.  A null or
    NaN probability is no match, whatever older runs said.  Rows with a null key or run are
    ignored.
    """
    p = F.nanvl("match_probability", F.lit(None).cast("double"))
    # run and probability in one long: a primitive buffer keeps this a hash aggregation
    rank = F.shiftleft(F.col("run_no").cast("long"), 33) + F.coalesce((F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 4294967296).cast("long") + 1, F.lit(0).cast("long"))
    newest = (
        pairs.filter((F.col("left_record_key") != F.col("right_record_key")) & F.col("run_no").isNotNull())
        .select(F.least("left_record_key", "right_record_key").alias("a"), F.greatest("left_record_key", "right_record_key").alias("b"), p.alias("p"), rank.alias("rank"))
        .groupBy("a", "b").agg(F.max_by("p", "rank").alias("p"))
    )
    return newest.filter(F.col("p") >= threshold).select("a", "b")


def _tokens(column: str) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(F.col(column), F.array().cast("array<string>"))))


def record_groups(pairs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(group_kind, group_key, record_key) for kinds ``entity`` and ``household``, groups of two or more.

    Household components are found over entity components: the second run starts from the roots
    of the first instead of from the records.  Null or empty component lists link nothing beyond
    the row's own two records; repeated rows and elements change nothing.
    """
    matches = labels.filter((F.col("label") == 1) & F.col("left_record_key").isNotNull() & F.col("right_record_key").isNotNull())
    record = lambda c: F.concat(F.lit("r"), F.col(c))
    edges = (
        predicted_links(pairs).select(record("a").alias("a"), record("b").alias("b"), F.lit("e").alias("kind"))
        .unionByName(matches.select(record("left_record_key").alias("a"), record("right_record_key").alias("b"), F.lit("e").alias("kind")))
        .unionByName(matches.select(record("left_record_key").alias("a"), F.explode(_tokens("entity_components")).alias("t"))
                     .select("a", F.concat(F.lit("e"), "t").alias("b"), F.lit("e").alias("kind")))
        .unionByName(matches.select(record("left_record_key").alias("a"), F.explode(_tokens("household_components")).alias("t"))
                     .select("a", F.concat(F.lit("h"), "t").alias("b"), F.lit("h").alias("kind")))
    )
    edges = scratch.keep(edges.distinct(), "links")
    keys = edges.select(F.explode(F.array("a", "b")).alias("key"))
    vertices, seed = build_vertices(keys, scratch)
    coded = edges.select(vertex_id(F.col("a"), seed).alias("a"), vertex_id(F.col("b"), seed).alias("b"), "kind")
    entity = scratch.keep(hash_to_min(coded.filter("kind = 'e'"), scratch, "entity"), "entity-roots")
    upper = (
        coded.filter("kind = 'h'").join(entity, F.col("a") == F.col("id"), "left")
        .select(F.coalesce("root", "a").alias("a"), "b").distinct()
    )
    household = scratch.keep(hash_to_min(upper, scratch, "household"), "household-roots")

    records = vertices.filter(F.col("key").startswith("r")).select("id", F.expr("substr(key, 2)").alias("key"))
    by_entity = records.join(entity, "id", "left").select(F.coalesce("root", "id").alias("root"), "key")
    kinds = []
    for kind, roots in (("entity", None), ("household", household)):
        members = by_entity
        if roots is not None:
            members = (by_entity.join(roots.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
                       .select(F.coalesce("top", "root").alias("root"), "key"))
        groups = groups_by_smallest(members, scratch, f"{kind}-members")
        kinds.append(groups.filter("size > 1").select(F.lit(kind).alias("group_kind"), "group_key", F.col("key").alias("record_key")))
    return kinds[0].unionByName(kinds[1])


def split_units(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit_digest, pair_digest, size): distinct pairs with the smallest digest of their unit.

    Pairs naming a common entity component or a common household component share a unit, directly
    or through others.  A pair naming none is a unit of its own; rows without digest are ignored.
    """
    rows = labels.filter(F.col("pair_digest").isNotNull()).select(
        F.concat(F.lit("p"), "pair_digest").alias("a"),
        F.concat(
            F.transform(_tokens("entity_components"), lambda t: F.concat(F.lit("e"), t)),
            F.transform(_tokens("household_components"), lambda t: F.concat(F.lit("h"), t)),
        ).alias("tokens"),
    )
    edges = scratch.keep(rows.select("a", F.explode_outer("tokens").alias("b")).select("a", F.coalesce("b", "a").alias("b")).distinct(), "links")
    vertices, seed = build_vertices(edges.select(F.explode(F.array("a", "b")).alias("key")), scratch)
    roots = hash_to_min(edges.select(vertex_id(F.col("a"), seed).alias("a"), vertex_id(F.col("b"), seed).alias("b")), scratch)
    pairs = vertices.filter(F.col("key").startswith("p")).select("id", F.expr("substr(key, 2)").alias("key"))
    members = pairs.join(roots, "id").select("root", "key")
    return groups_by_smallest(members, scratch, "members").select(
        F.col("group_key").alias("unit_digest"), F.col("key").alias("pair_digest"), "size")


def rendezvous(unit: Column, weights: dict[str, float], seed: int) -> Column:
    """The partition with the lowest ``-ln(u) / weight``, ``u`` hashed from unit and partition.

    Each partition gets units in proportion to its weight, and changing one weight moves only the
    units that this partition gains or loses.
    """
    return F.array_min(_scores(unit, weights, seed)).getField("name")


def _scores(unit: Column, weights: dict[str, float], seed: int) -> Column:
    scores = []
    for name, weight in sorted(weights.items()):
        if weight > 0:
            u = (F.pmod(F.xxhash64(F.lit(seed), unit, F.lit(name)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
            scores.append(F.struct((-F.log(u) / weight).alias("score"), F.lit(name).alias("name")))
    return F.array(*scores)


def _ranking(unit: Column, weights: dict[str, float], seed: int) -> Column:
    """Partitions in the order in which a unit prefers them."""
    return F.transform(F.array_sort(_scores(unit, weights, seed)), lambda s: s.getField("name"))


def assign_splits(units: DataFrame, fractions: dict[str, float], scratch: Scratch, seed: int = 17) -> DataFrame:
    """(pair_digest, unit_digest, partition_name): whole units, fractions met over pairs.

    Every unit ranks the partitions by the same rendezvous score and takes the first.  Units of a
    LARGE_UNIT_SHARE of all pairs and more, at most 500, are placed first, largest first, and pass
    over partitions that have no room for them (the roomiest takes what fits nowhere).  For all
    other units the weights are corrected by the shares that a trial with them reaches, since units
    are of unequal size and large ones have taken their part.  So a unit that grows past the limit
    moves only if its partition lacks room or weights had to be corrected.  The same input always
    gives the same assignment.
    """
    units = scratch.keep(units, "units")
    total = units.count()
    large = (units.filter(F.col("size") >= max(2, math.ceil(total * LARGE_UNIT_SHARE)))
             .filter(F.col("unit_digest") == F.col("pair_digest")).select("unit_digest", "size", _ranking(F.col("unit_digest"), fractions, seed).alias("ranking")).collect())
    left = {name: share * total for name, share in fractions.items()}
    placed: dict[str, str] = {}
    for unit, size, ranking in sorted(large, key=lambda r: (-r[1], r[0])):
        name = next((n for n in ranking if left[n] >= size), max(sorted(left), key=left.get))
        placed[unit] = name
        left[name] -= size
    rest = {n: max(v, 0.0) for n, v in left.items()}
    if not any(rest.values()):
        rest = dict(fractions)
    small = units.filter(F.col("unit_digest") == F.col("pair_digest")).filter(~F.col("unit_digest").isin(list(placed)))
    rest = _corrected(small, rest, seed)
    chosen = rendezvous(F.col("unit_digest"), rest, seed)
    if placed:
        fixed = F.create_map(*[F.lit(x) for pair in placed.items() for x in pair])
        chosen = F.coalesce(F.try_element_at(fixed, F.col("unit_digest")), chosen)
    return units.select("pair_digest", "unit_digest", chosen.alias("partition_name"))


def _corrected(units: DataFrame, want: dict[str, float], seed: int, trials: int = 5) -> dict[str, float]:
    """Rendezvous weights whose sizes come closest to ``want`` among a few multiplicative corrections."""
    total = sum(want.values())
    weights, best = dict(want), (math.inf, want)
    for _ in range(trials):
        got = dict(units.groupBy(rendezvous(F.col("unit_digest"), weights, seed).alias("name")).agg(F.sum("size")).collect())
        gap = max(abs(got.get(n, 0) - v) for n, v in want.items())
        best = min(best, (gap, dict(weights)), key=lambda x: x[0])
        if gap <= 0.001 * total:
            break
        for n, v in want.items():
            weights[n] *= min(2.0, max(0.5, v / max(got.get(n, 0), 1)))
    return best[1]


def split_shares(assigned: DataFrame, fractions: dict[str, float], spark: SparkSession) -> DataFrame:
    """(partition_name, fraction, pairs, share, units, largest_unit, largest_share): what a split reached, a row per partition.

    Partitions without any pair are there too, with zeros.
    """
    units = assigned.groupBy("partition_name", "unit_digest").agg(F.count(F.lit(1)).alias("n"))
    got = units.groupBy("partition_name").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("units"), F.max("n").alias("largest_unit"))
    config = spark.createDataFrame(sorted(fractions.items()), "partition_name string, fraction double")
    rows = config.join(got, "partition_name", "left").na.fill(0)
    total = F.greatest(F.sum("pairs").over(Window.partitionBy()), F.lit(1))  # a row per partition
    return rows.select("partition_name", "fraction", "pairs", (F.col("pairs") / total).alias("share"), "units", "largest_unit", (F.col("largest_unit") / total).alias("largest_share"))

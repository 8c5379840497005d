"""Fellegi-Sunter model over comparison levels: estimation on distinct patterns, scoring as one expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def u_probabilities(features: DataFrame, levels: dict[str, int], smoothing: float = 1.0) -> DataFrame:
    """(comparison, level, pairs, probability) from level counts over non-null levels.

    ``levels`` maps a level column to its number of levels.  One pass and one shuffle for all
    comparisons; levels that never occur get the smoothed share of zero.
    """
    spark = features.sparkSession
    cells = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(c).cast("int").alias("level")) for c in levels])).alias("x")).select("x.*")
    seen = cells.filter("level is not null").groupBy("comparison", "level").agg(F.count(F.lit(1)).alias("pairs"))
    grid = spark.createDataFrame([(c, i, n) for c, n in levels.items() for i in range(n)], "comparison string, level int, n int")
    full = grid.join(seen, ["comparison", "level"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)).cast("long"))
    totals = full.groupBy("comparison").agg(F.sum("pairs").alias("total"))
    share = (F.col("pairs") + smoothing) / (F.col("total") + smoothing * F.col("n"))
    return full.join(F.broadcast(totals), "comparison").select("comparison", "level", "pairs", share.alias("probability"))  # a row per comparison


def patterns(features: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct level vectors with their number of pairs: at most the product of the level counts."""
    return features.groupBy(*columns).agg(F.count(F.lit(1)).alias("pairs"))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def expectation_maximisation(rows: list[tuple], levels: dict[str, int], u: dict[str, list[float]], missing: dict[str, int | None], prior: float,
                             rounds: int = 25, tolerance: float = 1e-4, smoothing: float = 1e-3) -> dict[str, list[float]]:
    """m probabilities per comparison and level; prior and u stay fixed.

    ``rows`` are (level vector, pairs), the pattern table.  The missing level keeps its u
    probability and has no weight, a null level neither.
    """
    names = list(levels)
    m = {}
    for c in names:
        raw = [0.0 if i == missing.get(c) else math.exp(-i) for i in range(levels[c])]
        left = 1.0 - (u[c][missing[c]] if missing.get(c) is not None else 0.0)
        m[c] = [u[c][i] if i == missing.get(c) else left * x / sum(raw) for i, x in enumerate(raw)]
    base = math.log(prior / (1 - prior))
    for _ in range(rounds):
        count = {c: [0.0] * levels[c] for c in names}
        for vector, pairs in rows:
            odds = base + sum(math.log(m[c][v] / u[c][v]) for c, v in zip(names, vector) if v is not None and v != missing.get(c))
            w = pairs * _logistic(odds)
            for c, v in zip(names, vector):
                if v is not None and v != missing.get(c):
                    count[c][v] += w
        change = 0.0
        for c in names:
            live = [i for i in range(levels[c]) if i != missing.get(c)]
            left = 1.0 - (m[c][missing[c]] if missing.get(c) is not None else 0.0)
            total = sum(count[c][i] + smoothing for i in live)
            for i in live:
                new = left * (count[c][i] + smoothing) / total
                change = max(change, abs(new - m[c][i]))
                m[c][i] = new
        if change <= tolerance:
            break
    return m


def level_weights(m: dict[str, list[float]], u: dict[str, list[float]], missing: dict[str, int | None]) -> dict[str, list[float]]:
    """log2(m / u) per level, 0 for the missing level."""
    return {c: [0.0 if i == missing.get(c) else math.log2(m[c][i] / u[c][i]) for i in range(len(m[c]))] for c in m}


def match_weight(weights: dict[str, list[float]], prior: float) -> Column:
    """log2 prior odds plus the weight of each comparison's level; null levels add nothing."""
    total = F.lit(math.log2(prior / (1 - prior)))
    for c, w in weights.items():
        value = F.when(F.col(c) == 0, w[0])
        for i, x in enumerate(w[1:], 1):
            value = value.when(F.col(c) == i, x)
        total = total + value.otherwise(0.0)
    return total


def match_probability(weight: Column) -> Column:
    """2^w / (1 + 2^w), in the form that does not overflow."""
    small = F.pow(F.lit(2.0), -F.abs(weight))
    return F.when(weight >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def score(features: DataFrame, weights: dict[str, list[float]], prior: float) -> DataFrame:
    """The features with match_weight and match_probability."""
    return features.withColumn("match_weight", match_weight(weights, prior)).withColumn("match_probability", match_probability(F.col("match_weight")))


PAIR = ["left_record_key", "right_record_key"]


def score_integrity(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: candidates without score, scores without candidate, repeated pairs, and probabilities that are none.

    All zero for sound scores.  Null, NaN and anything outside [0, 1] is no probability.
    """
    per = scores.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    both = candidates.select(*PAIR).distinct().withColumn("c", F.lit(1)).join(per, PAIR, "full")
    cover = both.agg(F.count(F.when(F.col("n").isNull(), 1)).alias("missing_scores"), F.count(F.when(F.col("c").isNull(), 1)).alias("foreign_scores"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_pairs"))
    p = F.col("match_probability")
    bad = scores.agg(F.count(F.when(p.isNull() | F.isnan(p) | ~p.between(0, 1), 1)).alias("bad_probabilities"))
    return cover.crossJoin(bad)  # two single rows


def pair_parity(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: pairs in both, only in the first, only in the second; both are taken as sets."""
    side = lambda df, c: df.select(*PAIR).distinct().withColumn(c, F.lit(1))
    both = side(one, "a").join(side(two, "b"), PAIR, "full")
    return both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_first"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_second"))


def fit_by_rule(features: DataFrame, levels: dict[str, int], u: dict[str, list[float]], missing: dict[str, int | None], prior: float, smoothing: float = 1e-3) -> tuple[dict, dict]:
    """(m, pairs by rule): one expectation-maximisation per retrieval rule, averaged over the rules.

    ``features`` has retrieval_rule_ids, comma-separated; a pair of several rules counts for each.
    All rules come from one aggregation, with a row per rule and pattern.  The averages are then
    smoothed: (m * pairs + s) / (pairs + s * levels) over the levels that are not missing.
    """
    rules = features.withColumn("rule", F.explode(F.array_distinct(F.split("retrieval_rule_ids", ",")))).filter("rule != ''")
    table: dict = {}
    for r in rules.groupBy("rule", *levels).agg(F.count(F.lit(1)).alias("pairs")).collect():  # rules times patterns
        table.setdefault(r["rule"], []).append((tuple(r[c] for c in levels), r["pairs"]))
    if not table:
        return {c: list(u[c]) for c in levels}, {}
    fits = [expectation_maximisation(sorted(rows, key=str), levels, u, missing, prior) for _, rows in sorted(table.items())]
    mass = sum(pairs for rows in table.values() for _, pairs in rows)
    m = {}
    for c, n in levels.items():
        mean = [sum(f[c][i] for f in fits) / len(fits) for i in range(n)]
        live = [i for i in range(n) if i != missing.get(c)]
        share = sum(mean[i] for i in live)
        m[c] = [share * (mean[i] / share * mass + smoothing) / (mass + smoothing * len(live)) if i in live else mean[i] for i in range(n)]
    return m, {rule: sum(n for _, n in rows) for rule, rows in table.items()}

"""Quality of candidates, scores, ranks, assignments, decisions and clusters, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(empty)


def retrieval(sources: DataFrame, pairs: DataFrame, truth: DataFrame, targets: int) -> DataFrame:
    """One row: pairs, recall, zero-candidate sources, reduction, and the spread of candidate set sizes.

    ``sources(left_record_key)``, ``pairs`` and ``truth`` (left_record_key, right_record_key).
    """
    key = ["left_record_key", "right_record_key"]
    pairs, truth = pairs.select(*key).distinct(), truth.select(*key).distinct()
    sizes = sources.select("left_record_key").distinct().join(pairs.groupBy("left_record_key").agg(F.count(F.lit(1)).alias("n")), "left_record_key", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    spread = sizes.agg(F.count(F.lit(1)).alias("sources"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("zero_candidate_sources"), F.avg("n").alias("mean_size"),
                       F.percentile("n", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.max("n").alias("largest_size"), F.sum("n").alias("candidate_pairs"))
    found = truth.join(pairs.withColumn("hit", F.lit(1)), key, "left").agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("true_found"))
    return spread.crossJoin(found).select(  # two single rows
        "candidate_pairs", "true_pairs", "true_found", _ratio(F.col("true_found"), F.col("true_pairs")).alias("recall"), "zero_candidate_sources", "mean_size",
        F.col("p")[0].alias("median_size"), F.col("p")[1].alias("p95_size"), F.col("p")[2].alias("p99_size"), "largest_size",
        (1 - F.col("candidate_pairs") / (F.col("sources") * targets)).alias("reduction"))


def rule_yield(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(rule, pairs, true_pairs) per retrieval rule."""
    key = ["left_record_key", "right_record_key"]
    rules = pairs.select(*key, F.explode(F.array_distinct(F.split("retrieval_rule_ids", ","))).alias("rule")).filter("rule != ''")
    return rules.join(truth.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left").groupBy("rule").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("true_pairs"))


def score_steps(scored: DataFrame) -> DataFrame:
    """(score, positives, total, cum_positives, cum_total): one row per distinct score, falling.

    Rows are combined by score before the cumulative sum.  Scores are first put into 4,096 bands by
    value, band sums are added up, and the exact running sums stay within a band, so that no task
    sorts all scores.  ``scored(score, label)`` with scores in [0, 1].
    """
    per = scored.groupBy("score").agg(F.sum("label").alias("positives"), F.count(F.lit(1)).alias("total")).withColumn("band", F.floor((1 - F.col("score")) * 4095).cast("int"))
    starts = per.groupBy("band").agg(F.sum("positives").alias("bp"), F.sum("total").alias("bt"))
    order = Window.orderBy("band")  # at most 4,096 rows
    starts = starts.select("band", (F.sum("bp").over(order) - F.col("bp")).alias("sp"), (F.sum("bt").over(order) - F.col("bt")).alias("st"))
    within = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return per.join(F.broadcast(starts), "band").select("score", "positives", "total", (F.col("sp") + F.sum("positives").over(within)).alias("cum_positives"), (F.col("st") + F.sum("total").over(within)).alias("cum_total"))


def pair_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: average precision, ROC AUC, Brier, sensitivity, PPV, false- and missed-link rates.

    Equal scores are one step of either curve.  ``scored(score, label)``.
    """
    steps = score_steps(scored)
    n = scored.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
                   F.sum(F.when((F.col("score") >= threshold) & (F.col("label") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when((F.col("score") >= threshold) & (F.col("label") == 0), 1).otherwise(0)).alias("fp"))
    area = steps.agg(F.sum(F.col("positives") * F.col("cum_positives") / F.col("cum_total")).alias("ap"),
                     F.sum((F.col("total") - F.col("positives")) * (F.col("cum_positives") - F.col("positives") / 2)).alias("auc"))
    return n.crossJoin(area).select(  # two single rows
        F.col("n").alias("pairs"), F.col("p").alias("positives"), (F.col("ap") / F.col("p")).alias("average_precision"), (F.col("auc") / (F.col("p") * (F.col("n") - F.col("p")))).alias("roc_auc"), "brier",
        _ratio(F.col("tp"), F.col("p")).alias("sensitivity"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"), _ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("false_link_rate"),
        _ratio(F.col("p") - F.col("tp"), F.col("p")).alias("missed_link_rate"))


def ranking_metrics(ranked: DataFrame, queries: DataFrame, cutoffs=(1, 5, 10)) -> DataFrame:
    """One row over eligible queries: top1, MRR, mean rank, recall at the cutoffs; a miss counts in the denominator.

    ``ranked(query, rank, label)``, ``queries(query)``.
    """
    best = ranked.filter("label = 1").groupBy("query").agg(F.min("rank").alias("best"))
    rows = queries.select("query").distinct().join(best, "query", "left")
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("best") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"),
                    F.avg("best").alias("mean_rank"), F.percentile("best", 0.5).alias("median_rank"), *[F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in cutoffs])


def assignment_metrics(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: correct, false, missed and correctly unmatched sources.

    A wrong target counts as false and as missed.  ``assigned(source, target)`` with null for no
    match, ``truth(source, target)`` with null for none.
    """
    both = assigned.select("source", F.col("target").alias("got")).join(truth.select("source", F.col("target").alias("want")), "source", "full")
    hit = F.col("got").isNotNull() & (F.col("got") == F.col("want"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return both.agg(count(hit).alias("correct_links"), count(F.col("got").isNotNull() & ~F.coalesce(hit, F.lit(False))).alias("false_links"),
                    count(F.col("want").isNotNull() & ~F.coalesce(hit, F.lit(False))).alias("missed_links"), count(F.col("got").isNull() & F.col("want").isNull()).alias("correct_no_match"), F.count(F.lit(1)).alias("sources"))


def truth_pairs(links: DataFrame) -> DataFrame:
    """(source, target) of sources with exactly one true target; others have no single truth."""
    per = links.select("source", "target").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    return per.filter("n = 1").select("source", "target")


def threshold_metrics(decisions: DataFrame) -> DataFrame:
    """One row from (status, label): confirmed sensitivity and PPV, no-match specificity, review fraction."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    confirmed, none = F.col("status") == "confirmed", F.col("status") == "no_match"
    s = decisions.agg(F.count(F.lit(1)).alias("n"), count(F.col("label") == 1).alias("p"), count(confirmed).alias("c"), count(confirmed & (F.col("label") == 1)).alias("ct"),
                      count(none).alias("m"), count(none & (F.col("label") == 0)).alias("mt"), count(F.col("status") == "review_required").alias("r"))
    return s.select(F.col("n").alias("decisions"), _ratio(F.col("ct"), F.col("p")).alias("confirmed_sensitivity"), _ratio(F.col("ct"), F.col("c")).alias("confirmed_ppv"),
                    _ratio(F.col("c") - F.col("ct"), F.col("c")).alias("false_link_rate"), _ratio(F.col("mt"), F.col("n") - F.col("p")).alias("no_match_specificity"),
                    _ratio(F.col("m") - F.col("mt"), F.col("m")).alias("false_no_match_rate"), _ratio(F.col("r"), F.col("n")).alias("review_fraction"))


def size_band(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").otherwise("11+")


def contingency(clusters: DataFrame) -> DataFrame:
    """(predicted, true, n, pn, tn) from (record_key, predicted, true): the table all cluster metrics use."""
    cell = clusters.groupBy("predicted", "true").agg(F.count(F.lit(1)).alias("n"))
    p = cell.groupBy("predicted").agg(F.sum("n").alias("pn"))
    t = cell.groupBy("true").agg(F.sum("n").alias("tn"))
    return cell.join(p, "predicted").join(t, "true")


def cluster_metrics(clusters: DataFrame) -> DataFrame:
    """One row: BCubed precision, recall, F1; purity and inverse purity; pairwise TP, FP, FN, TN, precision, recall."""
    cell = contingency(clusters)
    two = lambda c: c * (c - 1) / 2
    s = cell.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n") / F.col("pn")) / F.sum("n")).alias("bp"), (F.sum(F.col("n") * F.col("n") / F.col("tn")) / F.sum("n")).alias("br"), F.sum(two(F.col("n"))).alias("tp"))
    p = cell.groupBy("predicted").agg(F.max("n").alias("top"), F.first("pn").alias("pn")).agg(F.sum("top").alias("ptop"), F.sum(two(F.col("pn"))).alias("pp"))
    t = cell.groupBy("true").agg(F.max("n").alias("top"), F.first("tn").alias("tn")).agg(F.sum("top").alias("ttop"), F.sum(two(F.col("tn"))).alias("tt"))
    return s.crossJoin(p).crossJoin(t).select(  # three single rows
        F.col("n").alias("records"), F.col("bp").alias("bcubed_precision"), F.col("br").alias("bcubed_recall"), (2 * F.col("bp") * F.col("br") / (F.col("bp") + F.col("br"))).alias("bcubed_f1"),
        (F.col("ptop") / F.col("n")).alias("purity"), (F.col("ttop") / F.col("n")).alias("inverse_purity"), F.col("tp").cast("long").alias("true_pairs"), (F.col("pp") - F.col("tp")).cast("long").alias("false_pairs"),
        (F.col("tt") - F.col("tp")).cast("long").alias("missed_pairs"), (two(F.col("n")) - F.col("pp") - F.col("tt") + F.col("tp")).cast("long").alias("true_negative_pairs"), _ratio(F.col("tp"), F.col("pp"), 1.0).alias("pair_precision"), _ratio(F.col("tp"), F.col("tt"), 1.0).alias("pair_recall"))


def multi_source_report(clusters: DataFrame, violations: DataFrame) -> DataFrame:
    """(metric, value): all cluster metrics and the constraint violations, rounded, a row each."""
    row = cluster_metrics(clusters).crossJoin(violations)  # two single rows
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in row.columns])
    return row.select(F.inline(entries))


def benchmark_metrics(scored: DataFrame, query: str = "l", cutoffs=(1, 5, 10)) -> DataFrame:
    """One row: sensitivity, PPV and Brier at 0.5; reciprocal rank and recall at the cutoffs over queries that have a positive.

    Ranks are by falling score, then pair_digest.  A query's best positive is found by one
    aggregate, and its rank by counting the rows before it, so no group is ever sorted.
    """
    order = F.struct((-F.col("score")).alias("s"), "pair_digest")
    best = scored.filter("label = 1").groupBy(query).agg(F.min(order).alias("best"))
    ahead = scored.join(best, query).filter(order <= F.col("best")).groupBy(query).agg(F.count(F.lit(1)).alias("rank"))
    ranks = ahead.agg(F.count(F.lit(1)).alias("queries"), F.avg(1 / F.col("rank")).alias("mean_reciprocal_rank"), *[F.avg((F.col("rank") <= k).cast("int")).alias(f"recall_at_{k}") for k in cutoffs])
    hit, positive = F.col("score") >= 0.5, F.col("label") == 1
    s = scored.agg(F.count(F.when(hit & positive, 1)).alias("tp"), F.count(F.when(hit, 1)).alias("called"), F.count(F.when(positive, 1)).alias("p"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))
    return s.crossJoin(ranks).select(_ratio(F.col("tp"), F.col("p")).alias("sensitivity"), _ratio(F.col("tp"), F.col("called")).alias("ppv"), "brier", "queries", "mean_reciprocal_rank", *[f"recall_at_{k}" for k in cutoffs])


def disjointness(rows: DataFrame, unit: str, partition: str) -> DataFrame:
    """Units that lie in more than one partition; an empty result proves the split sound."""
    return rows.groupBy(unit).agg(F.count_distinct(partition).alias("partitions")).filter("partitions > 1")


def labels_within(pairs: DataFrame, parts: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidate pairs whose records share a partition, labelled by whether they share an entity.

    ``parts(record_key, partition)``, ``entities(record_key, entity)``.
    """
    side = lambda k, s: parts.join(entities, "record_key").select(F.col("record_key").alias(k), F.col("partition").alias(f"p{s}"), F.col("entity").alias(f"e{s}"))
    both = pairs.join(side("left_record_key", 1), "left_record_key").join(side("right_record_key", 2), "right_record_key").filter("p1 = p2")
    return both.select("left_record_key", "right_record_key", F.col("p1").alias("partition"), (F.col("e1") == F.col("e2")).cast("int").alias("label"))

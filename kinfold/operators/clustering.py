"""Duplicate clusters and entities over several data sets from weighted pairs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.kernels import agglomerate, cliques, pivots
from kinfold.functions.normalise import pair_digest
from kinfold.operators.components import connected_components
from kinfold.operators.skew import hot_keys, join_unique
from kinfold.session import Scratch

#: Edges one task may take for an order-dependent solver; a larger component stops the job.
COMPONENT_EDGES = 200_000
#: Edges of small components that a task takes in one batch.
EDGES_PER_TASK = 50_000


class ClusterTooLarge(RuntimeError):
    """A component exceeds the size the plan allows."""


def utility(p: Column) -> Column:
    """Log-odds of a probability, within 30 of zero."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.least(F.greatest(F.log(q / (1 - q)), F.lit(-30.0)), F.lit(30.0))


def build_graph(edges: DataFrame, nodes: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Canonical undirected edges (u, v, weight), u < v; of repeated pairs the last in ``order`` stays, without one the largest weight.

    Loops, null ends and weights outside [0, 1] stop the job, and so does an end that is not in
    ``nodes(record_key)`` where these are given.
    """
    if nodes is not None:
        known = nodes.select("record_key").distinct()
        strange = edges.select(F.explode(F.array("u", "v")).alias("record_key")).distinct().join(known, "record_key", "left_anti")
        if not strange.isEmpty():
            raise ValueError("GRAPH: an edge names an unknown record")
    sound = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")) & F.col("weight").between(0, 1)
    checked = edges.select(F.when(sound, F.col("u")).otherwise(F.raise_error(F.lit("GRAPH: an edge is not sound"))).alias("u"), "v", "weight", *([order] if order else []))
    kept = F.max_by("weight", F.struct(order, "weight")) if order else F.max("weight")
    return checked.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(kept.alias("weight")).select(F.col("a").alias("u"), F.col("b").alias("v"), "weight")


def cluster_digest(dataset: str, members: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{dataset}\x00"), F.array_join(F.array_sort(members), ",")), 256)


def eligible_edges(edges: DataFrame, threshold: float, no_match_utility: float = 0.0) -> DataFrame:
    """Edges at or above the threshold whose utility exceeds that of no match."""
    return edges.filter((F.col("weight") >= threshold) & (utility(F.col("weight")) > no_match_utility))


def dedupe_components(nodes: DataFrame, edges: DataFrame, threshold: float, scratch: Scratch, largest: int | None = None, no_match_utility: float = 0.0) -> DataFrame:
    """(record_key, canonical_key, cluster_size, edge_count, mean_probability) for every node.

    ``nodes(record_key)``, ``edges(u, v, weight)``.  A record without eligible edge is a cluster of
    its own with mean probability 1.  A cluster above ``largest`` stops the job.
    """
    good = scratch.keep(eligible_edges(edges, threshold, no_match_utility).filter("u != v"), "eligible")
    roots = scratch.keep(connected_components(good, scratch, "dedupe"), "roots")
    members = scratch.keep(nodes.select("record_key").distinct().join(roots.withColumnRenamed("node", "record_key"), "record_key", "left")
                           .select("record_key", F.coalesce("component", "record_key").alias("canonical_key")), "members")
    sizes = members.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("cluster_size"))
    if largest is not None and not sizes.filter(F.col("cluster_size") > largest).isEmpty():
        raise ClusterTooLarge(f"a cluster has more than {largest} records")
    inner = good.join(roots.withColumnRenamed("node", "u"), "u").groupBy(F.col("component").alias("canonical_key")).agg(F.count(F.lit(1)).alias("edge_count"), F.avg("weight").alias("mean"))
    facts = scratch.keep(sizes.join(inner, "canonical_key", "left").select("canonical_key", "cluster_size", F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
                                                                         F.coalesce("mean", F.lit(1.0)).alias("mean_probability")), "facts")
    hot = hot_keys(facts.select("canonical_key", F.col("cluster_size").alias("n")), "canonical_key", members.count())
    return join_unique(members, facts, "canonical_key", hot).select("record_key", "canonical_key", "cluster_size", "edge_count", "mean_probability")


def solve_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch, solver: str, threshold: float, largest: int = 1_000_000,
                     cannot_link: DataFrame | None = None, one_per_dataset: bool = False) -> DataFrame:
    """(record_key, cluster_key) by an order-dependent solver: ``clique``, ``agglomerative`` or ``correlation``.

    Such solvers only follow edges at or above the threshold, so each component of those edges is
    solved by itself in one task; with its cannot-links.  A task works through many small components.
    A component above COMPONENT_EDGES edges stops the job: nothing is cut to fit.
    ``nodes(record_key, dataset_id)``.
    """
    good = scratch.keep(edges.filter(F.col("weight") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight"), "solver-edges")
    roots = scratch.keep(connected_components(good, scratch, "solver"), "solver-roots")
    coloured = good.join(roots.withColumnRenamed("node", "u"), "u").select("component", "u", "v", "weight", F.lit(False).alias("apart"))
    if not coloured.groupBy("component").count().filter(F.col("count") > COMPONENT_EDGES).isEmpty():
        raise ClusterTooLarge(f"a component has more than {COMPONENT_EDGES} edges")
    if cannot_link is not None:
        ends = roots.withColumnRenamed("node", "u")
        other = roots.select(F.col("node").alias("v"), F.col("component").alias("c2"))
        coloured = coloured.unionByName(cannot_link.select("u", "v").join(ends, "u").join(other, "v").filter("component = c2").select("component", "u", "v", F.lit(0.0).alias("weight"), F.lit(True).alias("apart")))
    named = nodes.select(F.col("record_key").alias("u"), F.col("dataset_id").alias("du"))
    rows = (coloured.join(named, "u", "left").join(named.toDF("v", "dv"), "v", "left")
            .select("component", "u", "v", "weight", "apart", "du", "dv", pair_digest(F.col("u"), F.col("v")).alias("digest")))

    def solve_one(group: pd.DataFrame) -> dict:
        apart = {frozenset(x) for x in group.loc[group["apart"], ["u", "v"]].itertuples(index=False, name=None)}
        live = group[~group["apart"]]
        dataset = dict(zip(live["u"], live["du"])) | dict(zip(live["v"], live["dv"]))
        triples = list(live[["u", "v", "weight"]].itertuples(index=False, name=None))
        if solver == "clique":
            return cliques(list(live[["u", "v", "weight", "digest"]].itertuples(index=False, name=None)), largest)
        elif solver == "agglomerative":
            return agglomerate(triples, apart, dataset, largest, one_per_dataset)
        elif solver == "correlation":
            return pivots(triples, apart, dataset, largest, one_per_dataset, threshold)
        raise ValueError(f"unknown solver {solver}")

    def solve(bucket: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, group in bucket.groupby("component", sort=True) for x in sorted(solve_one(group).items())]
        return pd.DataFrame(found, columns=["record_key", "cluster_key"])

    buckets = max(good.sparkSession.sparkContext.defaultParallelism, math.ceil(good.count() / EDGES_PER_TASK))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).repartition(buckets, "bucket")
    solved = dealt.groupBy("bucket").applyInPandas(solve, "record_key string, cluster_key string")
    return nodes.select("record_key").distinct().join(solved, "record_key", "left").select("record_key", F.coalesce("cluster_key", "record_key").alias("cluster_key"))


#: Members up to which a cluster's digest is one expression over the gathered keys.
GATHERED_MEMBERS = 10_000


def entity_digests(members: DataFrame) -> DataFrame:
    """(cluster_key, global_entity_id): sha256 over ``key NUL data set LF`` of all members in order of their keys.

    ``members(cluster_key, record_key, dataset_id)``.  A larger cluster is never gathered: its rows
    are sorted, and one pass feeds them to the hash in constant memory.  The digest is the same
    either way.
    """
    sizes = members.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"))
    of = lambda cond: members.join(sizes.filter(cond).select("cluster_key"), "cluster_key", "left_semi")
    line = F.concat("record_key", F.lit("\x00"), F.coalesce("dataset_id", F.lit("")), F.lit("\n"))
    small = of(F.col("n") <= GATHERED_MEMBERS).groupBy("cluster_key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("global_entity_id"))

    def digest(batches):
        import hashlib

        import pyarrow as pa

        row = lambda k, h: pa.RecordBatch.from_pydict({"cluster_key": [k], "global_entity_id": [h.hexdigest()]})
        own, h = None, None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != own:
                    if h is not None:
                        yield row(own, h)
                    own, h = key, hashlib.sha256()
                h.update(text.encode())
        if h is not None:
            yield row(own, h)

    large = of(F.col("n") > GATHERED_MEMBERS).select("cluster_key", line.alias("line")).repartition("cluster_key").sortWithinPartitions("cluster_key", "line")
    return small.unionByName(large.mapInArrow(digest, "cluster_key string, global_entity_id string"))


def crosswalk(nodes: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_key, dataset_id, global_entity_id, is_canonical, cluster_size, confidence).

    The entity id is that of ``entity_digests``; confidence is the mean weight of the cluster's own
    edges, 1 for a single record and 0 for several records without an edge.
    """
    own = clusters.select("record_key", "cluster_key")
    ids = entity_digests(own.join(nodes.select("record_key", "dataset_id"), "record_key"))
    sizes = own.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("cluster_size"))
    inner = (edges.join(own.toDF("u", "cu"), "u").join(own.toDF("v", "cv"), "v").filter("cu = cv")
             .groupBy(F.col("cu").alias("cluster_key")).agg(F.avg("weight").alias("mean")))
    facts = sizes.join(inner, "cluster_key", "left").join(ids, "cluster_key")
    confidence = F.when(F.col("cluster_size") == 1, 1.0).otherwise(F.coalesce("mean", F.lit(0.0)))
    return (nodes.join(own, "record_key").join(facts, "cluster_key")
            .select("record_key", "dataset_id", "global_entity_id", (F.col("record_key") == F.col("cluster_key")).alias("is_canonical"), "cluster_size", confidence.alias("confidence")))


def cluster_entities(nodes: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_key, global_entity_id, cluster_size, datasets, edge_count, mean_weight), one row per cluster.

    ``datasets`` counts members by data set, as "name=count" in order of names; a single record has
    a mean weight of 1, several records without an edge 0.
    """
    own = clusters.select("record_key", "cluster_key")
    named = own.join(nodes.select("record_key", "dataset_id"), "record_key")
    per = named.groupBy("cluster_key", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    # as many entries as there are data sets
    spread = per.groupBy("cluster_key").agg(F.sum("n").alias("cluster_size"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "dataset_id", F.col("n").cast("string")))), ",").alias("datasets"))
    inner = (edges.join(own.toDF("u", "cu"), "u").join(own.toDF("v", "cv"), "v").filter("cu = cv")
             .groupBy(F.col("cu").alias("cluster_key")).agg(F.count(F.lit(1)).alias("edge_count"), F.avg("weight").alias("mean")))
    return spread.join(inner, "cluster_key", "left").join(entity_digests(named), "cluster_key").select(
        "cluster_key", "global_entity_id", "cluster_size", "datasets", F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.when(F.col("cluster_size") == 1, 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("mean_weight"))


def constraint_violations(clusters: DataFrame, nodes: DataFrame, cannot_link: DataFrame, must_link: DataFrame) -> DataFrame:
    """(cannot_link_violations, must_link_violations, dataset_collisions) in one row."""
    own = clusters.select("record_key", "cluster_key")
    together = lambda df: df.join(own.toDF("u", "cu"), "u").join(own.toDF("v", "cv"), "v")
    a = together(cannot_link).filter("cu = cv").agg(F.count(F.lit(1)).alias("cannot_link_violations"))
    b = together(must_link).filter("cu != cv").agg(F.count(F.lit(1)).alias("must_link_violations"))
    c = (own.join(nodes, "record_key").groupBy("cluster_key", "dataset_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
         .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("dataset_collisions")))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def size_distribution(clusters: DataFrame) -> DataFrame:
    """(cluster_size, clusters)."""
    return clusters.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("cluster_size")).groupBy("cluster_size").agg(F.count(F.lit(1)).alias("clusters"))


def link_and_dedupe(edges: DataFrame, left_clusters: DataFrame, right_clusters: DataFrame, assign) -> DataFrame:
    """(source, target, left_canonical, right_canonical, probability): links between clusters, for all their members.

    Edges (source, target, probability) go to cluster representatives with their greatest
    probability, ``assign`` decides between those, and each chosen pair is expanded to the members.
    """
    l = left_clusters.select(F.col("record_key").alias("source"), F.col("cluster_key").alias("cs"))  # noqa: E741
    r = right_clusters.select(F.col("record_key").alias("target"), F.col("cluster_key").alias("ct"))
    reps = edges.join(l, "source").join(r, "target").groupBy("cs", "ct").agg(F.max("probability").alias("probability")).select(F.col("cs").alias("source"), F.col("ct").alias("target"), "probability")
    chosen = assign(reps).select(F.col("source").alias("cs"), F.col("target").alias("ct"), "probability")
    return chosen.join(l, "cs").join(r, "ct").select("source", "target", F.col("cs").alias("left_canonical"), F.col("ct").alias("right_canonical"), "probability")

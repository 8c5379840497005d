"""Supervised pair models on Spark ML: features, learners, folds, stacking."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.calibration import clipped_logit, fit_logistic
from kinfold.operators.components import connected_components
from kinfold.session import Scratch


def matrix(features: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and a vector ``x``: numbers, flags as 0/1, each with a missing marker beside it."""
    numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(f"x_{c}") for c in columns]
    marks = [F.col(c).isNull().cast("double").alias(f"n_{c}") for c in columns]
    wide = features.select(*keep, *numbers, *marks)
    return VectorAssembler(inputCols=[c for c in wide.columns if c not in keep], outputCol="x").transform(wide).select(*keep, "x")


def learner(kind: str, seed: int, width: int = 0):
    """``gbt``, ``forest``, ``mlp`` (32-16) or ``logistic`` over (x, label)."""
    common = {"featuresCol": "x", "labelCol": "label"}
    if kind == "gbt":
        return GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed, **common)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[width, 32, 16, 2], maxIter=100, seed=seed, **common)
    if kind == "logistic":
        return LogisticRegression(regParam=1e-4, **common)
    raise ValueError(f"unknown learner {kind}")


def fit_gbt(train: DataFrame, seed: int = 7):
    """Boosted trees on (x, label) that give nothing but probabilities."""
    return learner("gbt", seed).fit(train).setPredictionCol("").setRawPredictionCol("")


def gbt_score(model, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the probability of label 1 instead of ``x``."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("x", "probability")


def fit_score(train: DataFrame, test: DataFrame, kind: str, seed: int = 7) -> DataFrame:
    """``test`` with ``score``, the probability of label 1."""
    width = train.first()["x"].size
    model = Pipeline(stages=[learner(kind, seed, width)]).fit(train)
    return model.transform(test).withColumn("score", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def grouped_folds(labelled: DataFrame, scratch: Scratch, k: int = 3) -> DataFrame:
    """Rows with ``fold``: rows sharing a source or a component are in one fold.

    ``labelled`` has pair_digest, source and components (array of strings).  Folds are filled by
    falling group size through a hash of rank, which needs no list of groups on the driver.
    """
    tokens = F.concat(F.array(F.concat(F.lit("s"), "source")), F.transform(F.coalesce("components", F.array().cast("array<string>")), lambda c: F.concat(F.lit("c"), c)))
    ends = labelled.select(F.concat(F.lit("p"), "pair_digest").alias("u"), F.explode(tokens).alias("v"))
    roots = connected_components(ends.distinct(), scratch, "folds")
    group = labelled.withColumn("u", F.concat(F.lit("p"), "pair_digest")).join(roots.withColumnRenamed("node", "u"), "u").drop("u")
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # within a size, groups go round the folds in hash order
    order = Window.partitionBy(F.least("n", F.lit(64)), F.pmod(F.xxhash64("component"), F.lit(64))).orderBy(F.xxhash64("component"))
    dealt = sizes.withColumn("fold", F.pmod(F.row_number().over(order) + F.pmod(F.xxhash64("component"), F.lit(64)), F.lit(k)).cast("int"))
    return group.join(dealt.select("component", "fold"), "component").drop("component")


def out_of_fold(rows: DataFrame, kind: str, k: int = 3, seed: int = 7) -> DataFrame:
    """Each row scored by a model that did not see its fold."""
    parts = [fit_score(rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i), kind, seed) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def stack(scored: DataFrame, columns: list[str], ridge: float = 1e-5) -> list[float]:
    """Weights (not negative) and offset of a logistic blend of base scores, on their logits."""
    weights = fit_logistic(scored, [clipped_logit(F.col(c)) for c in columns], ridge=ridge, positive=tuple(range(len(columns))))
    return [float(w) for w in np.round(weights, 15)]


def blend(scored: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    eta = reduce(lambda a, b: a + b, [w * clipped_logit(F.col(c)) for w, c in zip(weights, columns)], F.lit(weights[-1]))
    return scored.withColumn("score", 1 / (1 + F.exp(-eta)))


def linear_score(weights: list[float]) -> Column:
    """The ranking score of a row's ``x``."""
    x = vector_to_array("x")
    return reduce(lambda a, b: a + b, [w * x[i] for i, w in enumerate(weights) if w], F.lit(0.0))


def pairwise_ranker(rows: DataFrame, query: str, scratch: Scratch, per_query: int = 64) -> list[float]:
    """Linear ranking weights from differences of positives and negatives of one query.

    Each side of a query gives at most ``per_query`` rows by hash, which bounds the pairs of a
    query with very many candidates; this is the size of a training sample.
    """
    order = Window.partitionBy(query, "label").orderBy(F.xxhash64("pair_digest"))
    cut = scratch.keep(rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_query).select(query, "label", vector_to_array("x").alias("x")), "rank-rows")
    pairs = cut.filter("label = 1").select(query, F.col("x").alias("p")).join(cut.filter("label = 0").select(query, F.col("x").alias("n")), query)
    d = pairs.select(F.zip_with("p", "n", lambda a, b: a - b).alias("d"))
    width = len(cut.first()["x"])
    both = d.select(*[F.col("d")[i].alias(f"d{i}") for i in range(width)], F.lit(1).alias("label")).unionByName(d.select(*[(-F.col("d")[i]).alias(f"d{i}") for i in range(width)], F.lit(0).alias("label")))
    model = LogisticRegression(fitIntercept=False, regParam=1e-3, featuresCol="x", labelCol="label").fit(VectorAssembler(inputCols=[f"d{i}" for i in range(width)], outputCol="x").transform(both))
    return [float(w) for w in model.coefficients]

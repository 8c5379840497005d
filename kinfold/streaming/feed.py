"""The change-feed fold over a stream: each micro-batch is folded into the state kept so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.changefeed import FeedSpec, fold_changes, live_rows


def _states(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def current_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest complete state, tombstones included."""
    found = _states(spark, folder)
    return spark.read.parquet(f"{folder}/v{found[-1]}") if found else None


def current_rows(spark: SparkSession, folder: str, spec: FeedSpec) -> DataFrame | None:
    state = current_state(spark, folder)
    return None if state is None else live_rows(state, spec)


def follow_changes(changes: DataFrame, spec: FeedSpec, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps the folded state under ``folder``, one version per micro-batch.

    The fold is idempotent, so a batch that is run again after a failure changes nothing; late and
    repeated changes need no watermark.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [v for v in _states(spark, folder) if v < number]
        base = spark.read.parquet(f"{folder}/v{done[-1]}") if done else None
        fold_changes(batch, spec, base).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Shared-folder scratch tables, the engine's only way of cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``, which is fixed when the session starts.  Only a
    local session, whose executors share one machine, may leave it unset and gets a folder of its
    own; on a cluster that is an error, since a folder of one machine is lost to all others.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError(f"{CHECKPOINT_SETTING} is unset: a cluster must name a folder that all executors reach")
    return "file://" + os.path.join(tempfile.gettempdir(), f"kinfold-{os.getuid()}")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


class Scratch:
    """Tables written to the shared folder: they outlive the loss of any executor.

    ``keep`` writes a DataFrame and returns a reader of it, so later stages start from files
    rather than from a growing plan.  Tables no longer needed are dropped one by one; what is
    left goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, tag: str) -> None:
        self._delete(f"{self.root}/{tag}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:
            pass  # the session may be gone already

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

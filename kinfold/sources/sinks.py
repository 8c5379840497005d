"""Results written by the executors; small manifests by the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a decision that may leave the engine.
DECISION_FIELDS = ("source", "assigned_target", "status", "decision_rule_id", "reasons", "relationship_id", "probability", "top_probability", "margin")


def write_decisions(df: DataFrame, path: str, permitted: Sequence[str]) -> None:
    """JSON lines of the permitted fields, in the order of their names."""
    unknown = set(permitted) - set(DECISION_FIELDS)
    if unknown:
        raise ValueError(f"SINK: fields not on the list: {sorted(unknown)}")
    df.select(*sorted(permitted)).write.mode("overwrite").json(path)


def write_review_queue(df: DataFrame, path: str, permitted: Sequence[str]) -> None:
    """The queue as JSON lines, with a manifest of its size; reasons must be among the fields."""
    if "reasons" not in permitted:
        raise ValueError("SINK: a review queue needs its reasons")
    df.select(*sorted(permitted)).write.mode("overwrite").json(path)
    write_report({"rows": df.count(), "fields": sorted(permitted)}, f"{path}-manifest.json")


def write_crosswalk(df: DataFrame, path: str, kind: str) -> None:
    """record_key, dataset_id, global_entity_id, is_canonical, cluster_size, confidence as csv or json."""
    rows = df.select("record_key", "dataset_id", "global_entity_id", "is_canonical", "cluster_size", "confidence").sort("dataset_id", "record_key")
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError("SINK: a crosswalk is csv or json")


def write_clusters(df: DataFrame, path: str) -> None:
    """Rows (cluster_key, record_key) in that order."""
    df.select("cluster_key", "record_key").sort("cluster_key", "record_key").write.mode("overwrite").json(path)


def write_report(report: dict, path: str) -> None:
    """A small JSON file on whichever file system ``path`` names, complete or not there at all."""
    spark = SparkSession.getActiveSession()
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, part = hadoop.Path(path), hadoop.Path(path + ".part")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(report, sort_keys=True, indent=1, default=str).encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"SINK: {path} could not be put in place")


def read_report(path: str) -> dict:
    return json.loads("\n".join(r[0] for r in SparkSession.getActiveSession().read.text(path, wholetext=True).collect()))  # one small file


def _exists(path: str) -> bool:
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def digest(record: dict) -> str:
    """sha256 of a record in canonical JSON."""
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def write_links(df: DataFrame, path: str) -> None:
    """Resolved pairs of a link-and-dedupe run, in order, with a manifest of their number and columns."""
    columns = ["source", "target", "left_canonical", "right_canonical", "probability"]
    df.select(*columns).sort("source", "target").write.mode("overwrite").json(path)
    write_report({"schema_version": "1", "kind": "link_and_dedupe", "rows": df.count(), "fields": columns}, f"{path}-manifest.json")


def write_run_manifest(path: str, run_id: str, plan_digest: str, mode: str, tables: dict[str, DataFrame]) -> dict:
    """What a run made of what: rows and columns of each table, under a digest of the whole."""
    body = {"schema_version": "1", "run_id": run_id, "plan_digest": plan_digest, "mode": mode,
            "tables": {name: {"rows": df.count(), "columns": df.columns} for name, df in sorted(tables.items())}}
    manifest = {**body, "manifest_digest": digest(body)}
    write_report(manifest, path)
    return manifest


KINDS = ("family", "instance", "run", "metrics", "failure", "snapshot")


def register(root: str, kind: str, key: str, record: dict) -> str:
    """Enter a record into a registry of JSON files; the same again changes nothing, another under its key is refused."""
    if kind not in KINDS:
        raise ValueError(f"REGISTRY: unknown kind {kind}")
    if not key or any(c in key for c in "/\\.") or key.startswith("_"):
        raise ValueError("REGISTRY: a key is a plain name")
    path = f"{root}/{kind}/{key}.json"
    own = digest(record)
    if _exists(path):
        if read_report(path)["digest"] != own:
            raise ValueError(f"REGISTRY: {kind} {key} is there with another content")
        return own
    write_report({"key": key, "digest": own, "record": record}, path)
    return own


def registered(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(key, digest, record as JSON) of all records of a kind."""
    rows = spark.read.text(f"{root}/{kind}", wholetext=True, pathGlobFilter="*.json")
    return rows.select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.digest").alias("digest"), F.get_json_object("value", "$.record").alias("record"))


def save_artifact(path: str, family: str, feature_schema: str, payload: dict) -> dict:
    """A fitted model's parameters with the digests that ``load_artifact`` checks."""
    body = {"schema_version": "1", "family": family, "feature_schema_digest": feature_schema, "payload": payload}
    artifact = {**body, "artifact_digest": digest(body)}
    write_report(artifact, path)
    return artifact


def load_artifact(path: str, family: str, feature_schema: str) -> dict:
    """The parameters, if the file is whole, of that family, and made for these features."""
    artifact = read_report(path)
    body = {k: v for k, v in artifact.items() if k != "artifact_digest"}
    if artifact.get("artifact_digest") != digest(body):
        raise ValueError("ARTIFACT: the content does not match its digest")
    if artifact["family"] != family or artifact["feature_schema_digest"] != feature_schema:
        raise ValueError("ARTIFACT: made for another model family or other features")
    return artifact["payload"]


def migrate_manifest(manifest: dict) -> dict:
    """A run manifest of schema 0.1 as schema 1; one of schema 1 as it is."""
    if manifest.get("schema_version") == "1":
        return manifest
    if manifest.get("schema_version") != "0.1":
        raise ValueError("SINK: unknown manifest schema")
    return {**{k: v for k, v in manifest.items() if k != "schema_version"}, "schema_version": "1", "migrated_from": "0.1"}

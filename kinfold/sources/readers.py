"""Scans of the four file formats, inline rows, and reviews under their many header names."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "tsv", "jsonl")


class SourceError(ValueError):
    """A source that the policy or its own content forbids to read."""


def check_path(path: str, roots: Sequence[str]) -> str:
    """The path, if it lies under an allowed root by no symbolic link, remote scheme or home shortcut."""
    if "://" in path and not path.startswith("file:///"):
        raise SourceError("SOURCE: remote paths are not allowed")
    local = path.removeprefix("file://")
    if local.startswith(("~", "\\\\", "//")):
        raise SourceError("SOURCE: home and network paths are not allowed")
    full = Path(os.path.abspath(local))
    if not any(full.is_relative_to(os.path.abspath(r)) for r in roots):
        raise SourceError("SOURCE: path is outside the allowed roots")
    if any(p.is_symlink() for p in [full, *full.parents] if any(p.is_relative_to(os.path.abspath(r)) for r in roots)):
        raise SourceError("SOURCE: symbolic links are not allowed")
    return path


def read_source(spark: SparkSession, path: str, kind: str, columns: Sequence[str] | None = None, roots: Sequence[str] | None = None) -> DataFrame:
    """A table of the named format; only ``columns`` are read where the format allows it.

    Text formats give strings only: types are the business of normalisation.
    """
    if roots is not None:
        check_path(path, roots)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").option("multiLine", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        df = spark.read.json(path)
    elif kind == "duckdb":
        raise SourceError("SOURCE: attaching a database is declared but not supported")
    else:
        raise SourceError(f"SOURCE: unknown format {kind}")
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def inline_rows(spark: SparkSession, rows: Sequence[Sequence], schema: Sequence[tuple[str, str]]) -> DataFrame:
    """A table of given rows; (name, type) pairs must have distinct names and fit every row."""
    names = [n for n, _ in schema]
    if len(set(names)) != len(names):
        raise SourceError("SOURCE: column names repeat")
    if any(len(r) != len(names) for r in rows):
        raise SourceError("SOURCE: a row has the wrong width")
    allowed = {"string", "date", "bigint", "double", "boolean", "int"}
    if any(t not in allowed for _, t in schema):
        raise SourceError("SOURCE: type not allowed")
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` {t}" for n, t in schema))


#: Header names under which reviews arrive; the first that is filled counts.
REVIEW_HEADERS = {
    "event_id": ("event_id", "adjudication_event_id", "id"),
    "left_record_key": ("left_record_key", "source_record_ref", "left_id", "source_ref", "source_key"),
    "right_record_key": ("right_record_key", "target_record_ref", "right_id", "target_ref", "target_key"),
    "decision": ("decision", "outcome", "status"),
    "confidence": ("confidence",),
    "reviewer_id": ("reviewer_id", "reviewer", "annotator_id"),
    "adjudicated_at": ("timestamp", "created_at", "adjudicated_at"),
    "protocol_version": ("protocol_version", "verification_protocol", "protocol", "version"),
    "superseded_event_id": ("superseded_event_id", "supersedes_event_id", "supersedes_label_id"),
    "source_digest": ("source_digest", "source_artifact_digest"),
    "notes": ("notes", "comment", "annotation_notes"),
}
#: Lists, as arrays or as text with ``;`` or ``,`` between their elements.
REVIEW_LISTS = {
    "entity_component_digests": ("entity_component_digests", "entity_components"),
    "household_component_digests": ("household_component_digests", "household_components"),
}
REQUIRED = ("event_id", "left_record_key", "right_record_key", "decision", "confidence", "reviewer_id", "adjudicated_at", "protocol_version")
DECISIONS = ("match", "nonmatch", "uncertain", "insufficient_information", "duplicate_review")


def import_reviews(df: DataFrame) -> DataFrame:
    """Reviews under their canonical names, without blanks around them.

    A row without one of REQUIRED, with another decision than DECISIONS, or a number or time that is
    none stops the job, and so do repeated event ids.
    """
    have = {c.lower(): c for c in df.columns}
    types = dict(df.dtypes)
    picked = []
    for name, aliases in REVIEW_HEADERS.items():
        found = [F.nullif(F.trim(F.col(f"`{have[a]}`").cast("string")), F.lit("")) for a in aliases if a in have]
        picked.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    for name, aliases in REVIEW_LISTS.items():
        found = []
        for a in (x for x in aliases if x in have):
            c = F.col(f"`{have[a]}`")
            if not types[have[a]].startswith("array"):
                c = F.split(c.cast("string"), F.when(F.instr(c, ";") > 0, ";").otherwise(","))
            found.append(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
        picked.append((F.coalesce(*found) if found else F.array().cast("array<string>")).alias(name))
    out = df.select(*picked).withColumn("confidence", F.col("confidence").try_cast("double")).withColumn("adjudicated_at", F.col("adjudicated_at").try_cast("timestamp"))
    gaps = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED] + [F.when(~F.col("decision").isin(*DECISIONS), F.lit("decision"))]
    bad = out.select(F.array_join(F.array_distinct(F.array_compact(F.array(*gaps))), ", ").alias("bad")).filter("bad != ''").first()
    if bad is not None:
        raise SourceError(f"SOURCE: a review lacks a valid {bad['bad']}")
    if not out.groupBy("event_id").count().filter("count > 1").isEmpty():
        raise SourceError("SOURCE: event ids repeat")
    return out


def schema_digest(df: DataFrame) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields]).encode()).hexdigest()

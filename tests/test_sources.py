"""Readers, sinks, configurations, the pipeline on generated tables, and the stream."""

import json

import pytest

from kinfold.functions.normalise import prepare
from kinfold.operators.changefeed import FeedSpec
from kinfold.plans.config import ConfigError, compile_config, parse_config
from kinfold.plans.extras import _config, without_non_dates
from kinfold.plans.pipeline import run_plan
from kinfold.session import Scratch, shared_folder
from kinfold.sources import readers as R
from kinfold.sources import sinks as W
from kinfold.sources.synthetic import Scenario, generate
from kinfold.streaming.feed import current_rows, follow_changes


def test_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a b,c\n1,"x,y"\n,z\n')
    (tmp_path / "t.jsonl").write_text('{"a b": 1, "c": "x"}\n')
    assert [tuple(r) for r in R.read_source(spark, str(tmp_path / "t.csv"), "csv", ["c", "a b"]).collect()] == [("x,y", "1"), ("z", None)]
    assert R.read_source(spark, str(tmp_path / "t.jsonl"), "jsonl").first()["c"] == "x"
    for bad in ("duckdb", "xml"):
        with pytest.raises(R.SourceError):
            R.read_source(spark, "x", bad)


def test_paths(tmp_path):
    R.check_path(str(tmp_path / "a.csv"), [str(tmp_path)])
    (tmp_path / "link").symlink_to("/etc")
    for bad in ("s3://x/y", "~/x", "/etc/passwd", str(tmp_path / ".." / "x"), str(tmp_path / "link" / "x")):
        with pytest.raises(R.SourceError):
            R.check_path(bad, [str(tmp_path)])


def test_inline_and_reviews(spark):
    with pytest.raises(R.SourceError):
        R.inline_rows(spark, [(1, 2)], [("a", "int")])
    df = spark.createDataFrame([(" 1 ", "a", "b", "match", "0.9", "r7", "2024-01-02T03:04:05Z", "p1", "e1; e2", ["h"])],
                               "id string, left_id string, target_key string, outcome string, confidence string, annotator_id string, created_at string, protocol string, entity_components string, household_components array<string>")
    r = R.import_reviews(df).first()
    assert (r["event_id"], r["left_record_key"], r["right_record_key"], r["decision"], r["confidence"], r["reviewer_id"], r["protocol_version"]) == ("1", "a", "b", "match", .9, "r7", "p1")
    assert r["entity_component_digests"] == ["e1", "e2"] and r["household_component_digests"] == ["h"] and r["superseded_event_id"] is None
    from pyspark.sql import functions as F
    for bad in (df.unionByName(df), df.drop("annotator_id"), df.withColumn("outcome", F.lit("maybe")), df.withColumn("confidence", F.lit("high"))):
        with pytest.raises(R.SourceError):
            R.import_reviews(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "secret", "r")], "source string, private string, reasons string")
    with pytest.raises(ValueError):
        W.write_decisions(df, str(tmp_path / "d"), ["source", "private"])
    W.write_review_queue(df, str(tmp_path / "q"), ["source", "reasons"])
    assert json.loads((tmp_path / "q-manifest.json").read_text())["rows"] == 1
    W.write_links(spark.createDataFrame([("s", "t", "s", "t", .9)], "source string, target string, left_canonical string, right_canonical string, probability double"), str(tmp_path / "links"))
    assert W.read_report(str(tmp_path / "links-manifest.json"))["rows"] == 1
    m = W.write_run_manifest(str(tmp_path / "run.json"), "r1", "d1", "link_only", {"queue": df})
    assert W.read_report(str(tmp_path / "run.json")) == m and m["tables"]["queue"]["rows"] == 1
    root = str(tmp_path / "registry")
    assert W.register(root, "run", "a", {"x": 1}) == W.register(root, "run", "a", {"x": 1})
    with pytest.raises(ValueError, match="another content"):
        W.register(root, "run", "a", {"x": 2})
    assert [tuple(r) for r in W.registered(spark, root, "run").select("key", "record").collect()] == [("a", '{"x":1}')]
    W.save_artifact(str(tmp_path / "m.json"), "fs", "f1", {"m": [.1]})
    assert W.load_artifact(str(tmp_path / "m.json"), "fs", "f1") == {"m": [.1]}
    with pytest.raises(ValueError, match="other features"):
        W.load_artifact(str(tmp_path / "m.json"), "fs", "f2")
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace("0.1", "0.2"))
    (tmp_path / ".m.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="digest"):
        W.load_artifact(str(tmp_path / "m.json"), "fs", "f1")
    assert W.migrate_manifest({"schema_version": "0.1", "a": 1}) == {"a": 1, "schema_version": "1", "migrated_from": "0.1"}


def test_configurations():
    good = _config({"a": "/x", "b": "/y"})
    assert compile_config(good).digest == compile_config(json.loads(json.dumps(good))).digest
    for change in ({"mode": "other"}, {"extra": 1}, {"schema_version": "9"}, {"partitions": {"a": .5}}, {"blocking": {"r": {"kind": "exact", "variable": "nope"}}}, {"datasets": good["datasets"][:1]}):
        with pytest.raises(ConfigError):
            compile_config({**good, **change})
    with pytest.raises(ConfigError):
        parse_config("a: 1\na: 2\n")
    with pytest.raises(ConfigError):
        parse_config("- 1\n")


def test_pipeline_on_generated_tables(spark):
    scratch = Scratch(spark, "t")
    tables, truth = generate(spark, Scenario(entities=60, duplicates=4, competitors=6, seed=3))
    assert tables["a"].collect() == generate(spark, Scenario(entities=60, duplicates=4, competitors=6, seed=3))[0]["a"].collect()
    paths = {}
    for n, t in tables.items():
        scratch.keep(t, n)
        paths[n] = f"{scratch.root}/{n}"
    run = run_plan(spark, compile_config(_config(paths)))
    got = run.result.collect()
    assert len(got) == tables["a"].count() and sum(r["status"] == "confirmed" for r in got) >= 15
    assert truth.count() == 60 * 2 + 4 + 6


def test_stream_keeps_the_folded_state(spark, tmp_path):
    spec = FeedSpec(["k"], ["seq"], "op", ["v"])
    schema = "seq long, op string, k string, v string"
    source = str(tmp_path / "in")
    for rows in ([(2, "u", "a", "y"), (1, "i", "a", "x"), (3, "i", "b", "z")], [(4, "d", "b", None), (3, "i", "b", "z"), (5, "u", "a", "w")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        follow_changes(spark.readStream.schema(schema).parquet(source), spec, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    assert [tuple(r) for r in current_rows(spark, str(tmp_path / "state"), spec).collect()] == [("a", "w")]


class Settings:
    def __init__(self, named, master="local[4]"):
        self.conf = self.sparkContext = self
        self.named, self.master = named, master

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" and self.named else default


def test_shared_folder_is_taken_from_the_session():
    assert shared_folder(Settings("hdfs://cluster/shared/")) == "hdfs://cluster/shared"
    assert shared_folder(Settings(None)).startswith("file://")
    assert shared_folder(Settings("hdfs://cluster/shared", "yarn")) == "hdfs://cluster/shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,4,6144]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="unset"):
            shared_folder(Settings(None, master))


def test_core_stands_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    code = "import sys; sys.modules['kinfold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_dates_of_every_form_reach_the_run(spark):
    values = ["1982-06-20", "20/06/1982", "19820620", "20-Jun-1982", "30/02/1982", "soon", " ", None]
    rows = without_non_dates(spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "record_key string, date_value string"))
    assert [r["date_value"] for r in rows.orderBy("record_key").collect()] == [*values[:4], None, None, None, None]
    day = compile_config(_config({"a": "/x", "b": "/y"})).variables["day"]
    out = prepare(rows, "a", "record_key", {"day": ("date_value", day)}, strict=True)
    assert out.filter("v_day = date'1982-06-20'").count() == 4 and out.filter("m_day").count() == 4


def test_link_only_learns_from_judged_matches(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from kinfold.functions.normalise import surrogate_key
    from kinfold.plans import extras
    from kinfold.plans.pipeline import judged_candidates

    record = "record_key string, label_value string, date_value string, group_value string, load_id int, updated_at timestamp"
    for name, rows in (("source_a", [(f"a{i}", f"name {i}", "2000-01-01", "g", 1, None) for i in range(6)]), ("source_b", [(f"b{i}", f"name {i}", "2000-01-01", "g", 1, None) for i in range(6)])):
        spark.createDataFrame(rows, record).write.parquet(f"{tmp_path}/{name}.parquet")
    judged = [("a0", "b0", 1, ["e0"], ["h"]), ("b1", "a1", 1, ["e1"], ["h"]), ("a1", "b2", 1, ["e1"], None), ("a3", "b3", 1, ["e3"], None), ("a4", "b4", 0, ["e4", "e5"], None)]
    spark.createDataFrame(judged, "left_record_key string, right_record_key string, label int, entity_components array<string>, household_components array<string>").write.parquet(f"{tmp_path}/verified_labels.parquet")
    seen = {}
    monkeypatch.setattr(extras, "run_plan", lambda spark, plan, matched=None: seen.update(plan=plan, matched=matched) or type("Run", (), {"result": None}))
    extras.QUERIES["run_link_only"](spark, str(tmp_path))
    tables = [prepare(spark.read.parquet(d.path), d.id, d.identity, {v: (c, seen["plan"].variables[v]) for v, c in d.columns}) for d in seen["plan"].datasets]
    names = {k: n for d, t in (("source_a", "a"), ("source_b", "b")) for n, k in spark.createDataFrame([(f"{t}{i}",) for i in range(6)], "n string").select("n", surrogate_key(d, F.col("n"))).collect()}
    rows = judged_candidates(seen["matched"], *tables, seen["plan"], Scratch(spark, "t")).collect()
    found = {(names[r["left_record_key"]], names[r["right_record_key"]]): (r["partition"], r["label"]) for r in rows}
    assert {k: v[1] for k, v in found.items() if {*k} <= {"a0", "a1", "b0", "b1", "b2"}} == {("a0", "b0"): 1.0, ("a0", "b1"): 0.0, ("a0", "b2"): 0.0, ("a1", "b0"): 0.0, ("a1", "b1"): 1.0, ("a1", "b2"): 1.0}
    assert found["a3", "b3"][1] == 1.0 and len({v[0] for k, v in found.items() if {*k} <= {"a0", "a1", "b0", "b1", "b2"}}) == 1
    assert not any("a4" in k or "b4" in k for k in found) and "label_value" in rows[0].asDict()

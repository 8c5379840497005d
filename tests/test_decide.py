"""Assignments, clusters, decisions, reviews and metrics on worked examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.kernels import hungarian, sparse_assignment
from kinfold.operators import adjudication as J
from kinfold.operators import assignment as A
from kinfold.operators import calibration as K
from kinfold.operators import clustering as C
from kinfold.operators import decisions as D
from kinfold.operators import metrics as M
from kinfold.operators.components import connected_components
from kinfold.operators import splitting
from kinfold.operators.splitting import advance, entity_household_split
from kinfold.plans import scoring
from kinfold.session import Scratch

EDGE = "source string, target string, probability double"
GRAPH = "u string, v string, weight double"


def pairs(df):
    return {(r["source"], r["target"]) for r in df.collect()}


def test_assignments(spark):
    e = A.edge_costs(spark.createDataFrame([("s1", "t1", .95), ("s1", "t2", .80), ("s2", "t1", .94), ("s2", "t2", .10), ("s4", "t3", .20)], EDGE))
    one = A.one_to_one(e, Scratch(spark, "t"))
    assert pairs(one) == {("s1", "t2"), ("s2", "t1")}
    sources = spark.createDataFrame([(f"s{i}",) for i in range(1, 5)], "source string")
    out = {r["source"]: (r["target"], r["changed_from_top1"]) for r in A.assemble(sources, one, e).collect()}
    assert out == {"s1": ("t2", True), "s2": ("t1", False), "s3": (None, False), "s4": (None, False)}
    m = A.edge_costs(spark.createDataFrame([("s1", "t1", .95), ("s1", "t2", .70), ("s2", "t1", .92), ("s2", "t2", .60), ("s4", "t3", .20)], EDGE))
    assert pairs(A.many_to_one(m)) == {("s1", "t1"), ("s2", "t1")}
    assert pairs(A.many_to_one(m, Scratch(spark, "t"), target_capacity=1)) == {("s1", "t1"), ("s2", "t2")} or pairs(A.many_to_one(m, Scratch(spark, "t"), target_capacity=1)) == {("s1", "t2"), ("s2", "t1")}
    o = A.edge_costs(spark.createDataFrame([("s1", "t1", .95), ("s1", "t2", .90), ("s2", "t3", .85), ("s3", "t1", .60)], EDGE))
    assert pairs(A.one_to_many(o)) == {("s1", "t1"), ("s1", "t2"), ("s2", "t3")}


def test_clusters(spark):
    nodes = spark.createDataFrame([(f"r{i}", "d") for i in range(1, 6)], "record_key string, dataset_id string")
    edges = spark.createDataFrame([("r1", "r2", .95), ("r2", "r3", .90), ("r4", "r5", .30)], GRAPH)
    got = {r["record_key"]: (r["canonical_key"], r["cluster_size"], r["edge_count"]) for r in C.dedupe_components(nodes, edges, .5, Scratch(spark, "t")).collect()}
    assert got == {"r1": ("r1", 3, 2), "r2": ("r1", 3, 2), "r3": ("r1", 3, 2), "r4": ("r4", 1, 0), "r5": ("r5", 1, 0)}
    with pytest.raises(C.ClusterTooLarge):
        C.dedupe_components(nodes, edges, .5, Scratch(spark, "t"), largest=2)
    solve = lambda e, name, **kw: {r["record_key"]: r["cluster_key"] for r in C.solve_components(nodes, e, Scratch(spark, "t"), name, .5, **kw).collect()}
    assert sorted(map(len, _sets(solve(edges, "clique")))) == [1, 1, 1, 2]
    full = edges.unionByName(spark.createDataFrame([("r1", "r3", .90)], GRAPH))
    assert sorted(map(len, _sets(solve(full, "clique")))) == [1, 1, 3]
    abc = spark.createDataFrame([("r1", "r2", .95), ("r2", "r3", .90), ("r1", "r3", .85)], GRAPH)
    apart = spark.createDataFrame([("r1", "r3")], "u string, v string")
    for name in ("agglomerative", "correlation"):
        out = solve(abc, name, cannot_link=apart)
        assert out["r1"] != out["r3"]
    assert connected_components(edges.limit(0), Scratch(spark, "t")).collect() == []
    with pytest.raises(Exception, match="not sound"):
        C.build_graph(spark.createDataFrame([("a", "a", .5)], GRAPH)).collect()


def _sets(clusters):
    out = {}
    for k, v in clusters.items():
        out.setdefault(v, set()).add(k)
    return out.values()


def test_decisions(spark):
    flags = ", ".join(f"{f} boolean" for f in D.FLAGS)
    none = (None,) * 7
    rows = [("c", "t", .98, .98, .58, *none), ("r", "t", .75, .75, .05, *none), ("n", None, None, .10, .10, *none), ("u", "t", .55, .55, .55, *none), ("x", "t", .99, .99, .9, None, True, *none[:5]), ("k", "t", .99, .99, .9, *none[:4], True, None, None)]
    df = spark.createDataFrame(rows, f"source string, assigned_target string, probability double, top_probability double, margin double, {flags}")
    got = {r["source"]: (r["status"], r["reasons"]) for r in D.classify(df, D.Policy(.9, .15, .6, .2)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"c": "confirmed", "r": "review_required", "n": "no_match", "u": "unresolved", "x": "unresolved", "k": "review_required"}
    assert got["x"][1] == "candidate_search_truncated" and got["k"][1] == "anchor_conflict" and got["r"][1] == "review_probability_region"


REVIEW = "event_id string, left_record_key string, right_record_key string, decision string, confidence double, reviewer_id string, adjudicated_at timestamp, superseded_event_id string"


def reviews(spark, votes):
    return spark.createDataFrame([(f"e{i}", "a", "b", d, c, f"r{i}", None, s) for i, (d, c, s) in enumerate(votes)], REVIEW)


@pytest.mark.parametrize("votes,want", [
    ([("match", .9, None)], ("match", .90, "single_reviewer")), ([("match", .9, None), ("match", .8, None)], ("match", .85, "unanimous")),
    ([("match", .9, None), ("match", .8, None), ("nonmatch", .7, None)], ("match", .85, "majority")), ([("match", .9, None), ("nonmatch", .8, None)], (None, 0.0, "unresolved")),
])
def test_consensus(spark, votes, want):
    r = J.consensus(J.active_events(reviews(spark, votes))).first()
    assert (r["outcome"], round(r["confidence"], 6), r["method"]) == want


def test_reviews_supersede_and_chain(spark):
    df = reviews(spark, [("match", .9, None), ("nonmatch", .8, "e0"), ("match", .8, "e3"), ("match", .8, "e2")])
    assert {r["event_id"] for r in J.active_events(df).collect()} == {"e1"}
    assert {r["event_id"] for r in J.supersession_cycles(df, Scratch(spark, "t")).collect()} == {"e2", "e3"}
    chain = J.append_ledger([], [{"a": 1}, {"a": 2}, {"a": 3}])
    schema = "entry_index long, previous_digest string, body string, entry_digest string"
    table = lambda c: spark.createDataFrame([(x["entry_index"], x["previous_digest"], x["body"], x["entry_digest"]) for x in c], schema)
    assert J.ledger_breaks(table(chain)).collect() == []
    chain[1]["body"] = '{"a":9}'
    assert [r[0] for r in J.ledger_breaks(table(chain)).collect()] == [1]


def test_metrics(spark):
    s = spark.createDataFrame([(.95, 1), (.80, 1), (.35, 0), (.10, 0)], "score double, label int")
    m = M.pair_metrics(s).first()
    assert (m["average_precision"], m["roc_auc"], m["sensitivity"], m["ppv"]) == (1, 1, 1, 1)
    tie = spark.createDataFrame([(.9, 1), (.8, 0), (.8, 1), (.1, 0)], "score double, label int")
    assert round(M.pair_metrics(tie).first()["average_precision"], 4) == 0.8333
    c = "record_key string, predicted string, true string"
    single = M.cluster_metrics(spark.createDataFrame([(str(i), str(i), "t") for i in range(4)], c)).first()
    merged = M.cluster_metrics(spark.createDataFrame([(str(i), "p", str(i)) for i in range(4)], c)).first()
    assert (single["bcubed_precision"], single["bcubed_recall"], round(single["bcubed_f1"], 2)) == (1, .25, .4)
    assert (merged["bcubed_precision"], merged["bcubed_recall"], round(merged["bcubed_f1"], 2)) == (.25, 1, .4)


def test_isotonic(spark):
    s = spark.createDataFrame([(.1, 0), (.2, 1), (.3, 0), (.4, 1), (.4, 1)], "score double, label int")
    steps = K.fit_isotonic(s)
    assert steps == [(.1, 0.0), (.3, .5), (.4, 1.0)]
    assert [r[0] for r in spark.createDataFrame([(.05,), (.25,), (.9,), (None,)], "x double").select(K.isotonic_apply(F.col("x"), steps)).collect()] == [0.0, .5, 1.0, None]


def test_isotonic_is_exact_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), int(rng.random() < x)) for x in np.round(rng.random(3000), 3)]
    steps = K.fit_isotonic(spark.createDataFrame(rows, "score double, label int").repartition(7))
    per = {}
    for x, y in rows:
        per.setdefault(x, [0, 0])
        per[x][0] += y
        per[x][1] += 1
    whole = [(b[0], b[1] / b[2]) for b in K.pool((x, *per[x]) for x in sorted(per))]
    assert steps == whole and [v for _, v in steps] == sorted(v for _, v in steps)
    assert K.fit_isotonic(spark.createDataFrame([], "score double, label int")) == []


def test_calibrator_is_chosen_on_other_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x), int(rng.random() < x ** 3)) for x in rng.random(1500)]
    a, b = (spark.createDataFrame(part, "score double, label int") for part in (rows[:800], rows[800:]))
    c = K.choose_calibrator(a, b)
    fitted = K.calibration_diagnostics(b.select(c.apply(F.col("score")).alias("score"), "label")).first()
    assert c.name != "none" and fitted["brier"] < K.calibration_errors(b).first()["brier"] and abs(fitted["mean_probability"] - fitted["observed_rate"]) < .05
    assert K.choose_calibrator(a.filter("label = 1"), b).name == "none" and K.choose_calibrator(a, b.limit(0)).name == "sigmoid"


def test_split_keeps_households(spark):
    rows = [(f"r{i}-{s}", f"e{i}", f"h{i // 2}") for i in range(30) for s in "ab"]
    df = spark.createDataFrame(rows, "record_key string, entity string, household string")
    run = lambda: {r["record_key"]: r["partition"] for r in entity_household_split(df, {"train": .5, "dev": .25, "test": .25}, 3, Scratch(spark, "t")).collect()}
    out = run()
    assert out == run() and len(out) == 60
    for _, _, h in rows:
        assert len({out[r] for r, _, g in rows if g == h}) == 1


def test_split_follows_every_component(spark, tmp_path, monkeypatch):
    rows = [(f"a{i}", f"b{i}", 1, [f"e{i}"], [f"g{i}", f"h{i // 2}"] if i % 2 else [f"h{i // 2}", f"i{i}"]) for i in range(40)] + [("a0", "b39", 1, ["e90"], None), ("x", "y", 1, [], [])]
    spark.createDataFrame(rows, "left_record_key string, right_record_key string, label int, entity_components array<string>, household_components array<string>").write.parquet(str(tmp_path / "verified_labels.parquet"))
    spark.createDataFrame([("m", p, f) for p, f in (("train", .5), ("dev", .25), ("test", .25))], "method string, partition_name string, fraction double").write.parquet(str(tmp_path / "split_config.parquet"))
    whole = {r["record_key"]: r["partition"] for r in scoring.split(spark, str(tmp_path)).collect()}
    assert len(whole) == 82 and whole["a0"] == whole["b39"] and len(set(whole.values())) == 3
    assert all(len({whole[f"{s}{i + j}"] for s in "ab" for j in (0, 1)}) == 1 for i in range(0, 40, 2))
    assert scoring.split_disjoint(spark, str(tmp_path)).collect() == []
    monkeypatch.setattr(splitting, "UNITS_PER_TASK", 3)  # the same however many tasks place the units
    assert {r["record_key"]: r["partition"] for r in scoring.split(spark, str(tmp_path)).collect()} == whole
    monkeypatch.setattr(scoring, "split", lambda s, d: s.createDataFrame([(k, "pq"[k in ("a1", "b1")]) for k in whole], "record_key string, partition string"))
    assert {r["entity"] for r in scoring.split_disjoint(spark, str(tmp_path)).collect()} == {"household h0"}


def test_units_of_equal_size_need_no_single_steps():
    shares = {"a": 550.0, "b": 150.0, "c": 100.0, "d": 200.0}
    for start in ({"a": 0, "b": 0, "c": 0, "d": 0}, {"a": 90, "b": 2, "c": 400, "d": 7}):
        for n in (1, 3):
            slow = dict(start)
            for count in range(1, 300):
                splitting._place(slow, shares, n)
                assert advance(start, shares, n, count) == slow


def test_sparse_assignment_is_exact():
    rng = np.random.default_rng(5)
    for n, m, share in ((1, 1, 1), (7, 5, .5), (12, 12, .3), (15, 30, .2), (30, 12, .6)):
        for _ in range(20):
            gain = np.where(rng.random((n, m)) < share, rng.integers(1, 60, (n, m)), 0)
            got = sparse_assignment([(i, j, int(gain[i, j])) for i in range(n) for j in range(m)])
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
            assert sum(gain[x] for x in got) == sum(gain[x] for x in hungarian(gain.astype(float)))


def test_long_chains_are_no_cycles(spark):
    votes = [("match", .9, None)] + [("match", .9, f"e{i}") for i in range(70)] + [("match", .9, "e72"), ("match", .9, "e71"), ("match", .9, "e71")]
    assert {r["event_id"] for r in J.supersession_cycles(reviews(spark, votes), Scratch(spark, "t")).collect()} == {"e71", "e72", "e73"}


def test_retrieval_takes_pairs_in_either_order(spark, monkeypatch):
    key = "left_record_key string, right_record_key string"
    tables = {"comparison_features": spark.createDataFrame([("source-a-1", "source-b-1"), ("source-b-2", "source-a-2"), ("source-b-1", "source-a-1"), ("source-a-1", "source-a-2")], key),
              "verified_labels": spark.createDataFrame([("source-b-2", "source-a-2", 1), ("source-a-1", "source-b-4", 1)], key + ", label int")}
    monkeypatch.setattr(scoring, "read_table", lambda s, d, name: tables[name])
    monkeypatch.setattr(scoring, "latest", lambda s, d, name: s.createDataFrame([(f"{name.replace('_', '-')}-{i}",) for i in range(1, 5 if name == "source_b" else 3)], "record_key string"))
    r = scoring.retrieval(spark, "").first()
    assert (r["candidate_pairs"], r["true_pairs"], r["true_found"], r["zero_candidate_sources"], r["reduction"]) == (2, 2, 1, 0, 0.75)


def test_evidence_knows_assignment_conflicts(spark):
    e = A.edge_costs(spark.createDataFrame([("s1", "t1", .95), ("s1", "t2", .80), ("s2", "t1", .94), ("s2", "t2", .10), ("s4", "t3", .20)], EDGE))
    sources = spark.createDataFrame([(f"s{i}",) for i in range(1, 5)], "source string")
    rows = {r["source"]: r for r in D.evidence(sources, e, A.one_to_one(e, Scratch(spark, "t"))).collect()}
    assert {k: r["assignment_conflict"] for k, r in rows.items()} == {"s1": True, "s2": False, "s3": False, "s4": False}
    assert rows["s3"]["top_probability"] == 0 and rows["s2"]["second_probability"] == .10
    flags = {f: F.lit(False) for f in D.FLAGS if f != "assignment_conflict"}
    got = {r["source"]: r["decision_rule_id"] for r in D.classify(D.evidence(sources, e, A.one_to_one(e, Scratch(spark, "t"))).withColumns(flags)).collect()}
    assert got == {"s1": "review_conflicting_evidence", "s2": "review_probability_region", "s3": "no_match_explicit_assignment", "s4": "no_match_explicit_assignment"}


@pytest.mark.parametrize("method,seniors,votes,want", [
    ("majority_vote", ("r2",), [("match", .9), ("match", .8), ("nonmatch", .7)], ("nonmatch", .7, "senior_override", None)),
    ("majority_vote", ("r0", "r2"), [("match", .9), ("match", .8), ("nonmatch", .7)], (None, 0.0, "unresolved", "conflicting_senior_reviewers")),
    ("strict_double_review", (), [("match", .9)], (None, 0.0, "unresolved", "insufficient_reviewers")),
    ("strict_double_review", (), [("match", .9), ("nonmatch", .9)], (None, 0.0, "unresolved", "double_review_conflict")),
    ("unanimous_only", ("r0",), [("match", .9), ("nonmatch", .9)], (None, 0.0, "unresolved", "unanimous_policy_conflict")),
    ("majority_vote", (), [("match", .9), ("nonmatch", .9)], (None, 0.0, "unresolved", "tied_vote")),
])
def test_consensus_policies(spark, method, seniors, votes, want):
    df = reviews(spark, [(d, c, None) for d, c in votes])
    r = J.consensus(J.active_events(df), J.ConsensusPolicy(method, seniors=seniors)).first()
    assert (r["outcome"], round(r["confidence"], 6), r["method"], r["dispute_reason"]) == want


def test_promotion_gives_every_reason(spark):
    rows = [("a", "b", "match", .9, 2, "v1"), ("a", "c", "nonmatch", .5, 1, "v2"), ("a", "d", None, 0.0, 2, "v1"), ("a", "e", "unresolved", .9, 2, "v1"), ("a", "f", "match", .9, 2, "v1")]
    df = spark.createDataFrame(rows, "left_record_key string, right_record_key string, outcome string, confidence double, reviewers long, protocol_version string")
    locked = spark.createDataFrame([("f", "a"), ("f", "a")], "left_record_key string, right_record_key string")
    p = J.promotion(df, locked, J.PromotionPolicy(double_review=True, protocols=("v1",)))
    assert {r["right_record_key"]: r["reasons"] for r in p.collect()} == {
        "b": "", "c": "insufficient_confidence,requires_double_review,unapproved_protocol_version", "d": "unresolved_dispute,non_binary_outcome_audit_only,insufficient_confidence",
        "e": "non_binary_outcome_audit_only", "f": "locked_test_partition_violation"}
    assert J.promotion_summary(p).first().asDict() == {"evaluated": 5, "eligible": 1, "positives": 1, "negatives": 0, "audit_only": 4, "rejected": 4}
    label = J.promoted_labels(p, "x").collect()
    assert len(label) == 1 and label[0]["label"] == 1 and len(label[0]["entity_components"]) == 1
    assert J.promotion(df, locked, J.PromotionPolicy("test")).filter("right_record_key = 'f'").first()["eligible"]


def test_entity_digest_covers_every_member(spark, monkeypatch):
    import hashlib

    rows = [("c1", f"k{i:02d}", "ab"[i % 2]) for i in range(30)] + [("c2", "x", "a")]
    df = spark.createDataFrame(rows, "cluster_key string, record_key string, dataset_id string")
    want = {c: hashlib.sha256("".join(f"{k}\x00{d}\n" for c2, k, d in sorted(rows) if c2 == c).encode()).hexdigest() for c in ("c1", "c2")}
    assert dict(C.entity_digests(df).collect()) == want
    monkeypatch.setattr(C, "GATHERED_MEMBERS", 5)
    assert dict(C.entity_digests(df).collect()) == want


def test_graph_takes_the_last_weight(spark):
    e = spark.createDataFrame([("a", "b", .9, 1), ("b", "a", .4, 2)], "u string, v string, weight double, n int")
    assert C.build_graph(e, order="n").collect() == [("a", "b", .4)] and C.build_graph(e).collect() == [("a", "b", .9)]
    with pytest.raises(ValueError, match="unknown record"):
        C.build_graph(e, spark.createDataFrame([("a",)], "record_key string"))


def test_priority_strategies(spark):
    df = spark.createDataFrame([(.5, 0.0, "review_probability_region"), (None, None, None)], "p double, m double, r string")
    row = lambda strategy: [round(x[0], 6) for x in df.select(D.priority(D.uncertainty(F.col("p"), .5), D.margin_score(F.col("m")), D.committee(F.col("p"), F.lit(.2)), F.col("r"), strategy)).collect()]
    assert row("uncertainty") == [1, 1] and row("margin") == [1, 1] and row("committee") == [.3, 0] and row("hybrid") == [.84, .75]
    q = spark.createDataFrame([("x", .2), ("y", .9), ("z", .9)], "relationship_id string, priority double")
    for temperature in (1.0, .001):
        got = D.prioritise(q, 2, temperature).collect()
        assert [r["relationship_id"] for r in got] == ["y", "z"] and got[0]["sampling_probability"] == got[1]["sampling_probability"] > 0

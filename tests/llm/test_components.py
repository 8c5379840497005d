"""Hash-to-min and what is built on it, against union-find."""

import random
from collections import defaultdict

import pytest

import kinfold.operators.skew as skew
from kinfold.functions.kernels import UnionFind
from kinfold.llm.components import build_vertices, hash_to_min
from kinfold.llm.grouping import assign_splits, predicted_links, record_groups, split_units
from kinfold.session import Scratch


def roots(edges):
    u = UnionFind({x for e in edges for x in e})
    for a, b in edges:
        u.union(a, b)
    return {x: u.find(x) for x in u.parent}


GRAPHS = {
    "chain": [(i, i + 1) for i in range(200)],
    "star": [(0, i) for i in range(1, 300)],
    "random": [(random.Random(i).randint(0, 400), random.Random(i + 999).randint(0, 400)) for i in range(260)],
    "loops and repeats": [(5, 5), (1, 2), (2, 1), (1, 2), (7, 7), (2, 3)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_equals_union_find(spark, name):
    edges = GRAPHS[name]
    got = hash_to_min(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["id"]: r["root"] for r in got} == roots(edges)


def test_hot_vertices_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.02)
    edges = GRAPHS["star"] + [(1000 + i, 1001 + i) for i in range(40)]
    got = hash_to_min(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["id"]: r["root"] for r in got} == roots(edges)


def test_no_edges_and_null_ends(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "a long, b long")
    assert hash_to_min(df, Scratch(spark, "t")).collect() == []


def test_vertices_have_distinct_ids(spark):
    table, seed = build_vertices(spark.createDataFrame([("a",), ("b",), ("a",)], "key string"), Scratch(spark, "t"))
    assert seed == 1 and sorted(r["key"] for r in table.collect()) == ["a", "b"]


PAIRS = "left_record_key string, right_record_key string, run_no int, match_probability double, group_key string"
LABELS = "pair_digest string, left_record_key string, right_record_key string, label int, entity_components array<string>, household_components array<string>, root string"


def test_newest_run_decides(spark):
    rows = [("a", "b", 1, 0.9, None), ("b", "a", 2, None, None), ("c", "d", 1, 0.1, None), ("d", "c", 3, 0.8, None), ("e", "e", 1, 1.0, None), (None, "x", 1, 1.0, None), ("f", "g", 1, float("nan"), None), ("h", "i", None, 0.9, None), ("j", "k", 1, 0.79999, None), ("j", "k", 1, 0.85, None)]
    got = {tuple(r) for r in predicted_links(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {("c", "d"), ("j", "k")}


def test_groups(spark):
    pairs = spark.createDataFrame([("r1", "r2", 1, 0.95, None), ("r8", "r9", 1, 0.3, None)], PAIRS)
    labels = spark.createDataFrame(
        [("d1", "r3", "r2", 1, ["E1", "E1"], ["H1"], None), ("d2", "r5", "r4", 1, ["E1"], None, None), ("d3", "r6", "r7", 1, ["E2"], ["H1", None], None), ("d4", "r1", "r8", 0, ["E1", "E9"], ["H1"], None), ("d5", None, "r9", 1, None, [], None)], LABELS)
    got = defaultdict(set)
    for kind, key, record in record_groups(pairs, labels, Scratch(spark, "t")).collect():
        got[kind, key].add(record)
    assert dict(got) == {("entity", "r1"): {"r1", "r2", "r3", "r4", "r5"}, ("entity", "r6"): {"r6", "r7"}, ("household", "r1"): {"r1", "r2", "r3", "r4", "r5", "r6", "r7"}}
    assert record_groups(pairs.limit(0), labels.limit(0), Scratch(spark, "t")).collect() == []


def label_rows(n, seed):
    r = random.Random(seed)
    return [(f"p{i:04d}", f"l{i}", f"r{i}", i % 2, [f"E{r.randint(0, n)}"], r.choice([None, [], [f"H{r.randint(0, n // 2)}"]]), None) for i in range(n)]


def test_units_and_splits(spark):
    rows = label_rows(300, 4) + [(f"q{i:04d}", "x", "y", 1, ["BIG"], None, None) for i in range(120)] + [("p0000", "l0", "r0", 0, ["BIG"], None, None), (None, "x", "y", 1, ["E1"], None, None)]
    edges = [(("p", r[0]), (kind, t)) for r in rows if r[0] for kind, ts in (("e", r[4]), ("h", r[5])) for t in ts or []]
    want = defaultdict(set)
    for x, root in roots(edges).items():
        if x[0] == "p":
            want[root].add(x[1])
    scratch = Scratch(spark, "t")
    units = split_units(spark.createDataFrame(rows, LABELS), scratch)
    got = defaultdict(set)
    for unit, pair, size in units.collect():
        got[unit].add((pair, size))
    assert {frozenset(p for p, _ in v) for v in got.values()} == {frozenset(v) for v in want.values()}
    assert all(min(p for p, _ in v) == k and {s for _, s in v} == {len(v)} for k, v in got.items())
    fractions = {"train": 0.6, "dev": 0.2, "test": 0.2}
    out = assign_splits(units, fractions, scratch).collect()
    assert len(out) == 420 and len({(r["unit_digest"], r["partition_name"]) for r in out}) == len(got)
    for name, share in fractions.items():
        assert abs(sum(r["partition_name"] == name for r in out) / 420 - share) < 0.05
    assert {tuple(r) for r in assign_splits(units, fractions, scratch).collect()} == {tuple(r) for r in out}


def test_shares_of_a_split(spark):
    from kinfold.llm.grouping import split_shares

    rows = [("p1", "u1", "train"), ("p2", "u1", "train"), ("p3", "u2", "train"), ("p4", "u3", "dev")]
    df = spark.createDataFrame(rows, "pair_digest string, unit_digest string, partition_name string")
    got = {r["partition_name"]: tuple(r)[1:] for r in split_shares(df, {"train": .7, "dev": .2, "test": .1}, spark).collect()}
    assert got == {"train": (.7, 3, .75, 2, 2, .5), "dev": (.2, 1, .25, 1, 1, .25), "test": (.1, 0, 0.0, 0, 0, 0.0)}
    assert all(r["pairs"] == 0 for r in split_shares(df.limit(0), {"train": 1.0}, spark).collect())

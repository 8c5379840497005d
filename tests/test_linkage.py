"""Fixtures of normalisation, blocking, comparison, anchors and the scoring model."""

import math

import pytest
from pyspark.sql import functions as F

from kinfold.functions import normalise as N
from kinfold.functions import similarity as S
from kinfold.operators import blocking as B
from kinfold.operators import features as X
from kinfold.operators import fellegi as FS


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_normalise(spark):
    steps = ["nfkc", "casefold", "strip", "collapse_whitespace"]
    assert one(spark, "  ＡLPHA\t  Beta  ", lambda x: N.normalise_value(x, steps)) == "alpha beta"
    assert one(spark, "Straße", lambda x: N.normalise_value(x, ["casefold"])) == "strasse"
    assert one(spark, "   ", lambda x: N.normalise_value(x, ["strip"])) is None
    assert str(one(spark, "31/12/2025", lambda x: N.normalise_value(x, [("parse_date", ["dd/MM/yyyy"])]))) == "2025-12-31"
    assert one(spark, "1.0", N.to_integer) == 1 and one(spark, "1.5", N.to_integer) is None
    assert one(spark, "yes", N.to_boolean) is True and one(spark, "0", N.to_boolean) is False
    with pytest.raises(Exception, match="does not fit") as failure:
        one(spark, "123.75-SENTINEL", lambda x: N.normalise_value(x, ["integer"], strict=True))
    assert "SENTINEL" not in str(failure.value).split("\n")[0]


def test_identities(spark):
    df = N.prepare(spark.createDataFrame([("a", " X ", 1), ("b", None, 2)], "id string, name string, v_name int"), "d", "id", {"name": ("name", ["strip"])})
    assert [(r["v_name"], r["m_name"]) for r in df.collect()] == [("X", False), (None, True)]
    N.check_identities(df)
    with pytest.raises(N.NormalisationError):
        N.check_identities(df.unionByName(df))


BLOCK_L = [("left-1", "alpha", "2000-01-01", "zone-1"), ("left-2", "beta", "2001-01-01", "zone-2"), ("left-3", "gamma", "2002-01-01", "zone-3"), ("left-4", None, None, None)]
BLOCK_R = [("right-1", "alpha", "2000-01-01", "zone-9"), ("right-2", "alpine", "1999-01-01", "zone-1"), ("right-3", "beta", "2001-01-01", "zone-2"), ("right-4", "delta", "2003-01-01", "zone-4"), ("right-5", None, None, None)]
BLOCK = "record_key string, v_name string, v_date string, v_location string"


def test_blocking(spark):
    left, right = spark.createDataFrame(BLOCK_L, BLOCK), spark.createDataFrame(BLOCK_R, BLOCK)
    rules = {"r1": B.AllOf((B.Exact("date"), B.Prefix("name", 1))), "r2": B.AllOf((B.Exact("location"), B.Prefix("name", 1)))}
    got = {(r[0], r[1]): (r[2], r[3]) for r in B.candidate_pairs(left, right, rules).collect()}
    assert got == {("left-1", "right-1"): ("r1", 1), ("left-1", "right-2"): ("r2", 1), ("left-2", "right-3"): ("r1,r2", 2)}
    assert tuple(B.candidate_diagnostics(B.candidate_pairs(left, right, rules)).first()) == (3, 1, 2)
    with pytest.raises(B.BudgetExceeded):
        B.check_budget(B.candidate_pairs(left, right, rules), 2)
    assert B.pair_bounds(left, right, rules)[1] >= 3
    assert B.candidate_pairs(left, right.limit(0), rules).collect() == []


def test_date_window_and_or_have_no_nested_loop(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("record_key"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 200).cast("int")).alias("v_d"), (F.col("id") % 17).alias("v_g"))
    rules = {"w": B.AnyOf((B.DateWindow("d", 3), B.Exact("g")))}
    pairs = B.candidate_pairs(df, None, rules)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = df.collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (abs((a[1] - b[1]).days) <= 3 or a[2] == b[2])}
    assert {(r[0], r[1]) for r in pairs.collect()} == want


def test_comparisons(spark):
    rows = [("abcd", "abce"), ("alfa", "alpha"), ("", ""), (None, "x"), ("ca", "abc"), ("ñ", "n")]
    df = spark.createDataFrame(rows, "l string, r string")
    l, r = F.col("l"), F.col("r")  # noqa: E741
    got = df.select(S.qgram_similarity(l, r, 2), S.levenshtein_similarity(l, r), S.jaro_winkler(l, r), S.damerau_similarity(l, r)).collect()
    assert got[0][0] == pytest.approx(2 / 3) and got[1][1] == pytest.approx(0.6) and got[1][2] >= 0.8
    assert tuple(got[2]) == (1.0, 1.0, 0.0, 1.0) and tuple(got[3]) == (None,) * 4
    assert got[4][3] == pytest.approx(1 - 2 / 3) and got[5][1] == 0.0
    days = spark.sql("select date'2021-01-31' a, date'2021-02-01' b").select(S.date_difference(F.col("a"), F.col("b"), "month"), S.date_difference(F.col("a"), F.col("b"), "year")).first()
    assert tuple(days) == (1.0, 0.0)


def test_levels(spark):
    with pytest.raises(ValueError):
        X.Comparison("c", "v", "exact", (("exact",),))
    with pytest.raises(ValueError):
        X.Comparison("c", "v", "exact", (("threshold", 0.5), ("threshold", 0.6), ("else",)))
    comparison = X.Comparison("c", "name", "levenshtein", (("exact",), ("threshold", 0.5), ("else",)))
    left = spark.createDataFrame([("l1", "abc"), ("l2", None)], "record_key string, v_name string")
    right = spark.createDataFrame([("r1", "abd"), ("r2", "abc")], "record_key string, v_name string")
    pairs = left.select(F.col("record_key").alias("left_record_key")).crossJoin(right.select(F.col("record_key").alias("right_record_key")))
    got = {(r[0], r[1]): (r["c_level"], r["c_missing_any"]) for r in X.comparison_features(pairs, left, right, [comparison], check=True).collect()}
    assert got == {("l1", "r1"): (1, False), ("l1", "r2"): (0, False), ("l2", "r1"): (None, True), ("l2", "r2"): (None, True)}


def test_anchors(spark):
    schema = "record_key string, v_text string, v_date date"
    left = spark.createDataFrame([("left-1", "alpha", "2020-01-01"), ("left-2", "alfa", "2020-01-02"), ("left-3", "beta", "2020-02-01")], "k string, t string, d string").selectExpr("k record_key", "t v_text", "cast(d as date) v_date")
    right = spark.createDataFrame([("right-1", "alpha", "2020-01-01"), ("right-2", "alpine", "2020-01-03"), ("right-3", "beta", "2020-02-02")], "k string, t string, d string").selectExpr("k record_key", "t v_text", "cast(d as date) v_date")
    anchors = [X.Anchor("exact", B.AllOf((B.Exact("text"), B.Exact("date")))), X.Anchor("prefix", B.Prefix("text", 1)), X.Anchor("near", B.DateWindow("date", 1), False, False)]
    rows = X.anchor_evidence(left, right, anchors).collect()
    exact = [r for r in rows if r["anchor_id"] == "exact"]
    assert [(r["left_match_count"], r["right_match_count"], r["uniqueness_pass"]) for r in exact] == [(1, 1, True)]
    assert any(not r["uniqueness_pass"] for r in rows if r["anchor_id"] == "prefix")
    assert all(r["uniqueness_pass"] for r in rows if r["anchor_id"] == "near")
    assert X.anchor_evidence(left, right, []).schema.simpleString().startswith("struct<left_record_key") and schema


def test_model():
    levels, missing = {"a": 3, "b": 3}, {"a": 0, "b": 0}
    u = {"a": [0.1, 0.1, 0.8], "b": [0.1, 0.2, 0.7]}
    rows = [((1, 1), 80), ((1, 2), 10), ((2, 1), 10), ((2, 2), 900), ((0, 1), 5), ((None, 2), 3)]
    m = FS.expectation_maximisation(rows, levels, u, missing, 0.1)
    assert all(sum(v) == pytest.approx(1.0) for v in m.values()) and m["a"][1] > 0.5 and m["a"][0] == 0.1
    w = FS.level_weights(m, u, missing)
    assert w["a"][0] == 0 and w["a"][1] > 0 > w["a"][2] and math.isfinite(w["b"][1])


def test_random_pairs_come_from_all_pairs(spark):
    from kinfold.operators.blocking import random_pairs
    from kinfold.session import Scratch

    a, b = (spark.createDataFrame([(f"{s}{i:04d}",) for i in range(n)], "record_key string") for s, n in (("a", 3000), ("b", 2000)))
    got = random_pairs(a, b, 2000, 3, Scratch(spark, "t")).collect()
    assert len(got) == len(set(got)) == 2000
    assert len({r[0] for r in got}) > 1200 and len({r[1] for r in got}) > 1000  # draws with repeats, from every record
    assert len(set(random_pairs(a.limit(5), b.limit(4), 30, 3, Scratch(spark, "t")).collect())) == 20
    assert random_pairs(a.limit(0), b, 30, 3, Scratch(spark, "t")).collect() == []


def test_budget_is_checked_before_the_join(spark):
    from kinfold.operators.blocking import BudgetExceeded, DateWindow, Exact, check_bounds, pair_bounds

    rows = spark.createDataFrame([(f"r{i}", "x" if i < 6 else None) for i in range(8)], "record_key string, v_g string")
    assert pair_bounds(rows, rows, {"g": Exact("g")}) == (36, 36) and pair_bounds(rows, None, {"g": Exact("g")}) == (15, 15)
    assert check_bounds(rows, rows, {"g": Exact("g")}, 40) is False
    with pytest.raises(BudgetExceeded):
        check_bounds(rows, rows, {"g": Exact("g")}, 20)
    days = spark.createDataFrame([("r1", None)], "record_key string, v_d date")
    assert pair_bounds(days, days, {"d": DateWindow("d", 3)}) == (0, 0)


def test_pairs_of_unique_keys_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(240).select(F.col("id").cast("string").alias("record_key"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 60).cast("int")).alias("v_d"),
                                   F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")))).alias("v_g"),
                                   F.concat((F.col("id") % 4).cast("string"), (F.col("id") % 9).cast("string")).alias("v_n"))
    rules = {"z": B.AnyOf((B.AllOf((B.Exact("g"), B.Prefix("n", 1))), B.DateWindow("d", 2))), "y": B.AllOf((B.Exact("g"), B.DateWindow("d", 9))),
             "x": B.Prefix("n", 1), "w": B.AllOf((B.Prefix("n", 1), B.Exact("d")))}
    for other in (rows.filter("record_key % 2 = 0"), None):
        want = sorted(B.candidate_pairs(rows, other, rules).collect())
        assert sorted(B.candidate_pairs(rows, other, rules, unique=True).collect()) == want
        monkeypatch.setattr(B, "PAIRS_PER_TASK", 50)  # so that blocks are cut
        monkeypatch.setattr(B, "CELL_SIDE", 7)
        cut = B.candidate_pairs(rows, other, rules, unique=True)
        assert sorted(cut.collect()) == want and cut.schema.simpleString() == B.candidate_pairs(rows, other, rules).schema.simpleString()
        monkeypatch.undo()
    left, right = spark.createDataFrame(BLOCK_L, BLOCK), spark.createDataFrame(BLOCK_R, BLOCK)
    plan = B.candidate_pairs(left, right, {"r": B.Exact("name"), "s": B.Prefix("location", 5)}, unique=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan
    twice = left.unionByName(left)
    assert B.unique_keys(left) and not B.unique_keys(twice)
    assert B.candidate_pairs(left.limit(0), right, {"r": B.Exact("name")}, unique=True).collect() == []


def test_blocks_of_short_labels_keep_pairs_in_place(spark):
    from kinfold.plans.checks import short_labels_blocked

    pairs = short_labels_blocked(spark, "/root/testdata/sf0.001")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_numeric_rounding_and_blocks_of_few_keys(spark, monkeypatch):
    values = [0.0, 0.0000005, 0.0000015, 1.2345675, 109.9989, 3.4e5, 1e300, 1.7e308, math.inf, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(S.round_double(F.col("x"), 6)).collect()]
    assert got == [0.0, 0.000001, 0.000002, pytest.approx(1.234567, abs=1.1e-6), 109.9989, 3.4e5, pytest.approx(1e300), 1.7e308, math.inf, None]
    one = spark.range(60).select(F.col("id").alias("l"), F.when(F.col("id") < 50, 1).alias("k"))
    two = spark.range(40).select((F.col("id") % 30).alias("r"), F.lit(1).alias("k"))
    want = sorted(one.join(two, "k").select("l", "r").collect())
    monkeypatch.setattr(B, "PAIRS_PER_TASK", 50)
    monkeypatch.setattr(B, "CELL_SIDE", 7)
    met = B.block_join(one, two, ["k"])
    assert sorted(met.select("l", "r").collect()) == want and len(want) == 2000
    sizes = met.select("l", "r").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1000  # one key, several tasks


def test_assignment_of_one_large_component_is_light():
    import itertools
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from kinfold.operators.assignment import assign_edges

    def table(rows):
        return pa.Table.from_pydict({"source": [r[0] for r in rows], "target": [r[1] for r in rows], "probability": [0.9] * len(rows), "cost": [r[2] for r in rows]},
                                    pa.schema([("source", pa.string()), ("target", pa.string()), ("probability", pa.float64()), ("cost", pa.int64())]))

    rng = np.random.default_rng(3)
    rows = [(f"s{i}", f"t{j}", -int(rng.integers(1, 100))) for i in range(4) for j in range(4) if (i + j) % 3]
    cost = {(a, b): c for a, b, c in rows}
    best = min(sum(cost.get((f"s{i}", f"t{j}"), 0) for i, j in enumerate(p)) for p in itertools.permutations(range(4)))
    got = assign_edges(table(rows), 0, 1, 1).to_pylist()
    assert sum(r["cost"] for r in got) == best and len({r["source"] for r in got}) == len({r["target"] for r in got}) == len(got)
    two = assign_edges(table(rows), 0, 1, 2).to_pylist()
    assert len({r["source"] for r in two}) == len(two) == 4
    assert assign_edges(table([]), 0, 1, 1).num_rows == 0
    many = table([(f"{i:064d}", f"{(i + k) % 3000:064d}", -1_000_000 + 1000 * k) for i in range(3000) for k in range(20)])
    tracemalloc.start()
    assert assign_edges(many, 0, 1, 1).num_rows == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 * many.num_rows


def test_jaro_winkler_of_a_batch_equals_that_of_each_pair():
    import random

    import pyarrow as pa

    draw = random.Random(5)
    text = lambda: "".join(draw.choice("abcdé ü") for _ in range(draw.choice([0, 1, 2, 3, 7, 20, 31, 33, 63, 64, 65, 90])))
    left = [None if draw.random() < .05 else text() for _ in range(6000)]
    right = [None if draw.random() < .05 else text() if x is None or draw.random() < .4 else "".join(c if draw.random() > .15 else draw.choice(["", c + c, "a"]) for c in x) for x in left]
    got = S.jaro_winkler_arrow(pa.array(["x", *left]).slice(1), pa.array(["y", *right]).slice(1)).to_pylist()
    assert got == [None if a is None or b is None else S.jaro_winkler_bytes(a.encode(), b.encode()) for a, b in zip(left, right)]


def test_blocks_with_a_window_are_bounded_by_near_days(spark):
    from kinfold.operators.blocking import AllOf, DateWindow, Exact, candidate_pairs, pair_bounds

    rows = spark.range(400).selectExpr("cast(id as string) as record_key", "'g' as v_g", "date_add(date'2000-01-01', cast(id * 10 as int)) as v_d")
    rules = {"r": AllOf((Exact("g"), DateWindow("d", 3)))}
    least, most = pair_bounds(rows, rows, rules)
    assert least == 0 and candidate_pairs(rows, rows, rules).count() == 400 <= most < 400 * 3
    assert candidate_pairs(rows, None, {"r": AllOf((Exact("g"), DateWindow("d", 10)))}).count() == 399 <= pair_bounds(rows, None, {"r": AllOf((Exact("g"), DateWindow("d", 10)))})[1] < 399 * 3


def test_pairs_that_carry_values_have_the_same_features(spark):
    from kinfold.operators.blocking import Exact, candidate_pairs

    rows = spark.createDataFrame([("1", "a", "x"), ("2", "a", None), ("3", None, "y"), ("4", "b", "y")], "record_key string, v_g string, v_n string")
    comparison = [X.Comparison("n", "n", "exact", (("missing",), ("exact",), ("else",)))]
    plain = X.comparison_features(candidate_pairs(rows, rows, {"r": Exact("g")}, unique=True), rows, rows, comparison)
    carried = X.comparison_features(candidate_pairs(rows, rows, {"r": Exact("g")}, unique=True, carry=("n",)), rows, rows, comparison, keep=("retrieval_rule_ids",))
    assert sorted(plain.collect()) == sorted(carried.drop("retrieval_rule_ids").collect()) and carried.count() == 5

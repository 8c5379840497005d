"""Packing: whole, within capacity, near its certificate. Mixing: shares, repeats, determinism."""

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import mixing, packing, tokens
from kinfold.session import Scratch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit_decreasing_and_bound(sizes):
    place, used = packing.best_fit_decreasing(np.array(sizes, np.int64), 50)
    room = Counter()
    for s, c in zip(sizes, place):
        room[c] += s
    assert all(v <= 50 for v in room.values()) and used == len(set(place.tolist()))
    values, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
    bound = packing.lower_bound(values, counts, 50)
    assert -(-sum(sizes) // 50) <= bound <= max(used, bound if not sum(sizes) else 0)
    assert used <= 1.5 * bound + 1


def test_bound_knows_items_that_cannot_share():
    assert packing.lower_bound(np.array([26]), np.array([7]), 50) == 7
    assert packing.lower_bound(np.array([17]), np.array([7]), 50) == 4
    assert packing.lower_bound(np.array([], np.int64), np.array([], np.int64), 50) == 0


def check(rows, items, capacities):
    for name, capacity in capacities.items():
        own = [r for r in rows if r[0] == name]
        load, cover = Counter(), defaultdict(list)
        for _, container, doc, first, n in own:
            load[container] += n
            cover[doc].append((first, n))
        assert max(load.values(), default=0) <= capacity
        for doc, size in items:
            parts = sorted(cover[doc])
            assert sum(n for _, n in parts) == size and len(parts) == max(1, -(-size // capacity))
            assert [f for f, _ in parts] == [i * capacity for i in range(len(parts))]


def test_everything_is_packed_once(spark):
    r = random.Random(1)
    items = [(i, r.choice([0, 1, r.randint(1, 100), 100, 101, r.randint(100, 1000)])) for i in range(600)]
    df = spark.createDataFrame([(i, i, n, "x") for i, n in items], "item long, doc_id long, n_tokens long, container string")
    capacities = {"small": 100, "big": 512}
    for per in (100_000, 80):
        packed = packing.fill_containers(df, capacities, Scratch(spark, "t"), per_partition=per)
        check([tuple(x)[:5] for x in packed.collect()], items, capacities)
        report = {x["spec_name"]: x for x in packing.packing_report(packed, capacities, spark).collect()}
        assert all(0 < x["certified_containers"] <= x["containers"] for x in report.values())
        assert all(x["lower_bound"] <= x["containers"] <= 1.06 * x["lower_bound"] + 1 for x in report.values())
    assert packing.fill_containers(df.limit(0), capacities, Scratch(spark, "t")).collect() == []


def test_sizes_of_null_empty_and_long_texts(spark):
    long = "word " * 60_000
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "a b", "s"), (3, "a b", "s"), (4, long, "s"), (None, "<|endoftext|>", "s")], "doc_id long, text string, quality string")
    got = [(r["doc_id"], r["n_tokens"]) for r in tokens.measured(df).collect()]
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] >= 60_000 and got[5][0] is None and got[5][1] > 1


def documents(spark, n, seed=5):
    r = random.Random(seed)
    rows = [(i, i, r.choices(["Big", " big ", "mid-one", "MID_ONE", "tiny", None, "unnamed"], [50, 5, 20, 5, 3, 3, 5])[0], r.randint(0, 60), r.uniform(0.05, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "item long, doc_id long, source string, n_tokens long, quality double")


PLANS = [("p", "big", 0.5, 1), ("p", "mid_one", 0.3, 2), ("p", "tiny", 0.2, 4), ("q", "tiny", 0.9, 3), ("q", "absent", 0.1, 3)]


def test_mix(spark):
    rows, df = documents(spark, 2000)
    for per in (5000, 20):
        uses, report = mixing.mix_sources(df, PLANS, Scratch(spark, "t"), spark, rows_per_bucket=per)
        got = uses.collect()
        limit = {(p, s): k for p, s, _, k in PLANS}
        assert all(1 <= r["uses"] <= limit[r["plan_name"], r["source"]] for r in got)
        assert len({(r["plan_name"], r["doc_id"]) for r in got}) == len(got)
        shares = {(r["plan_name"], r["source"]): r for r in report.collect()}
        for p, s, share, _ in PLANS[:3]:
            assert abs(shares[p, s]["actual_share"] - share) < 0.01
        assert shares["q", "absent"]["mixed_tokens"] == 0 and shares["q", "tiny"]["actual_share"] == 1
        counts = Counter((r["plan_name"], r["source"], r["uses"]) for r in got)
        tiny = [k[2] for k in counts if k[:2] == ("p", "tiny")]
        assert max(tiny) - min(tiny) <= 1  # complete epochs first
        again = {tuple(r) for r in mixing.mix_sources(df, PLANS, Scratch(spark, "t"), spark, rows_per_bucket=per)[0].collect()}
        assert again == {tuple(r) for r in got}


def test_quality_weights_draw(spark):
    df = spark.createDataFrame([(i, i, "s", 10, 1.0 if i % 2 else 0.05) for i in range(2000)] + [(9000 + i, 9000 + i, "t", 10, 1.0) for i in range(50)], "item long, doc_id long, source string, n_tokens long, quality double")
    uses, _ = mixing.mix_sources(df, [("p", "s", 0.5, 1), ("p", "t", 0.5, 4)], Scratch(spark, "t"), spark)
    drawn = [r["doc_id"] for r in uses.collect() if r["source"] == "s"]
    assert len(drawn) == 200 and sum(i % 2 for i in drawn) > 170


def test_empty_documents(spark):
    _, df = documents(spark, 1)
    uses, report = mixing.mix_sources(df.limit(0), PLANS, Scratch(spark, "t"), spark)
    assert uses.collect() == [] and {r["mixed_tokens"] for r in report.collect()} == {0}


def test_items_do_not_depend_on_the_layout(spark, tmp_path):
    from kinfold.llm import queries

    rows = [(i % 40 or None, "word " * (i % 7), "s" if i % 3 else None) for i in range(200)]
    for n, order in ((1, rows), (5, rows[::-1])):
        spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
    a, b = (sorted(map(tuple, queries._sized(spark, str(tmp_path / n), Scratch(spark, "t"), "source").collect()), key=str) for n in "15")
    assert a == b and len(a) == 200 == len({x[-1] for x in a})


def test_buckets_are_even_whatever_the_weights(spark):
    # most texts weigh very little: their keys crowd at the far end
    df = spark.createDataFrame([(i, i, "s", 10, 0.05 if i % 10 else 1.0) for i in range(4000)], "item long, doc_id long, source string, n_tokens long, quality double")
    scratch = Scratch(spark, "t")
    mixing.mix_sources(df, [("p", "s", 1.0, 1)], scratch, spark, rows_per_bucket=200)[0].count()
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch.root}/drawn").groupBy("bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * sum(sizes) / len(sizes)

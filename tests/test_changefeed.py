"""The fold against a row-by-row replay, and its defined results at the edges."""

import random

import pytest

from kinfold.operators.changefeed import FeedSpec, apply_changes, fold_changes, live_rows

SPEC = FeedSpec(key=["k"], position=["epoch", "seq"], op="op", payload=["a", "b"], changed="named")
SCHEMA = "epoch int, seq long, op string, k string, a string, b int, named string"


def replay(rows):
    table = {}
    for epoch, seq, op, k, a, b, named in sorted({r for r in rows if None not in r[:4]}, key=lambda r: r[:2]):
        o = op.strip()[:1].lower()
        if o == "i":
            table[k] = {"a": a, "b": b}
        elif o == "d":
            table.pop(k, None)
        elif o == "u" and k in table:
            fields = ["a", "b"] if named is None else [x.strip() for x in named.split(",")]
            table[k].update({f: v for f, v in (("a", a), ("b", b)) if f in fields})
    return {(k, v["a"], v["b"]) for k, v in table.items()}


def feed(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        op = r.choice(["I", "insert", " u", "Update", "U", "u", "D", "delete"])
        named = r.choice([None, "a", "b", "a, b"]) if op.strip()[0] in "uU" else None
        rows.append((r.randint(1, 3), i, op, f"k{r.randint(0, 25) if r.random() < 0.6 else 0}", r.choice([None, "x", "y", "z"]), r.choice([None, 1, 2]), named))
    rows += r.choices(rows, k=80)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_replay_in_any_order_and_with_repeats(spark, seed):
    rows = feed(seed)
    got = {tuple(r) for r in apply_changes(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert got == replay(rows)


def test_state_and_later_changes_give_the_same_as_all_at_once(spark):
    rows = feed(3)
    first, rest = spark.createDataFrame(rows[:200], SCHEMA), spark.createDataFrame(rows[200:], SCHEMA)
    state = fold_changes(rest, SPEC, fold_changes(first, SPEC))
    assert {tuple(r) for r in live_rows(state, SPEC).collect()} == replay(rows)


def test_late_change_older_than_a_delete_stays_without_effect(spark):
    state = fold_changes(spark.createDataFrame([(1, 1, "i", "k", "x", 1, None), (1, 9, "d", "k", None, None, None)], SCHEMA), SPEC)
    late = spark.createDataFrame([(1, 5, "u", "k", "y", 2, None), (1, 4, "i", "k", "z", 3, None)], SCHEMA)
    assert live_rows(fold_changes(late, SPEC, state), SPEC).collect() == []


def test_edges(spark):
    rows = [(1, 1, "i", None, "x", 1, None), (None, 1, "i", "p", "x", 1, None), (1, 2, "?", "q", "x", 1, None), (1, 3, None, "r", "x", 1, None), (1, 4, "i", "s", None, None, None), (1, 5, "i", "", "long" * 50_000, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'extra' as live", "1 as p0", "2 as __life2")
    assert {(r["k"], len(r["a"] or ""), r["b"]) for r in apply_changes(df, SPEC).collect()} == {("s", 0, None), ("", 200_000, 1)}
    assert apply_changes(spark.createDataFrame([], SCHEMA), SPEC).collect() == []
    conflict = spark.createDataFrame([(1, 1, "i", "k", "x", 1, None), (1, 1, "i", "k", "y", 1, None)], SCHEMA)
    assert [r["a"] for r in apply_changes(conflict, SPEC).collect()] == ["y"]

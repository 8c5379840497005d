"""Matching on small tables with known answers; the assignment kernel against brute force."""

import itertools
import random

import numpy as np
import pytest

from kinfold.functions.kernels import hungarian
from kinfold.llm import matching as M
from kinfold.session import Scratch

SCHEMA = "record_key string, label_value string, date_value string, group_value string, cid string, conf int"


def match(spark, a, b):
    rows = lambda x: spark.createDataFrame([(*r, "other", 1) for r in x], SCHEMA)
    return {(r[0], r[1]): r[2] for r in M.match_sources(rows(a), rows(b), Scratch(spark, "t"), spark).collect()}


def test_words_dates_groups():
    assert M.label_words("  ＡLPHA/Beta GmbH ") == ["alpha", "beta"]
    assert M.label_words("Grymüm Vendvørk") == M.label_words("vendvoerk grymuem")
    assert M.label_words("realrnsiol 0ak") == M.label_words("realmsiol oak")
    assert M.label_words(None) == [] == M.label_words(" \t")
    assert [M.day_number(x) for x in ("2001-02-03", "03/02/2001", "20010203", "03-Feb-2001", "2001-02-30", None, "x")] == ["20010203"] * 4 + [""] * 3
    assert M.group_code(" Grp LO 0445 ") == "LO0445" == M.group_code("LO0445") and M.group_code(" ") == ""
    assert M.word_similarity("pusbaim", "pusbami") == pytest.approx(1 - 1 / 7)


def test_finds_noisy_pairs_and_keeps_unlike_apart(spark):
    a = [("a1", "pusbaim flirkour daimbensher e.V.", "1951-04-03", "grp-VE-3409"), ("a2", "laxshear washintrilm", "1993-02-25", "grp-TR-2233"), ("a3", "triosear kisthork Guild", "1979-03-17", "grp-ZA-3928"),
         ("a4", None, "2008-03-27", "grp-TR-0037"), ("a5", None, None, None), (None, "laxshear washintrilm", "1993-02-25", "grp-TR-2233"), ("a6", "windbuthoum seanal", "1970-01-01", "grp-LO-0001"), ("a7", "windbuthoum seanal", "1970-01-01", "grp-LO-0001")]
    b = [("b1", "pusbami, flirkour, daimbensher", "1951-04-03", "VE3409"), ("b2", "washintrilm laxshear", "25/02/1993", "grp_TR_2233"), ("b2", "washintrilm laxshear", "25/02/1993", "grp_TR_2233"), ("b3", "triosear kisthork Guild", "1954-09-29", "grp-ZA-3928"),
         ("b4", "thiolsbul triottokdos", "2008-03-27", "grp-TR-0037"), ("b5", "", "", ""), ("b6", "windbuthoum seanal", "1970-01-01", "grp-LO-0001")]
    got = match(spark, a, b)
    assert set(got) == {("a1", "b1"), ("a2", "b2"), ("a4", "b4"), ("a6", "b6"), ("a7", "b6")}
    assert all(0.5 <= c <= 1 for c in got.values())
    assert match(spark, a, []) == {} == match(spark, [], [])


def test_windows_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4))
    rows = []
    for i in range(400):
        label, day, code = f"{word()} {word()}", f"19{r.randint(30, 99)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}", f"QU{r.randint(0, 50):04d}"
        rows += [(2 * i, label, day, code), (2 * i + 1, label[:-1] + "x", day, code)]
    classes = spark.createDataFrame(rows, "cid long, label string, day string, code string")
    runs = [{tuple(x) for x in M.sorted_neighbours(classes, len(rows), Scratch(spark, "t"), M.Scorer({}, {}), window=5, rows_per_partition=n).collect()} for n in (100_000, 400, 60)]
    assert runs[0] == runs[1] == runs[2] and len({(2 * i, 2 * i + 1) for i in range(400)} & {x[:2] for x in runs[0]}) == 400


def test_hungarian_is_best():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 4), (5, 2), (4, 4)):
        gain = np.where(r.random((n, m)) < 0.7, r.random((n, m)), 0.0)
        got = sum(gain[i, j] for i, j in hungarian(gain))
        size = max(n, m)
        full = np.zeros((size, size))
        full[:n, :m] = gain
        assert got == pytest.approx(max(sum(full[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size))))


def best_total(edges):
    rows, columns = sorted({a for a, _ in edges}), sorted({b for _, b in edges})
    gain = np.zeros((len(rows), len(columns)))
    for (a, b), c in edges.items():
        gain[rows.index(a), columns.index(b)] = c
    return sum(gain[x] for x in hungarian(gain))


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_assignment_has_greatest_total(spark, monkeypatch, rounds):
    monkeypatch.setattr(M, "CERTAIN_ROUNDS", rounds)
    r = random.Random(2)
    edges = {(r.randint(0, 30), 100 + r.randint(0, 30)): round(r.random() ** 3, 2) + .01 for _ in range(90)}
    edges |= {(a + 100, b + 100): .5 + .5 * r.random() for a, b in list(edges)[:40]}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "ea long, eb long, conf double")
    out = M.assign_one_to_one(df, Scratch(spark, "t")).collect()
    assert len({x["ea"] for x in out}) == len(out) == len({x["eb"] for x in out})
    assert all(edges[x["ea"], x["eb"]] == x["conf"] for x in out)
    assert sum(x["conf"] for x in out) == pytest.approx(best_total(edges))


def test_certain_edges_leave_contests_open(spark):
    # the best edge blocks two that together weigh more
    df = spark.createDataFrame([(1, 1, .90), (1, 2, .89), (2, 1, .89), (3, 2, .5), (7, 7, .9), (7, 8, .5), (8, 7, .3), (9, 9, .4), (9, 10, .4)], "ea long, eb long, conf double")
    assert M.certain_edges(df).collect() == [(7, 7, .9)]
    got = M.assign_one_to_one(df, Scratch(spark, "t")).collect()
    assert {(r["ea"], r["eb"]) for r in got} >= {(1, 2), (2, 1), (7, 7)} and len(got) == 4
    assert M.assign_one_to_one(df.limit(0), Scratch(spark, "t")).collect() == []


def test_borders_reach_over_short_partitions():
    assert M._borders([(0, 9), (1, 2), (4, 1), (5, 9)], 5) == [
        (1, 1, True, 0), (0, 1, False, -9), (4, 4, True, 0), (1, 4, False, -2), (0, 4, False, -11), (5, 5, True, 0), (4, 5, False, -1), (1, 5, False, -3), (0, 5, False, -12)]
    assert M._borders([], 5) == [] == M._borders([(3, 4)], 5)


def test_one_field_is_compared_too(spark):
    got = match(spark, [("a1", "pusbaim flirkour", None, None), ("a2", "lone", "", " ")], [("b1", "flirkour pusbaim", "", None), ("b2", None, "1990-01-01", None), ("b3", "lone", None, None)])
    assert set(got) == {("a1", "b1")}  # one word alone is too little


def test_edits_against_a_table():
    def table(a, b):
        before, row = [], list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            older, before, row = before, row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    row[-1] = min(row[-1], older[j - 2] + 1)
        return row[-1]

    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(120)]
    assert all(M.edits(a, b) == table(a, b) for a in words for b in words)


def test_weights_of_frequent_values(spark):
    rows = [("d", f"{1950 + i % 50}{1 + i % 12:02d}{1 + i % 28:02d}", f"c{i}") for i in range(2000)] + [("d", "19000101", "big")] * 200
    df = spark.createDataFrame(rows, "label string, day string, code string")
    assert M.frequent_days(df) == {"19000101": 0.0} and M.frequent_codes(df) == {"big": 200 / 2200}
    assert M.frequent_days(df.limit(0)) == {} == M.frequent_codes(df.limit(0))
    one = ("alpha beta", "19000101", "")
    assert M.confidence(one, one, {"19000101": 0.0}) < .6 < .99 < M.confidence(one, one)
    assert M.confidence(("", "", "x"), ("", "", "x")) < .1

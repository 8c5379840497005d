"""Personal information: held-out generated text, written-out cases, redaction and edges."""

import re

import numpy as np
import pytest

from kinfold.llm import pii
from kinfold.llm.boosting import BoostedTrees
from kinfold.llm.pii_train import Maker
from tests.llm.pii_lines import LINES

GIVEN, FAMILY = frozenset(["jade"]), frozenset(["stone"])


def found(text):
    spans = pii.find_spans([text], GIVEN, FAMILY, pii.load_model())[0]
    return [(pii.KINDS[k], text[s:e]) for s, e, k in spans]


def test_lines_written_by_hand():
    """Measured on text that is neither from the generator nor from a corpus."""
    hit = wrong = missed = 0
    for line in LINES:
        text, truth = "", set()
        for part in re.split(r"(<<[A-Z_]+\|.*?>>)", line):
            kind, _, inner = part[2:-2].partition("|") if part.startswith("<<") else ("", "", part)
            if kind:
                truth.add((kind, len(text), len(text) + len(inner)))
            text += inner
        got = {(pii.KINDS[k], s, e) for s, e, k in pii.find_spans([text], frozenset(["laura", "sarah"]), frozenset(["bennett", "torres"]), pii.load_model())[0]}
        hit, wrong, missed = hit + len(got & truth), wrong + len(got - truth), missed + len(truth - got)
        if got != truth:
            print(text, "found", sorted(x + (text[x[1]:x[2]],) for x in got - truth), "missed", sorted(x + (text[x[1]:x[2]],) for x in truth - got))
    print("recall", hit / (hit + missed), "precision", hit / (hit + wrong))
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.8


def test_held_out_text():
    maker = Maker(987)
    hit = wrong = missed = 0
    for _ in range(150):
        text, truth = maker.text()
        got = set(pii.find_spans([text], maker.known_given, maker.known_family, pii.load_model())[0])
        hit, wrong, missed = hit + len(got & truth), wrong + len(got - truth), missed + len(truth - got)
    assert hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.98


CASES = [
    ("// Signed-off-by: Jade Stone <jade.stone@skorsand.example.com>\n", [("NAME", "Jade Stone"), ("EMAIL", "jade.stone@skorsand.example.com")]),
    ("# mail jade+x [at] jaibask [dot] example first\n", [("EMAIL", "jade+x [at] jaibask [dot] example")]),
    ("git clone git@host.example:a/b.git\n# https://user:word@proxy.host.test/1\n// needs thing@3.9.2\nroot@localhost has no mailbox\n", []),
    ("* tel +44 (0)20 7946 0764 if the job hangs\n", [("PHONE", "+44 (0)20 7946 0764")]),
    ("call 555.0178 x93 (desk)\n", [("PHONE", "555.0178 x93")]),
    ("// build 3237-46-7250 of thing\n# crc 9354209323 over 7 blocks\n", []),
    ("customer Stone, Jade (NI number: QQ 93 63 53 B) gets a duplicate\n", [("NAME", "Stone, Jade"), ("ID_NUMBER", "QQ 93 63 53 B")]),
    ("// office: 124 Laildresk Road\n// Kurkmun QX9 7ZZ\n", [("ADDRESS", "124 Laildresk Road\n// Kurkmun QX9 7ZZ")]),
    ("# Anschrift: Thiotbrokstr. 120a, 01009 Shuklerksio\n", [("ADDRESS", "Thiotbrokstr. 120a, 01009 Shuklerksio")]),
    ("Copyright (c) 2019 the Zilzirksiot contributors\n", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert found(text) == want


def test_code_points_and_redaction():
    text = "🧪 ask Jade Stone\nmail jade@skorsand.example.com\nrest 🧪"
    spans = pii.find_spans([text], GIVEN, FAMILY, pii.load_model())[0]
    assert pii.redact(text, spans) == "🧪 ask [NAME]\nmail [EMAIL]\nrest 🧪"


def test_tables(spark):
    long = "x = 1;\n" * 60_000 + "// ask Jade Stone\n"
    rows = [(1, None), (2, ""), (3, "// ask Jade Stone\n"), (3, "// ask Jade Stone\n"), (4, long), (None, "// tel 07700 900 816\n")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, start_pos int, pii_kind string")
    got = sorted([tuple(r) for r in pii.personal_spans(df, GIVEN, FAMILY).collect()], key=str)
    assert got == sorted([(3, "NAME", 7, 17), (3, "NAME", 7, 17), (4, "NAME", 420_007, 420_017), (None, "PHONE", 7, 20)], key=str)
    out = [(r["doc_id"], r["text"], r["n_redacted"]) for r in pii.redacted(df, GIVEN, FAMILY).collect()]
    assert out[:3] == [(1, None, 0), (2, "", 0), (3, "// ask [NAME]\n", 1)] and out[4][1].endswith("// ask [NAME]\n")
    assert pii.personal_spans(df.limit(0), GIVEN, FAMILY).collect() == []


def test_trees_learn_and_survive_json():
    r = np.random.default_rng(0)
    x = r.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees.fit(x[:600], y[:600])
    assert ((model.probabilities(x[600:]) > 0.5) == y[600:]).mean() > 0.95
    again = BoostedTrees.from_json(model.to_json())
    assert np.allclose(again.margins(x), model.margins(x), atol=1e-2)

"""Personal information in free text: candidate spans, boosted trees that judge them, redaction.

Generators propose spans with high recall, several for one place where its extent is open.  For
each kind, boosted trees judge a candidate by its format and by what stands around it; their
probabilities are calibrated on held-out text and only spans above the kind's threshold stay.
Where kept spans overlap, the more probable one wins.

The model file holds trees, calibration and thresholds; ``pii_train`` makes it from generated text.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from kinfold.llm.boosting import BoostedTrees

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
MODEL_FILE = Path(__file__).with_name("pii_model.json")

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_WORD = rf"[{_UP}](?:['’][{_UP}])?[^\W\d_]+(?:['’][^\W\d_]+)?"
_PARTICLES = "van der|van den|van|von der|von|de la|de|der|den|af|av|di|da|del|du|ten|ter"
_PARTICLE = rf"(?:(?:{_PARTICLES}|{_PARTICLES.upper()}) )"
_AT = r"(?:@|%40|&#64;|&#x40;|&commat;|\\u0040|\\x40| ?[\[({<](?:at|AT|@)[\])}>] ?| (?:AT|at) )"
_DOT = r"(?:\.|%2E|&#46;|\\u002[eE]|\\x2[eE]| ?[\[({<](?:dot|DOT|\.)[\])}>] ?| (?:DOT|dot) )"
_LEADER = r"[ \t]*(?:(?://+|#+|\*+|--+|/\*+|;+|%+|-)[ \t]*)?"

#: How an at-sign is written; what stands around it is read from there.
_AT_SIGNS = ("@", "%40", "&#64;", "&#x40;", "&commat;", "\\u0040", "\\x40", "at]", "AT]", "at)", "AT)", "at>", "AT>", "at}", "AT}", "@]", " AT ", " at ")
_LOCAL = re.compile(r"[\w][\w.+\-]*\Z")
_AT_HERE = re.compile(rf"{_AT}(?P<host>[\w\-]+(?:{_DOT}[\w\-]+)*)")
# Generators in two steps: a start that can be searched for quickly (it begins with a plain set of
# characters), then the whole form from there.
_PHONE_START = re.compile(r"[+(\d](?<![\w.#/:\-+][+(\d])(?=[\d ()./\-+]{7})")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{1,13}(?:[ ./\-]\d{2,8}){0,6}(?:(?: ?x ?| ?[eE]xt\.? ?)\d{1,5})?(?![\w\-/]|\.\d)")
_ID_START = re.compile(r"[A-Z\d](?<![\w.\-/+][A-Z\d])(?=[A-Z\d\- +.]{7})")
_IDS = re.compile(
    r"(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{2} \d{3} \d{3} \d{3}|\d{4} \d{4} \d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}|\d{9}|\d{8}[A-Z]|[A-Z]{1,2}\d{6,9}"
    r"|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[A-Z]{4,5}\d{5,8}[A-Z]{1,3}\d{0,2}[A-Z]{0,3}|\d{6}[-+]\d{4}|[A-Z]{2}\d{4}-\d{5}-[A-Z]|[A-Z]{1,5}-\d{4,8}|\d{2,4}-\d{2,3}-\d{4})(?![\w\-/+]|\.\d| \d{4})")
_STREET_WORDS = r"(?:(?:Road|Street|Avenue|Lane|Close|Row|Way|Drive|Boulevard|Court|Square|Terrace|Place)\b|(?:Ave|Blvd|Rd|St|Dr)\b\.?)(?: (?:NW|NE|SW|SE|N|S|E|W)\b)?"
_NUMBER_STREET = (
    rf"(?:\d{{1,5}}[a-zA-Z]? (?:{_WORD} ){{1,2}}(?:{_STREET_WORDS})"
    rf"|\d{{1,5}}(?: (?:bis|ter))? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)(?: (?:de la|de|du|des|la|le))? {_WORD}(?:[ -]{_WORD}){{0,2}})")
_NUMBER_START = re.compile(rf"\d(?<![\w.]\d)\d{{0,4}}(?:[a-zA-Z]? (?=[{_UP}])|(?: (?:bis|ter))? (?=rue|ave|bou|pla|che|imp|all|qua))")
_NAMED_STREET = (
    rf"(?:[{_UP}][^\W\d_]+(?:straße|strasse|str\.|gasse|weg|platz|allee|vägen|gatan|gata|väg|laan|straat|STRASSE|VÄGEN) \d{{1,4}}[a-zA-Z]?"
    r"|(?:P\.? ?O\.? ?Box|Postfach|BP) \d{1,6})")
_NAMED_START = re.compile(rf"[{_UP}](?<![\w.][{_UP}])(?:\.? ?O\.? ?Box|[^\W\d_]+\.?) (?=\d)")
_UNIT = r"(?:, (?:Apt|Unit|Flat|Suite|Apartment|Floor)\.? \d{1,5}[a-zA-Z]?)"
_POSTCODE = r"(?:\d{4,5}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5})"
_TOWN = rf"(?:{_POSTCODE} )?{_WORD}(?:[ -]{_WORD})?"
_REST = (
    rf"(?P<unit>{_UNIT})?"
    rf"(?:(?P<state>, {_WORD}(?:[ -]{_WORD}){{0,2}}, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?)|(?P<town>, (?:{_TOWN} {_POSTCODE}|{_POSTCODE} {_WORD}(?:[ -]{_WORD})?|(?P<short>{_WORD})(?:[ -]{_WORD})?))|(?P<line>,?[ \t]*\r?\n{_LEADER}(?:{_WORD}(?: {_WORD})? {_POSTCODE}|{_POSTCODE} {_WORD})))?(?![\w])")
_NUMBER_ADDRESS = re.compile(rf"(?P<street>{_NUMBER_STREET}){_REST}")
_NAMED_ADDRESS = re.compile(rf"(?P<street>{_NAMED_STREET}){_REST}")
_TITLE = r"(?!(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sir|Dear)\b)"
_HY = rf"{_WORD}(?:-{_WORD})?"
_NAME_START = re.compile(rf"[{_UP}](?<![\w@.\-/\\$][{_UP}])(?:\. ?|(?:['’][^\W\d_])?[^\W\d_]+(?:['’-][^\W\d_]+)*,? )(?=[{_UP}]|{_PARTICLE})")
_PARTICLE_START = re.compile(rf" (?=(?:{_PARTICLES}) {_WORD}(?:-{_WORD})?, [{_UP}])")
_NAME = re.compile(
    rf"(?:{_TITLE}(?:[{_UP}]\. (?:[{_UP}]\. )?{_PARTICLE}?{_HY}|{_HY},? (?:[{_UP}]\.? )?{_PARTICLE}?{_HY})|{_PARTICLE}{_HY}, {_HY})(?![\w@])")

_NAME_CUES = ("author", "autor", "signed-off-by", "written by", "maintainer", "original version by", "reviewed with", "reported by", "suggested by", "thanks to", "patch from", "gemeldet von", "ask", "owner", "todo(", "fixme(", "customer", "client", "user", "fullname", "name", "contact", "copyright", "meeting with", "spoke to", "reach", "i am", "this is", "mr", "mrs", "dr.", "prof", "herr", "frau", "mme", "by", "from", "to", "for", "with")
_PHONE_CUES = ("tel", "phone", "call", "pager", "mobile", "desk", "fax", "ring")
_ID_CUES = ("ssn", "social", "nino", "ni number", "tax", "steuer", "passport", "licence", "license", "driving", "personnummer", "national", "staff", "employee", "personnel", "identity", "itin", "cpf", "aadhaar", "codice", "pesel", "bsn", "cpr", "id ")
_ADDRESS_CUES = ("address", "office", "anschrift", "adresse", "post", "ship", "deliver", "lives", "moved", "at ", "to ", ";", '"')
_CODE_CUES = ("build", "crc", "fraction", "range", "ticket", "chunk", "table", "version", "needs", "import", "listening", "git clone", "://", "insert", "alter", "select", "update", "0x", "generated", "schema", "class", "public", "func", "on 2", "iban", "account", "card", "isbn", "uuid", "range", "rows", "issue", "serial", "checksum")
_GROUP_WORDS = ("contributors", "authors", "team", "project", "foundation", "inc", "ltd", "gmbh", "labs", "group", "licence", "license", "developers", "community", "corporation", "consortium", "university", "institute", "maintainers")


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int


def _emails(text: str):
    for sign in _AT_SIGNS:
        at = text.find(sign)
        while at >= 0:
            # " [at] " and " (at) " are found by their inner part
            begin = at
            if sign[0] in "aA@" and len(sign) > 1:
                begin -= 1
                if begin > 0 and text[begin - 1] == " ":
                    begin -= 1
            local = _LOCAL.search(text, max(0, begin - 80), begin) if begin > 0 else None
            rest = _AT_HERE.match(text, begin) if local else None
            if rest:
                end = rest.end()
                while text[end - 1] in ".-":
                    end -= 1
                if local.start() == 0 or text[local.start() - 1] not in "+-.":
                    yield local.start(), end
            at = text.find(sign, at + len(sign))


def candidates(text: str) -> list[Candidate]:
    """Spans that could be personal information, also overlapping ones, over the whole text."""
    out = [Candidate(0, start, end) for start, end in sorted(set(_emails(text)))]
    at = 0
    while s := _PHONE_START.search(text, at):
        at = s.end()
        m = _PHONE.match(text, s.start())
        if m and 7 <= sum(map(str.isdigit, m[0])) <= 17:
            out.append(Candidate(1, m.start(), m.end()))
            at = m.end()
    for s in _ID_START.finditer(text):
        if m := _IDS.match(text, s.start()):
            out.append(Candidate(2, m.start(), m.end()))
    for starts, form in ((_NUMBER_START, _NUMBER_ADDRESS), (_NAMED_START, _NAMED_ADDRESS)):
        for s in starts.finditer(text):
            if m := form.match(text, s.start()):
                ends = {m.end("street"), m.end("unit"), m.end("state"), m.end("town"), m.end("short"), m.end("line")} - {-1}
                if m["street"][-1] == ".":
                    ends.add(m.end("street") - 1)
                out += [Candidate(3, m.start(), e) for e in sorted(ends)]
    at = 0
    while s := _NAME_START.search(text, at):
        if m := _NAME.match(text, s.start()):
            out.append(Candidate(4, m.start(), m.end()))
        # on to the next word, which may begin a name that overlaps this one
        at = s.end()
    for s in _PARTICLE_START.finditer(text):
        if m := _NAME.match(text, s.end()):
            out.append(Candidate(4, m.start(), m.end()))
    return out


def _near(cues: tuple[str, ...], text: str) -> float:
    """1 / (1 + words between) for the cue nearest to the end of ``text``; 0 if there is none."""
    best = 0.0
    for cue in cues:
        at = text.rfind(cue)
        if at >= 0:
            best = max(best, 1.0 / (1 + text.count(" ", at + len(cue.strip()))))
    return best


def _kind_of(c: str) -> float:
    if not c:
        return 0.0
    if c in "\r\n":
        return 1.0
    if c == " ":
        return 2.0
    if c in "\"'":
        return 3.0
    if c in "<([{":
        return 4.0
    if c in ">)]}":
        return 5.0
    if c in ",;":
        return 6.0
    if c == ":":
        return 7.0
    if c == ".":
        return 8.0
    if c in "/=@":
        return 9.0
    return 10.0 if c.isalnum() else 11.0


def features(text: str, c: Candidate, given: frozenset, family: frozenset) -> list[float]:
    """Format and context of a candidate; the same columns for every kind."""
    span = text[c.start:c.end]
    line_start = max(text.rfind("\n", 0, c.start), text.rfind("\r", 0, c.start)) + 1
    before = text[max(line_start, c.start - 60):c.start]
    after = text[c.end:c.end + 24].split("\n")[0]
    low, low_after = before.lower(), after.lower()
    groups = re.findall(r"\d+", span)
    sizes = [len(g) for g in groups][:6] + [0] * 6
    digits = sum(map(len, groups))
    letters = sum(ch.isalpha() for ch in span)
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", span)
    plain = [w for part in words for w in part.split("-")]
    names = [w.casefold() for w in plain if w[:1].isupper()]
    row = [
        float(len(span)), float(digits), float(letters), float(len(groups)), *map(float, sizes[:5]),
        float("-" in span), float(" " in span), float("." in span), float("/" in span), float("(" in span), float(span[0] == "+"), float(span[0] == "0"),
        float(span.isupper()), float("," in span), float("\n" in span), float(bool(re.search(r"\bx|ext", span))),
        _kind_of(text[c.start - 1:c.start]), _kind_of(text[c.end:c.end + 1]), _kind_of(text[c.end + 1:c.end + 2]),
        _near(_NAME_CUES, low), _near(_PHONE_CUES, low), _near(_ID_CUES, low), _near(_ADDRESS_CUES, low), _near(_CODE_CUES, low),
        float(any(g in low_after[:16] or g in span.lower() for g in _GROUP_WORDS)), float("://" in before), float(low.rstrip().endswith("the")),
    ]
    if c.kind == 0:
        host = re.split(_AT, span, maxsplit=1)[-1]
        row += [float(bool(re.search(r"[^\W\d_]{2,}$", host))), float(len(re.findall(_DOT, host))), float(bool(re.fullmatch(r"[\d.]+", host))),
                float(text[c.end:c.end + 1] == ":" and text[c.end + 1:c.end + 2].strip() != ""), float(bool(re.search(r"[/:][^\s@]*$", before)) and "mailto:" not in before[-8:]), float("@" in span)]
    elif c.kind == 3:
        following = text[c.end:c.end + 60]
        row += [float(bool(re.match(rf"(?:{_UNIT}|, {_WORD}|, \d{{4,5}} [{_UP}])", following))), float(bool(re.match(rf",?[ \t]*\r?\n{_LEADER}(?:{_WORD}(?: {_WORD})? {_POSTCODE}\b|{_POSTCODE} {_WORD})", following))),
                float(bool(re.search(rf"{_POSTCODE}", span[8:]))), float(span[:1] == "P"), float(span.count(",")), 0.0]
    elif c.kind == 4:
        first = names[0] if names else ""
        last = names[-1] if names else ""
        row += [float(any(n in given for n in names)), float(any(n in family for n in names)), float(first in given) + float(last in family),
                float(first in family) + float(last in given), float(bool(re.match(r".\.", span))), float(bool(re.search(r"\b(?:SELECT|FROM|TABLE|INTO|VALUES|ADD|COLUMN|WHERE|ALTER|INSERT|DO|NOT|EDIT|BEGIN|END|KEY|PRIVATE|PUBLIC|SET|INTEGER|PRIMARY|CREATE)\b", span)))]
    else:
        row += [float(sum(map(ord, re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", span)))) % 97), float(letters > 0), float(span[-1:].isalpha()), float(span[:1].isalpha()), 0.0, 0.0]
    # how the line begins: a bare line, a comment or code
    row += [float(len(before)), float(bool(re.match(r"\s*(?:/[/*]|#|\*|--|-|\"|$)", text[line_start:line_start + 12]))), float(len(words)), float(min((len(w) for w in plain), default=0))]
    # what follows: a number, a dash rule, a word in lower case, or a verb in the third person
    row += [float(bool(re.match(r" v?\d", after))), float(after.startswith("---") or before.endswith("---")), float(bool(re.match(r" [a-z]", after))), float(bool(re.match(r" (?:wrote|said|asked|will|joined|left|has|is|was|lives|moved|works)\b|: ", after))),
            float(bool(re.search(r"(?:^|[.!?] )$", before.lstrip("/#*-;<! \t\"'")))), float(bool(re.search(r"(?:\d[ -]?){4}$", before))), float(bool(re.match(r"[ -]?\d", after))),
            float(bool(re.search(r"(?:©|\(c\)|copyright)[ ,\d\-]*$", low)))]
    return row


@dataclass(frozen=True)
class Model:
    trees: tuple[BoostedTrees, ...]
    slopes: tuple[tuple[float, float], ...]
    thresholds: tuple[float, ...]

    def probabilities(self, kind: int, x: np.ndarray) -> np.ndarray:
        a, b = self.slopes[kind]
        return 1.0 / (1.0 + np.exp(-(a * self.trees[kind].margins(x) + b)))


@lru_cache(maxsize=2)
def load_model(path: str = str(MODEL_FILE)) -> Model:
    data = json.loads(Path(path).read_text())
    return Model(tuple(BoostedTrees.from_json(data[k]["trees"]) for k in KINDS), tuple(tuple(data[k]["slope"]) for k in KINDS), tuple(data[k]["threshold"] for k in KINDS))


def find_spans(texts: list[str | None], given: frozenset, family: frozenset, model: Model) -> list[list[tuple[int, int, int]]]:
    """Per text the kept (start, end, kind), in order of position and without overlaps."""
    per_kind: list[list[tuple[int, Candidate]]] = [[] for _ in KINDS]
    for i, text in enumerate(texts):
        for c in candidates(text or ""):
            per_kind[c.kind].append((i, c))
    kept: list[list[tuple[float, Candidate]]] = [[] for _ in texts]
    for kind, found in enumerate(per_kind):
        if not found:
            continue
        x = np.array([features(texts[i], c, given, family) for i, c in found])
        for (i, c), p in zip(found, model.probabilities(kind, x)):
            if p >= model.thresholds[kind]:
                kept[i].append((p, c))
    out = []
    for spans in kept:
        # kept spans lie apart, so only the neighbours in order of position can overlap a further one
        chosen: list[tuple[int, int, int]] = []
        for _, c in sorted(spans, key=lambda s: (-round(s[0], 3), s[1].start - s[1].end, s[1].start, s[1].kind)):
            at = bisect_left(chosen, (c.start,))
            if (at == len(chosen) or c.end <= chosen[at][0]) and (at == 0 or chosen[at - 1][1] <= c.start):
                chosen.insert(at, (c.start, c.end, c.kind))
        out.append(chosen)
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; the rest is untouched."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def name_lists(parts) -> tuple[frozenset, frozenset]:
    """Given and family names, case-folded, from (name_part, part_kind) rows."""
    rows = [(r[0].casefold(), r[1]) for r in parts if r[0]]
    return frozenset(n for n, k in rows if k == "given"), frozenset(n for n, k in rows if k == "family")


TEXTS_PER_ROUND = 256


def _rounds(batch):
    ids, texts = batch.column("doc_id"), batch.column("text")
    for at in range(0, batch.num_rows, TEXTS_PER_ROUND):
        yield ids.slice(at, TEXTS_PER_ROUND), texts.slice(at, TEXTS_PER_ROUND).to_pylist()


def personal_spans(documents: DataFrame, given: frozenset, family: frozenset, model_path: str = str(MODEL_FILE)) -> DataFrame:
    """(doc_id, pii_kind, start_pos, end_pos): code-point positions, the end exclusive.

    Null and empty texts have no rows; a repeated row gives its spans again; whole texts are
    searched, whatever their length.  The name lists are a fixed vocabulary of a few hundred words.
    """
    def run(batches):
        import pyarrow as pa

        model = load_model(model_path)
        for batch in batches:
            for ids, texts in _rounds(batch):
                at, kinds, starts, ends = [], [], [], []
                for i, spans in enumerate(find_spans(texts, given, family, model)):
                    for start, end, kind in spans:
                        at.append(i)
                        kinds.append(KINDS[kind])
                        starts.append(start)
                        ends.append(end)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    names=["doc_id", "pii_kind", "start_pos", "end_pos"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pii_kind string, start_pos int, end_pos int")


def redacted(documents: DataFrame, given: frozenset, family: frozenset, model_path: str = str(MODEL_FILE)) -> DataFrame:
    """(doc_id, text, n_redacted): every text with placeholders; a null text stays null."""
    def run(batches):
        import pyarrow as pa

        model = load_model(model_path)
        for batch in batches:
            for ids, texts in _rounds(batch):
                spans = find_spans(texts, given, family, model)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([None if t is None else redact(t, s) for t, s in zip(texts, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())],
                    names=["doc_id", "text", "n_redacted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_redacted int")

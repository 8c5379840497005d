"""Matching records of two sources without a common key.

Records become classes of equal normalised values, so that copies cost nothing.  The classes are
sorted by several composite keys; under each, neighbours within a sliding window are compared by
weighted field similarities.  Records of one source that are the same thing are joined first;
between the things so found, a one-to-one assignment of greatest total confidence decides.
"""

from __future__ import annotations

import datetime
import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.kernels import sparse_assignment
from kinfold.llm.components import hash_to_min
from kinfold.operators.skew import hot_keys, join_unique
from kinfold.session import Scratch

#: Neighbours compared on either side under each sort key.
WINDOW = 14
#: Least confidence of a match between the sources, and of joining two records of one source.
THRESHOLD = 0.5
INTRA_THRESHOLD = 0.9
#: Rows a sort partition should have.
ROWS_PER_PARTITION = 20_000
#: Edges of small components that a task takes in one batch.
EDGES_PER_TASK = 20_000
#: A day this many times as frequent as usual begins to count as a stand-in for an unknown date.
DAY_EXCESS = 8.0
#: Agreement on a group code of share s gives GROUP_GAIN * -ln(s), at most MOST_FROM_GROUP.
GROUP_GAIN = 0.78
MOST_FROM_GROUP = 5.0
#: Greatest log-odds from a label; what a pair must reach; least share of common letter pairs of labels that are compared word by word.
MOST_FROM_LABEL = 7.5
LEAST_ODDS = math.log(THRESHOLD / (1 - THRESHOLD))
LEAST_SHARED = 0.35
#: Log-odds that two neighbours need to overcome.
PRIOR_ODDS = 7.4

#: Forms of organisation, which say little about what a label names.
FORMS = frozenset(["gmbh", "ltd", "ev", "guild", "coop", "svc", "trust"])
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
LETTERS = str.maketrans({"ø": "o", "œ": "o", "æ": "a", "ß": "s", "ð": "d", "þ": "t", "ł": "l", "đ": "d", "ı": "i"})


@lru_cache(maxsize=200_000)
def plain_word(word: str) -> str:
    """A word without accents, with umlaut spellings and look-alike characters made equal."""
    word = unicodedata.normalize("NFKD", word.translate(LETTERS))
    word = "".join(c for c in word if not unicodedata.combining(c))
    if any(c.isalpha() for c in word):
        word = word.replace("0", "o").replace("1", "l").replace("5", "s")
    return word.replace("ue", "u").replace("oe", "o").replace("ae", "a").replace("rn", "m").replace("vv", "w")


def label_words(label: str | None) -> list[str]:
    """Sorted plain words of a label, without forms of organisation; empty if it says nothing."""
    if not label:
        return []
    text = unicodedata.normalize("NFKC", label).casefold().replace("e.v.", " ev ")
    words = [plain_word(w) for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text))]
    kept = [w for w in words if w not in FORMS]
    return sorted(kept or words)


def day_number(text: str | None) -> str:
    """yyyymmdd of the date forms in use (year-month-day, day/month/year, yyyymmdd, day-Mon-year), '' if it is none."""
    t = (text or "").strip()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", t):
        y, mo, d = m.groups()
    elif m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", t):
        d, mo, y = m.groups()
    elif m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", t):
        y, mo, d = m.groups()
    elif (m := re.fullmatch(r"(\d{1,2})-([A-Za-z]{3})-(\d{4})", t)) and m[2].lower() in MONTHS:
        d, mo, y = m[1], str(MONTHS[m[2].lower()]), m[3]
    else:
        return ""
    try:
        return datetime.date(int(y), int(mo), int(d)).strftime("%Y%m%d").zfill(8)
    except ValueError:
        return ""


def group_code(text: str | None) -> str:
    """Letters and digits of a group value without its prefix, upper case; '' if it is blank."""
    bare = re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "")).upper()
    return bare[3:] if bare.startswith("GRP") else bare


def _normalised(label: pd.Series, date: pd.Series, group: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"label": [" ".join(label_words(x)) for x in label], "day": [day_number(x) for x in date], "code": [group_code(x) for x in group]})


def edits(a: str, b: str) -> int:
    """Fewest insertions, deletions, changes and swaps of neighbours that turn ``a`` into ``b``; one word of bits a column."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down, diagonal, before = full, 0, 0, 0
    for c in b:
        here = at.get(c, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swap) & full
        more, less = (down | ~(diagonal | up)) & full, diagonal & up
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down, before = (less | ~(diagonal | more)) & full, more & diagonal, here
    return distance


@lru_cache(maxsize=500_000)
def word_similarity(a: str, b: str) -> float:
    """1 - edits / longer length; an initial fits any word it begins."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.85 if a[:1] == b[:1] else 0.0
    return 1.0 - edits(a, b) / max(len(a), len(b))


def label_similarity(a: list[str], b: list[str]) -> float | None:
    """Length-weighted similarity of the best pairing of words; words left over cost a little each."""
    if not a or not b:
        return None
    short, long = (a, list(b)) if len(a) <= len(b) else (b, list(a))
    rest, got, weight = long, 0.0, 0.0
    for word in sorted(short, key=len, reverse=True):
        best = max(range(len(rest)), key=lambda i: word_similarity(word, rest[i]))
        s = word_similarity(word, rest.pop(best))
        got += s * len(word)
        weight += len(word)
    joined = word_similarity("".join(a), "".join(b)) if len(a) != len(b) else 0.0
    return max(got / weight - 0.07 * len(rest) - (0.1 if len(short) == 1 and rest else 0), joined)


def _one_digit_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _date_evidence(one: dict, two: dict) -> np.ndarray:
    """Log-odds from two columns of days; 0 where either is unknown."""
    ya, yb, ma, mb, da, db = one["year"], two["year"], one["month"], two["month"], one["dom"], two["dom"]
    same_year, same_rest = ya == yb, (ma == mb) & (da == db)
    slip = np.isin(np.abs(ya - yb), (1, 10, 100)) | _one_digit_apart(one["digits"][:, :4], two["digits"][:, :4])
    near = ((ma == db) & (da == mb)) | _one_digit_apart(one["digits"][:, 4:], two["digits"][:, 4:])
    rest = (ma - mb) * 31 + da - db
    days = np.abs((ya - yb) * 372 + rest)
    out = np.select(
        [same_year & same_rest, same_rest & slip, same_rest, same_year & near, (days > 31) & slip & (np.abs(rest) <= 5), (days > 31) & slip, days <= 8, days <= 31],
        [7.0, 2.5, 1.5, 3.0, 0.5, -6.0, 2.5, 0.5], -6.0)
    # a day that stands for an unknown one says nothing, whether it agrees or not
    return np.where(one["has_day"] & two["has_day"], out * np.minimum(one["day_weight"], two["day_weight"]), 0.0)


def _group_evidence(one: dict, two: dict) -> np.ndarray:
    """Log-odds from two columns of group codes; 0 where either is blank."""
    same, tail = one["code_id"] == two["code_id"], one["tail_id"] == two["tail_id"]
    short = (one["code_len"] == 4) | (two["code_len"] == 4)
    out = np.select([same, tail & short, tail], [one["code_gain"], 3.0, 0.5], -2.5)
    k = np.flatnonzero(~same & ~tail & (one["code_len"] == two["code_len"]))
    out[k[_one_digit_apart(one["chars"][k], two["chars"][k])]] = 0.5
    return np.where((one["code_len"] > 0) & (two["code_len"] > 0), out, 0.0)


def _label_evidence(a: str, b: str) -> float:
    one, two = a.split(), b.split()
    s = label_similarity(one, two)
    if s < 0.6:
        return -MOST_FROM_LABEL
    return min(MOST_FROM_LABEL, 0.5 + 22.0 * (s - 0.6)) - (2.0 if min(len(one), len(two)) == 1 else 0.0)


class Scorer:
    """Confidence of pairs of (label, day, code) rows, column by column.

    The weights of all fields add up on the log-odds scale.  Since a label gives at most
    MOST_FROM_LABEL, pairs whose other fields fall short of the threshold by more are given up
    before their labels are compared; this changes no result.  ``days`` holds the weights of days
    that are too frequent to be true, ``codes`` the shares of frequent group codes; both bounded.
    """

    def __init__(self, days: dict[str, float], codes: dict[str, float]):
        self.days, self.codes = days, codes

    def columns(self, label: np.ndarray, day: np.ndarray, code: np.ndarray) -> dict:
        """What comparisons need of each row."""
        n = len(label)
        has_day = day != ""
        digits = np.frombuffer("".join(np.where(has_day, day, "00000000")).encode("ascii"), np.uint8).reshape(n, 8).astype(np.int16) - 48
        codes, code_id = np.unique(code.astype(str), return_inverse=True)
        gains = np.array([min(MOST_FROM_GROUP, -GROUP_GAIN * math.log(self.codes.get(c, 1e-9))) for c in codes])
        _, tail_id = np.unique(np.array([c[-4:] for c in codes], str), return_inverse=True)
        lengths = np.array([len(c) for c in codes], np.int64)
        # as wide as the longest code of the batch; the widest are compared by what they begin with and their length
        width = int(min(64, max(1, lengths.max(initial=1))))
        chars = codes.astype(f"U{width}").view(np.uint32).reshape(len(codes), width)
        weights = {d: self.days.get(d, 1.0) for d in set(day)}
        bits = _signatures(label)
        return {
            "label": label, "no_label": label == "", "bits": bits, "size": np.bitwise_count(bits).sum(axis=1).astype(np.int64), "digits": digits, "has_day": has_day,
            "year": digits[:, :4] @ np.array((1000, 100, 10, 1), np.int16), "month": digits[:, 4:6] @ np.array((10, 1), np.int16), "dom": digits[:, 6:] @ np.array((10, 1), np.int16), "day_weight": np.array([weights[d] for d in day]),
            "chars": chars[code_id], "code_id": code_id, "tail_id": tail_id[code_id], "code_len": lengths[code_id], "code_gain": gains[code_id]}

    def odds(self, columns: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Log-odds that rows ``i`` and ``j`` are the same thing; -inf where they cannot reach the threshold."""
        pick = lambda at, names: {c: columns[c][at] for c in names}
        dates = ("digits", "has_day", "year", "month", "dom", "day_weight")
        groups = ("chars", "code_id", "tail_id", "code_len", "code_gain")
        base = _date_evidence(pick(i, dates), pick(j, dates)) - PRIOR_ODDS
        left = np.flatnonzero(base + MOST_FROM_GROUP + MOST_FROM_LABEL >= LEAST_ODDS)
        base[base + MOST_FROM_GROUP + MOST_FROM_LABEL < LEAST_ODDS] = -np.inf
        base[left] += _group_evidence(pick(i[left], groups), pick(j[left], groups))
        none = columns["no_label"][i] | columns["no_label"][j]
        out = np.where(none, base, -np.inf)
        open_ = np.flatnonzero(~none & (base + MOST_FROM_LABEL >= LEAST_ODDS))
        x, y = i[open_], j[open_]
        shared = np.bitwise_count(columns["bits"][x] & columns["bits"][y]).sum(axis=1)
        alike = 2 * shared >= LEAST_SHARED * (columns["size"][x] + columns["size"][y])
        label = columns["label"]
        seen: dict = {}
        for k, a, b in zip(open_[alike], x[alike], y[alike]):
            pair = (label[a], label[b])
            if pair not in seen:
                seen[pair] = _label_evidence(*pair)
            out[k] = base[k] + seen[pair]
        return out

    def own_odds(self, columns: dict) -> np.ndarray:
        """Log-odds of each row with an equal one."""
        rows = np.arange(len(columns["label"]))
        return self.odds(columns, rows, rows)


def confidence(one: tuple[str, str, str], two: tuple[str, str, str], days: dict | None = None, codes: dict | None = None) -> float:
    """Confidence in [0, 1] that two (label, day, code) are the same thing."""
    scorer = Scorer(days or {}, codes or {})
    columns = scorer.columns(*(np.array([one[k], two[k]], object) for k in range(3)))
    return float(_confidence(scorer.odds(columns, np.array([0]), np.array([1])))[0])


def _confidence(odds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-odds))


def _signatures(label: np.ndarray) -> np.ndarray:
    """Per label 256 bits with one set per pair of neighbouring bytes, as four words."""
    raw = [x.encode() for x in label]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8).astype(np.int64)
    sizes = np.array([len(x) + 1 for x in raw])
    row = np.repeat(np.arange(len(raw)), sizes)
    inside = np.ones(len(data), bool)
    ends = np.cumsum(sizes) - 1
    inside[ends] = False
    inside[np.maximum(ends - 1, 0)] = False
    at = np.flatnonzero(inside)
    hit = np.zeros((len(raw), 256), bool)
    hit[row[at], (data[at] * 131 + data[at + 1] * 31) & 255] = True
    return np.packbits(hit, axis=1).view(np.uint64)


def _compare(rows: pd.DataFrame, window: int, scorer: Scorer) -> pd.DataFrame:
    """Scored pairs of rows up to ``window`` apart, each once with its greatest confidence."""
    n = len(rows)
    cid, sort_pass = rows["cid"].to_numpy(), rows["pass"].to_numpy()
    columns = scorer.columns(*(rows[c].to_numpy() for c in ("label", "day", "code")))
    i = np.concatenate([np.arange(n - k) for k in range(1, min(window, n - 1) + 1)] or [np.zeros(0, np.int64)])
    j = np.concatenate([np.arange(k, n) for k in range(1, min(window, n - 1) + 1)] or [np.zeros(0, np.int64)])
    return _scored(columns, cid, sort_pass, i, j, scorer)


def _scored(columns: dict, cid: np.ndarray, sort_pass: np.ndarray, i: np.ndarray, j: np.ndarray, scorer: Scorer) -> pd.DataFrame:
    fit = (sort_pass[i] == sort_pass[j]) & (cid[i] != cid[j])
    i, j = i[fit], j[fit]
    odds = scorer.odds(columns, i, j)
    good = odds >= LEAST_ODDS
    one, two = cid[i[good]], cid[j[good]]
    found = pd.DataFrame({"c1": np.minimum(one, two), "c2": np.maximum(one, two), "conf": _confidence(odds[good])})
    return found.drop_duplicates(["c1", "c2"])


NEIGHBOUR_ROW = "pass int, sort_key string, cid long, label string, day string, code string"


def sort_keys(classes: DataFrame) -> DataFrame:
    """Each class once per composite key whose leading field it has."""
    words = F.split("label", " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    reverse = F.reverse("label")
    has_label, has_day, has_code = F.col("label") != "", F.col("day") != "", F.col("code") != ""
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).getField("w")
    keys = [
        F.when(has_label, F.concat_ws("|", "label", "day", "code")),
        F.when(has_label, F.concat_ws("|", reverse, "day", "code")),
        F.when(has_day, F.concat_ws("|", "day", "label", "code")),
        F.when(has_day & has_code, F.concat_ws("|", "day", "code", "label")),
        F.when(has_code, F.concat_ws("|", "code", "label", "day")),
        F.when(has_code & has_label, F.concat_ws("|", "code", reverse, "day")),
        F.when(has_label, F.concat_ws("|", longest, F.substring("day", 1, 4), "code", "label")),
        F.when(has_label & has_day, F.concat_ws("|", first, F.substring("day", 5, 4), F.substring("day", 1, 4), last)),
    ]
    entries = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(i).alias("pass"), k.alias("sort_key"))) for i, k in enumerate(keys)]))
    return classes.select(F.explode(entries).alias("e"), "cid", "label", "day", "code").select("e.*", "cid", "label", "day", "code")


def sorted_neighbours(classes: DataFrame, n_classes: int, scratch: Scratch, scorer: Scorer, window: int = WINDOW, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(c1, c2, conf): class pairs within a window of some sort order and at or above THRESHOLD.

    Range partitions are compared by themselves.  The first and last ``window`` rows of each meet
    at the borders: every border has a task-sized group of its own, to which a row goes that lies
    less than a window before or behind it, so that the result does not depend on where partitions
    begin, however short they are.
    """
    lanes = max(1, math.ceil(8 * n_classes / rows_per_partition))
    ordered = sort_keys(classes).repartitionByRange(lanes, "pass", "sort_key", "cid").sortWithinPartitions("pass", "sort_key", "cid")
    edge_schema = "c1 long, c2 long, conf double, part int, pos int, size int, pass int, cid long, label string, day string, code string"

    def within(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = {"c1": pa.int64(), "c2": pa.int64(), "conf": pa.float64(), "part": pa.int32(), "pos": pa.int32(), "size": pa.int32(), "pass": pa.int32(),
                 "cid": pa.int64(), "label": pa.string(), "day": pa.string(), "code": pa.string()}

        def out(rows: pd.DataFrame):
            columns = [pa.array(rows[c].to_numpy(), t) if c in rows else pa.nulls(len(rows), t) for c, t in types.items()]
            return pa.RecordBatch.from_arrays(columns, names=list(types))

        part, tail, seen, head = TaskContext.get().partitionId(), None, 0, []
        for arrived in batches:
            batch = arrived.to_pandas()
            # the last rows of a batch are compared again with the next: one window, no more
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            yield out(_compare(rows, window, scorer))
            if seen < window:
                first = batch.head(window - seen)
                head.append(first.assign(pos=np.arange(seen, seen + len(first))))
            seen += len(batch)
            tail = rows.tail(window).reset_index(drop=True)
        if tail is not None:
            last = tail.tail(max(0, min(window, seen - window)))
            ends = pd.concat([*head, last.assign(pos=np.arange(seen - len(last), seen))], ignore_index=True)
            yield out(ends.assign(part=part, size=seen))

    both = scratch.keep(ordered.mapInArrow(within, edge_schema), "neighbours")
    inside = both.filter("c1 is not null").select("c1", "c2", "conf")
    ends = both.filter("part is not null").select("part", "pos", "pass", "cid", "label", "day", "code")
    # a row per partition, as the scheduler has them too
    sizes = sorted((r["part"], r["size"]) for r in both.filter("pos = 0").select("part", "size").collect())
    reach = classes.sparkSession.createDataFrame(_borders(sizes, window), "part int, border int, behind boolean, skip long")

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        place, behind = rows["place"].to_numpy(), rows["behind"].to_numpy()
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(~behind), np.flatnonzero(behind), indexing="ij"))
        close = place[j] - place[i] <= window
        columns = scorer.columns(*(rows[c].to_numpy() for c in ("label", "day", "code")))
        return _scored(columns, rows["cid"].to_numpy(), rows["pass"].to_numpy(), i[close], j[close], scorer)

    # places are counted from the border: below 0 before it, from 0 behind it
    meeting = ends.join(reach, "part").withColumn("place", F.col("pos") + F.col("skip")).filter(F.abs(F.col("place") + F.when(F.col("behind"), 1).otherwise(0)) <= window)
    pairs = meeting.groupBy("border").applyInPandas(across, "c1 long, c2 long, conf double")
    return inside.unionByName(pairs).groupBy("c1", "c2").agg(F.max("conf").alias("conf"))


def _borders(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int, bool, int]]:
    """(part, border, behind, skip): which borders the rows of a partition can reach, and their place there less their position.

    A border is named by the partition behind it; ``sizes`` holds (part, rows) of non-empty ones.
    """
    out = []
    for at, (part, _) in enumerate(sizes[1:], 1):
        out.append((part, part, True, 0))
        before, distance = at - 1, 0
        while before >= 0 and distance < window:
            earlier, rows = sizes[before]
            distance += rows
            out.append((earlier, part, False, -distance))
            before -= 1
    return out


def certain_edges(edges: DataFrame) -> DataFrame:
    """Edges that some assignment of greatest total holds: each outweighs the best others of both its ends together.

    Taking such an edge costs at most one other edge an end, so nothing is lost.  Ties between two
    such edges cannot arise: each would have to outweigh the other and more.
    """
    def others(side: str) -> DataFrame:
        best = edges.groupBy(side).agg(F.max("conf").alias("top"))
        # the weight of the second best: that of the best where two share it
        per = edges.join(best, side).groupBy(side).agg(
            F.max("top").alias("top"), F.count(F.when(F.col("conf") == F.col("top"), 1)).alias("n"), F.max(F.when(F.col("conf") < F.col("top"), F.col("conf"))).alias("next"))
        return per.select(side, F.col("top").alias(f"{side}_top"), F.when(F.col("n") > 1, F.col("top")).otherwise(F.coalesce("next", F.lit(0.0))).alias(f"{side}_next"))

    rows = edges.join(others("ea"), "ea").join(others("eb"), "eb")
    best = (F.col("conf") == F.col("ea_top")) & (F.col("conf") == F.col("eb_top"))
    return rows.filter(best & (F.col("conf") > F.col("ea_next") + F.col("eb_next"))).select("ea", "eb", "conf")


#: Rounds in which certain edges are taken before the rest is solved; more would only change the speed.
CERTAIN_ROUNDS = 2


def assign_one_to_one(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``edges(ea, eb, conf)`` in which no end occurs twice, of greatest total confidence.

    Edges that outweigh all that they exclude are taken first, by joins and aggregates over all
    edges at once; that also removes every other edge of their ends and so breaks up components.
    What is left is solved component by component, exactly, over its edges alone, so that memory
    grows with the edges of a component and never with the product of its sides.
    """
    edges = scratch.keep(edges, "edges")
    taken = []
    for n in range(CERTAIN_ROUNDS):
        sure = scratch.keep(certain_edges(edges), f"certain-{n}")
        taken.append(sure)
        edges = scratch.keep(edges.join(sure.select("ea"), "ea", "left_anti").join(sure.select("eb"), "eb", "left_anti"), f"open-{n}")
    roots = hash_to_min(edges.select(F.col("ea").alias("a"), F.col("eb").alias("b")), scratch, "edge-roots")
    coloured = scratch.keep(edges.join(roots.withColumnRenamed("id", "ea"), "ea"), "coloured")

    def solve(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["ea", "eb"])
        gain = {(a, b): c for a, b, c in bucket[["ea", "eb", "conf"]].itertuples(index=False, name=None)}
        chosen = []
        for _, own in bucket.groupby("root", sort=False):
            chosen += sparse_assignment(list(own[["ea", "eb", "conf"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(a, b, gain[a, b]) for a, b in chosen], columns=["ea", "eb", "conf"])

    # a task works through many small components in one batch; a large one has a task to itself
    sizes = coloured.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(coloured.count() / EDGES_PER_TASK))
    dealt = coloured.join(sizes, "root").withColumn("bucket", F.when(F.col("n") > EDGES_PER_TASK, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets))))
    out = dealt.select("bucket", "root", "ea", "eb", "conf").groupBy("bucket").applyInPandas(solve, "ea long, eb long, conf double")
    for sure in taken:
        out = out.unionByName(sure)
    return out


def frequent_days(rows: DataFrame) -> dict[str, float]:
    """Weights below 1 of days that occur too often to be true dates.

    A day's share, less twice its standard error so that chance in small tables counts for nothing,
    is set against that of a day of the usual range if all were alike; from DAY_EXCESS times on the
    weight falls, to 0 at DAY_EXCESS squared.  Fewer than range / DAY_EXCESS days can be so.
    """
    days = rows.filter("day != ''")
    low, high, n = days.agg(*[F.percentile_approx(F.unix_date(F.try_to_date("day", "yyyyMMdd")), q, 1000) for q in (0.005, 0.995)], F.count(F.lit(1))).first()
    if not n or low is None:
        return {}
    excess = lambda c: (c - 2 * c ** 0.5) / n * (high - low + 1)
    counts = days.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    often = counts.filter((F.col("c") - 2 * F.sqrt("c")) / n * (high - low + 1) > DAY_EXCESS).collect()
    return {r["day"]: max(0.0, 2.0 - math.log(excess(r["c"])) / math.log(DAY_EXCESS)) for r in often}


def frequent_codes(rows: DataFrame) -> dict[str, float]:
    """Shares of group codes that occur so often that agreement on them says less than MOST_FROM_GROUP; bounded by 1 / that share."""
    codes = rows.filter("code != ''")
    n = codes.count()
    often = codes.groupBy("code").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > n * math.exp(-MOST_FROM_GROUP / GROUP_GAIN)).collect()
    return {r["code"]: r["c"] / n for r in often}


def match_sources(a: DataFrame, b: DataFrame, scratch: Scratch, spark: SparkSession) -> DataFrame:
    """(left_record_key, right_record_key, confidence): pairs of the same thing, all of its records.

    Inputs have record_key, label_value, date_value and group_value; other columns are ignored.
    Rows without a key, or without any usable field, match nothing; one field is enough to be
    compared.  Several rows of one record are all compared; a source may be empty (no pairs).
    """
    normalised = F.pandas_udf(_normalised, "label string, day string, code string")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("record_key").isNotNull()).select(
            F.lit(name).alias("side"), "record_key", normalised("label_value", "date_value", "group_value").alias("n")).select("side", "record_key", "n.*")

    usable = (F.col("label") != "") | (F.col("day") != "") | (F.col("code") != "")
    rows = side(a, "a").unionByName(side(b, "b")).filter(usable).distinct()
    rows = scratch.keep(rows.select(
        "side", "record_key", "label", "day", "code", F.xxhash64("label", "day", "code").alias("cid"),
        F.xxhash64("side", "record_key").alias("rid")), "rows")
    scorer = Scorer(frequent_days(rows), frequent_codes(rows))
    classes = scratch.keep(rows.groupBy("cid").agg(
        *[F.first(c).alias(c) for c in ("label", "day", "code")],
        F.min(F.when(F.col("side") == "a", F.col("rid"))).alias("ra"), F.min(F.when(F.col("side") == "b", F.col("rid"))).alias("rb"), F.count(F.lit(1)).alias("n")), "classes")
    near = scratch.keep(sorted_neighbours(classes, classes.count(), scratch, scorer), "near")

    ends = classes.select("cid", "ra", "rb")
    paired = scratch.keep(near.join(ends.toDF("c1", "a1", "b1"), "c1").join(ends.toDF("c2", "a2", "b2"), "c2"), "paired")
    strong = paired.filter(F.col("conf") >= INTRA_THRESHOLD)
    hot = hot_keys(classes, "cid", rows.count())
    inner = (join_unique(rows, ends, "cid", hot).select(F.col("rid").alias("a"), F.when(F.col("side") == "a", F.col("ra")).otherwise(F.col("rb")).alias("b"))
             .unionByName(strong.select(F.col("a1").alias("a"), F.col("a2").alias("b")))
             .unionByName(strong.select(F.col("b1").alias("a"), F.col("b2").alias("b"))))
    things = scratch.keep(hash_to_min(inner.distinct(), scratch, "things"), "thing-roots")

    @F.pandas_udf("double")
    def own(label: pd.Series, day: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series(_confidence(scorer.own_odds(scorer.columns(*(x.to_numpy() for x in (label, day, code))))))

    same = classes.filter("ra is not null and rb is not null").select("ra", "rb", own("label", "day", "code").alias("conf"))
    cross = (same.unionByName(paired.select(F.col("a1").alias("ra"), F.col("b2").alias("rb"), "conf"))
             .unionByName(paired.select(F.col("a2").alias("ra"), F.col("b1").alias("rb"), "conf"))
             .filter("ra is not null and rb is not null").filter(F.col("conf") >= THRESHOLD))
    edges = (cross.join(things.toDF("ra", "ea"), "ra").join(things.toDF("rb", "eb"), "rb")
             .groupBy("ea", "eb").agg(F.max("conf").alias("conf")))
    chosen = assign_one_to_one(edges, scratch)
    members = rows.select("side", "record_key", "rid").distinct().join(things.toDF("rid", "e"), "rid")
    left = members.filter("side = 'a'").select(F.col("e").alias("ea"), F.col("record_key").alias("left_record_key"))
    right = members.filter("side = 'b'").select(F.col("e").alias("eb"), F.col("record_key").alias("right_record_key"))
    return chosen.join(left, "ea").join(right, "eb").select("left_record_key", "right_record_key", F.col("conf").alias("confidence")).distinct()

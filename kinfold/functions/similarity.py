"""Comparison functions and levels for candidate pairs.

Edit distances work on UTF-8 bytes, so that results equal those of engines that compare bytes.
What Spark has stays in the JVM.  Jaro-Winkler runs in Arrow batches, over all pairs of a batch at
once; unrestricted Damerau-Levenshtein too, each distinct pair of values once per batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler_bytes(a: bytes, b: bytes) -> float:
    """Jaro similarity with a prefix bonus of 0.1 a byte (4 at most) where Jaro exceeds 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hits = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Bytes of a text that fit the bits of a word; pairs with a longer text are compared one by one.
WORD = 64
#: Pairs compared at once: their tables stay in the cache of a core.
PAIRS_AT_ONCE = 4096


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, byte) of each text up to its first ``WORD`` bytes, filled up with 0, and lengths in bytes."""
    text = column.cast(pa.large_binary())
    starts = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    lengths = starts[1:] - starts[:-1]
    width = int(min(lengths.max(initial=1), WORD))
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    at = np.arange(width)
    inside = at < lengths[:, None]
    out = np.zeros((len(text), width), dtype=np.uint8)
    out[inside] = data[(starts[:-1, None] + at)[inside]]
    return out, lengths


def _jaro_winkler_words(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``jaro_winkler_bytes`` of rows of texts that are not empty and have at most ``WORD`` bytes.

    A word has a bit per place of b: places with the same byte, places within reach, places used.
    """
    one, rows = np.uint64(1), len(a)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    place = np.arange(WORD, dtype=np.uint64)
    below = np.append((one << place) - one, ~np.uint64(0))  # below[k]: the lowest k places
    used = np.zeros(rows, dtype=np.uint64)
    hits = np.zeros(rows, dtype=np.int64)
    same = np.zeros((a.shape[1], rows), dtype=np.uint64)
    hit = np.zeros((a.shape[1], rows), dtype=bool)
    wide = np.zeros((rows, WORD), dtype=bool)
    for i in range(int(n.max())):
        wide[:, :b.shape[1]] = b == a[:, i, None]
        same[i] = np.packbits(wide, axis=1, bitorder="little").view("<u8")[:, 0]
        window = below[np.minimum(m, i + reach + 1)] & ~below[np.minimum(WORD, np.maximum(0, i - reach))]
        free = np.where(i < n, same[i] & window & ~used, np.uint64(0))
        first = free & (~free + one)
        used |= first
        hit[i] = first != 0
        hits += hit[i]
    swaps = np.zeros(rows, dtype=np.int64)
    for i in range(int(n.max())):
        first = np.where(hit[i], used & (~used + one), np.uint64(0))
        swaps += hit[i] & ((first & same[i]) == 0)
        used ^= first
    swaps //= 2
    some = np.maximum(hits, 1)
    jaro = np.where(hits > 0, (some / n + some / m + (some - swaps) / some) / 3, 0.0)
    k = min(4, a.shape[1], b.shape[1])
    equal = (a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None])
    prefix = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
    bonus = jaro + 0.1 * prefix * (1 - jaro)
    whole = (n == m) & (hits == n) & (swaps == 0)
    return np.where(whole, 1.0, np.where(jaro > 0.7, bonus, jaro))


def jaro_winkler_arrow(l: pa.Array, r: pa.Array) -> pa.Array:  # noqa: E741
    """``jaro_winkler_bytes`` of each row of two arrays of texts; null where one is null."""
    out = np.zeros(len(l))
    null = np.asarray(l.is_null()) | np.asarray(r.is_null())
    for start in range(0, len(l), PAIRS_AT_ONCE):
        part_l, part_r = (x.slice(start, PAIRS_AT_ONCE) for x in (l, r))
        (a, n), (b, m) = _bytes_of(part_l), _bytes_of(part_r)
        open_ = ~null[start:start + PAIRS_AT_ONCE] & (n > 0) & (m > 0)
        short = np.flatnonzero(open_ & (n <= WORD) & (m <= WORD))
        if len(short):
            out[start + short] = _jaro_winkler_words(a[short], n[short], b[short], m[short])
        for i in np.flatnonzero(open_ & ((n > WORD) | (m > WORD))):
            out[start + i] = jaro_winkler_bytes(part_l[int(i)].as_py().encode(), part_r[int(i)].as_py().encode())
    return pa.array(out, pa.float64(), mask=null)


def damerau_bytes(a: bytes, b: bytes) -> int:
    """Edits with transpositions that may be edited further (unrestricted)."""
    last: dict[int, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            row = last.get(b[j - 1], 0)
            cost, at = (0, j) if a[i - 1] == b[j - 1] else (1, column)
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][column] + i - row + j - column - 1)
            column = at
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def _pairwise(function, a: pd.Series, b: pd.Series) -> pd.Series:
    done: dict = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in done:
            done[x, y] = function(x.encode(), y.encode())
        out.append(done[x, y])
    return pd.Series(out, dtype="float64")


def jaro_winkler(l: Column, r: Column) -> Column:  # noqa: E741
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return jaro_winkler_arrow(a, b)

    return F.arrow_udf(run, "double")(l.cast("string"), r.cast("string"))


def _share(distance: Column, l: Column, r: Column, maximum: int | None) -> Column:  # noqa: E741
    longest = F.greatest(F.length(l), F.length(r))
    near = F.greatest(F.lit(0.0), 1.0 - distance.cast("double") / F.nullif(longest, F.lit(0)))
    value = F.when(longest == 0, 1.0).otherwise(near)
    if maximum is not None:
        value = F.when(distance > maximum, 0.0).otherwise(value)
    return F.when(l.isNotNull() & r.isNotNull(), value)


def levenshtein_similarity(l: Column, r: Column, maximum: int | None = None) -> Column:  # noqa: E741
    """1 - distance / longer length, not below 0; 0 beyond ``maximum``; 1 for two empty strings."""
    as_bytes = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return _share(F.levenshtein(as_bytes(l), as_bytes(r)), l, r, maximum)


def damerau_similarity(l: Column, r: Column, maximum: int | None = None) -> Column:  # noqa: E741
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _pairwise(damerau_bytes, a, b)

    return _share(F.pandas_udf(run, "double")(l, r), l, r, maximum)


def qgrams(x: Column, q: int) -> Column:
    """Distinct substrings of length q; a shorter string is its own only gram."""
    places = F.sequence(F.lit(1), F.greatest(F.length(x) - q + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(x, i, F.lit(q))))


def qgram_similarity(l: Column, r: Column, q: int = 2) -> Column:  # noqa: E741
    a, b = qgrams(l, q), qgrams(r, q)
    return F.when(l.isNotNull() & r.isNotNull(), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def exact_similarity(l: Column, r: Column) -> Column:  # noqa: E741
    return F.when(l.isNotNull() & r.isNotNull(), F.when(l == r, 1.0).otherwise(0.0))


def date_difference(l: Column, r: Column, unit: str = "day") -> Column:  # noqa: E741
    """Calendar boundaries between two dates: 31 January to 1 February is one month."""
    if unit == "day":
        d = F.datediff(r, l)
    elif unit == "month":
        d = (F.year(r) - F.year(l)) * 12 + F.month(r) - F.month(l)
    elif unit == "year":
        d = F.year(r) - F.year(l)
    else:
        raise ValueError("unit must be day, month or year")
    return F.abs(d).cast("double")


def numeric_difference(l: Column, r: Column, scale: float = 1.0) -> Column:  # noqa: E741
    return F.abs(l.cast("double") - r.cast("double")) / scale


def round_double(x: Column, digits: int) -> Column:
    """A double that is not negative, rounded half up in doubles, without a decimal made for each row."""
    scaled = x * 10.0**digits
    near = F.rint(scaled)
    return F.when(F.abs(scaled) == F.lit(math.inf), x).otherwise(F.when(scaled - near == 0.5, near + 1.0).otherwise(near) / 10.0**digits)


COMPARISONS = {
    "exact": lambda l, r, **_: exact_similarity(l, r),
    "jaro_winkler": lambda l, r, **_: jaro_winkler(l, r),
    "levenshtein": lambda l, r, maximum=None, **_: levenshtein_similarity(l, r, maximum),
    "damerau_levenshtein": lambda l, r, maximum=None, **_: damerau_similarity(l, r, maximum),
    "qgram": lambda l, r, q=2, **_: qgram_similarity(l, r, q),
    "date_difference": lambda l, r, unit="day", **_: date_difference(l, r, unit),
    "numeric_difference": lambda l, r, scale=1.0, **_: numeric_difference(l, r, scale),
}

#: Functions whose values are differences; all others are similarities.
DIFFERENCES = frozenset(["date_difference", "numeric_difference"])


def check_levels(levels: list[tuple], function: str) -> None:
    """Raise unless the ordered levels are sound.

    The last must be ``else``; ``missing``, ``exact`` and ``else`` occur once at most; thresholds
    fall and maximum differences rise; thresholds go with similarities, differences with differences.
    """
    names = [lv[0] for lv in levels]
    if not levels or names[-1] != "else":
        raise ValueError("the last level must be else")
    if any(names.count(n) > 1 for n in ("missing", "exact", "else")):
        raise ValueError("missing, exact and else occur once at most")
    thresholds = [lv[1] for lv in levels if lv[0] == "threshold"]
    maxima = [lv[1] for lv in levels if lv[0] == "maximum_difference"]
    if thresholds != sorted(set(thresholds), reverse=True) or maxima != sorted(set(maxima)):
        raise ValueError("thresholds must fall and maximum differences rise")
    if (thresholds and function in DIFFERENCES) or (maxima and function not in DIFFERENCES):
        raise ValueError("level kind does not fit the comparison")


def level_index(value: Column, exact: Column, missing: Column, levels: list[tuple]) -> Column:
    """Index of the first level that holds.

    Without a ``missing`` level a missing pair has a null level.
    """
    names = [lv[0] for lv in levels]
    out = F.when(missing, F.lit(names.index("missing") if "missing" in names else None).cast("int"))
    for i, lv in enumerate(levels):
        if lv[0] == "exact":
            out = out.when(exact, i)
        elif lv[0] == "threshold":
            out = out.when(value >= lv[1], i)
        elif lv[0] == "maximum_difference":
            out = out.when(value <= lv[1], i)
        elif lv[0] == "else":
            out = out.otherwise(i)
    return out.cast("int")

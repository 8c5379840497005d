"""Current state of a table from a feed of inserts, updates and deletes.

The fold is one commutative, associative and idempotent aggregation: every change contributes
``struct(position, ...)`` values and a key keeps the largest of each.  Order of arrival, repeats
and lateness therefore cannot matter, Spark combines on the map side before the only shuffle (a
key with very many changes arrives as one row per map task), and a kept state can be folded with
later changes by the same function.

Why maxima suffice: a key is live exactly if the latest of its inserts and deletes is an insert,
and a live key's column has the value of the latest change that set it.  Changes older than that
insert cannot win, since the insert sets every column at a higher position; changes to a key that
is not live lie before the next insert or after the last delete, so they are never seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIFE = "__life"


@dataclass(frozen=True)
class FeedSpec:
    """Which columns of the feed hold key, position, operation, named fields and payload."""

    key: Sequence[str]
    position: Sequence[str]
    op: str
    payload: Sequence[str]
    changed: str | None = None


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _slot(name: str) -> str:
    return f"__set_{name}"


def op_letter(op: Column) -> Column:
    """``i``, ``u``, ``d`` by the first letter of the trimmed spelling, else null."""
    first = F.lower(F.substring(F.trim(op), 1, 1))
    return F.when(first.isin("i", "u", "d"), first)


def fold_changes(changes: DataFrame, spec: FeedSpec, base: DataFrame | None = None) -> DataFrame:
    """Per key the newest life event and, per payload column, the newest value set.

    ``base`` is a state this function returned before (tombstones included); it is folded in as
    if its changes came once more.  The result keeps deleted keys, so that a change that comes
    later but is older than the delete stays without effect.

    Defined results: rows with a null key or position or an unknown operation take no part; a null
    payload value set by a change is a value; two different changes at one position resolve to the
    larger value, so the result never depends on order; an empty feed gives an empty state (or
    ``base``); columns outside the spec are ignored, whatever they are called.
    """
    letter = op_letter(_col(spec.op))
    position = [_col(c) for c in spec.position]
    usable = letter.isNotNull()
    for c in [*spec.key, *spec.position]:
        usable = usable & _col(c).isNotNull()
    if spec.changed is None:
        partial = F.lit(False)
        named = None
    else:
        partial = (letter == "u") & _col(spec.changed).isNotNull()
        named = F.transform(F.split(_col(spec.changed), ","), lambda x: F.trim(x))

    def slot(name: str) -> Column:
        sets = letter.isin("i", "u") & ~partial
        if named is not None:
            sets = sets | (partial & F.array_contains(named, name))
        value = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(position)], _col(name).alias("value"))
        return F.when(sets, value).alias(_slot(name))

    life = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(position)], (letter == "i").alias("live"))
    rows = changes.filter(usable).select(
        *[_col(c) for c in spec.key],
        F.when(letter.isin("i", "d"), life).alias(LIFE),
        *[slot(c) for c in spec.payload],
    )
    if base is not None:
        rows = rows.unionByName(base.select(rows.columns))
    return rows.groupBy(*[_col(c) for c in spec.key]).agg(
        F.max(LIFE).alias(LIFE), *[F.max(_slot(c)).alias(_slot(c)) for c in spec.payload]
    )


def live_rows(state: DataFrame, spec: FeedSpec) -> DataFrame:
    """The table itself: keys whose last life event is an insert, with their newest values."""
    return state.filter(F.col(f"{LIFE}.live")).select(
        *[_col(c) for c in spec.key], *[F.col(f"`{_slot(c)}`.value").alias(c) for c in spec.payload]
    )


def apply_changes(changes: DataFrame, spec: FeedSpec, base: DataFrame | None = None) -> DataFrame:
    """``live_rows(fold_changes(...))``: the table after all changes."""
    return live_rows(fold_changes(changes, spec, base), spec)

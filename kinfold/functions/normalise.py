"""Normalisation of raw values: Column to Column, in the order a variable declares."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any Unicode kind, and the four separators that count as such in Python.
_SPACE = r"[\s\x1c-\x1f]"


class NormalisationError(ValueError):
    """A value that a declared transform cannot take; never carries the value itself."""


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_whitespace(x: Column) -> Column:
    return strip(F.regexp_replace(x, rf"(?U){_SPACE}+", " "))


def blank_to_null(x: Column) -> Column:
    return F.when(strip(x) != "", x)


def _udf(function):
    return F.pandas_udf(function, "string")


def casefold(x: Column) -> Column:
    """Full Unicode case folding; ASCII stays in the JVM, only other text goes through Arrow."""

    def fold(s: pd.Series) -> pd.Series:
        return s.str.casefold()

    plain = x.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(F.when(plain, F.lower(x)), _udf(fold)(F.when(~plain, x)))


def unicode_normalise(x: Column, form: str) -> Column:
    """NFC or NFKC; ASCII is its own normal form and never leaves the JVM."""
    if form not in ("NFC", "NFKC"):
        raise ValueError("form must be NFC or NFKC")

    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    plain = x.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(F.when(plain, x), _udf(normal)(F.when(~plain, x)))


def parse_date(x: Column, formats: Sequence[str]) -> Column:
    """First of the date patterns that fits; null if none does."""
    if not 1 <= len(formats) <= 16:
        raise ValueError("between 1 and 16 formats")
    shape = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "yyyyMMdd": r"^\d{8}$", "dd-MMM-yyyy": r"^\d{2}-[A-Z][a-z]{2}-\d{4}$"}
    tries = [F.when(x.rlike(shape[f]), F.try_to_date(x, f)) if f in shape else F.try_to_date(x, f) for f in formats]
    return F.coalesce(*tries)


def to_integer(x: Column) -> Column:
    """Whole numbers, also written as 1.0; null for anything else."""
    number = x.cast("string").try_cast("decimal(38,10)")
    return F.when(number == F.floor(number), number.try_cast("long"))


def to_float(x: Column) -> Column:
    """Finite numbers; null for anything else."""
    number = x.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def to_boolean(x: Column) -> Column:
    word = F.lower(strip(x.cast("string")))
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False)


TRANSFORMS = {
    "strip": lambda x, _: strip(x),
    "casefold": lambda x, _: casefold(x),
    "nfc": lambda x, _: unicode_normalise(x, "NFC"),
    "nfkc": lambda x, _: unicode_normalise(x, "NFKC"),
    "collapse_whitespace": lambda x, _: collapse_whitespace(x),
    "parse_date": lambda x, arg: parse_date(x, arg),
    "integer": lambda x, _: to_integer(x),
    "float": lambda x, _: to_float(x),
    "boolean": lambda x, _: to_boolean(x),
}


def _taken(before: Column, made: Column, name: str, blank_is_missing: bool, strict: bool) -> Column:
    """What a transform made of a value, if that is to stand."""
    out = made
    if strict:
        out = F.when(before.isNotNull() & made.isNull(), F.raise_error(F.lit(f"PREPARE: a value does not fit transform {name}"))).otherwise(made)
    if blank_is_missing and name in ("strip", "casefold", "nfc", "nfkc", "collapse_whitespace"):
        out = F.when(out != "", out)
    return out


def normalise_value(x: Column, transforms: Sequence, blank_is_missing: bool = True, strict: bool = False) -> Column:
    """Apply transforms, each a name or (name, argument), in order.

    With ``strict`` a present value that a transform turns into null stops the job with a message
    that does not repeat the value; otherwise it becomes missing.
    """
    out = blank_to_null(x) if blank_is_missing else x
    for t in transforms:
        name, arg = (t, None) if isinstance(t, str) else t
        out = _taken(out, TRANSFORMS[name](out, arg), name, blank_is_missing, strict)
    return out


def surrogate_key(dataset_id: str, identity: Column) -> Column:
    """sha256 of data set and identity, joined by the unit separator."""
    return F.sha2(F.concat(F.lit(f"{dataset_id}\x1f"), identity.cast("string")), 256)


def pair_digest(left: Column, right: Column) -> Column:
    """sha256 of left and right, joined by NUL."""
    return F.sha2(F.concat(left, F.lit("\x00"), right), 256)


def prepare(df: DataFrame, dataset_id: str, identity: str, variables: dict[str, tuple[str, Sequence]], strict: bool = False, raw_keys: bool = False) -> DataFrame:
    """(record_key, v_<name>, m_<name>...): the canonical table of a source.

    ``variables`` maps a canonical name to (source column, transforms).  Extra source columns are
    dropped.  Use ``check_identities`` on the result where repeated identities must stop the job.
    """
    key = F.col(f"`{identity}`").cast("string") if raw_keys else surrogate_key(dataset_id, F.col(f"`{identity}`"))
    values = df.select(key.alias("record_key"), *[blank_to_null(F.col(f"`{c}`")).alias(f"v_{n}") for n, (c, _) in variables.items()])
    # a select a transform: within one expression each transform would repeat those before it
    for i in range(max((len(t) for _, t in variables.values()), default=0)):
        made, taken = [], []
        for n, (_, t) in variables.items():
            if i < len(t):
                name, arg = (t[i], None) if isinstance(t[i], str) else t[i]
                made.append(TRANSFORMS[name](F.col(f"v_{n}"), arg).alias(f"t_{n}"))
                taken.append(_taken(F.col(f"v_{n}"), F.col(f"t_{n}"), name, True, strict).alias(f"v_{n}"))
            else:
                taken.append(F.col(f"v_{n}"))
        values = values.select("*", *made).select("record_key", *taken)
    return values.select("*", *[F.col(f"v_{n}").isNull().alias(f"m_{n}") for n in variables])


def check_identities(prepared: DataFrame) -> None:
    """Raise unless every record key is present and unique."""
    if not prepared.filter(F.col("record_key").isNull() | (strip(F.col("record_key")) == "")).isEmpty():
        raise NormalisationError("PREPARE: a record has no identity")
    if not prepared.groupBy("record_key").count().filter("count > 1").isEmpty():
        raise NormalisationError("PREPARE: record identities repeat")

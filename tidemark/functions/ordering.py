"""The order of states of one source: sequence, then version, then commit time, then source time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, SAME, AFTER, UNKNOWN = -1, 0, 1, 2

#: Ranks of the enumerations. Fixed values.
TRUST = ("untrusted", "low", "standard", "high", "authoritative")
CLASSIFICATION = ("public", "internal", "confidential", "restricted", "secret")


def rank(value: Column, ladder: tuple[str, ...]) -> Column:
    """1 for the first rung, null and unknown values 0."""
    return F.coalesce(*(F.when(value == x, i) for i, x in enumerate(ladder, 1)), F.lit(0))


def digits(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def whole(value: Column) -> Column:
    """A string of digits as a struct that sorts as the number, whatever its length."""
    bare = F.regexp_replace(value, "^0+(?=[0-9])", "")
    return F.struct(F.length(bare), bare)


def compare_sequences(a: Column, b: Column) -> Column:
    """-1, 0 or 1: as whole numbers if both are digits only, else as text; null if one is null."""
    numbers = digits(a) & digits(b)
    x, y = whole(a), whole(b)
    return F.when(a.isNull() | b.isNull(), None).when(numbers, F.when(x < y, BEFORE).when(x > y, AFTER).otherwise(SAME)).when(a < b, BEFORE).when(a > b, AFTER).otherwise(SAME)


def _values(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(a < b, BEFORE).when(a > b, AFTER).otherwise(SAME)


def compare_positions(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """-1, 0, 1, or 2 where nothing tells: other sources, or no marker that both have.

    Keys: source, sequence, version, commit_time, source_time; the first marker that both have decides, so missing ones
    are passed over. Empty strings count as missing.
    """
    text = lambda p, k: F.when(p[k] != "", p[k]) if k in p else F.lit(None)
    time = lambda p, k: p.get(k, F.lit(None))
    steps = [compare_sequences(text(a, k), text(b, k)) for k in ("sequence", "version")]
    steps += [_values(time(a, k), time(b, k)) for k in ("commit_time", "source_time")]
    return F.when(a["source"] == b["source"], F.coalesce(*steps, F.lit(UNKNOWN))).otherwise(UNKNOWN)

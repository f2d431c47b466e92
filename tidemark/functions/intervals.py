"""Half-open intervals [from, to) whose null bounds are unbounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains(lo: Column | str, hi: Column | str, at: Column) -> Column:
    lo, hi = _c(lo), _c(hi)
    return (lo.isNull() | (lo <= at)) & (hi.isNull() | (hi > at))


def is_empty(lo: Column | str, hi: Column | str) -> Column:
    """An interval whose end isn't after its start holds no instant."""
    return F.coalesce(_c(hi) <= _c(lo), F.lit(False))


def overlaps(a_lo: Column | str, a_hi: Column | str, b_lo: Column | str, b_hi: Column | str) -> Column:
    """Whether an instant lies in both; never for an empty interval."""
    a_lo, a_hi, b_lo, b_hi = map(_c, (a_lo, a_hi, b_lo, b_hi))
    before = lambda x, y: x.isNull() | y.isNull() | (x < y)
    return before(a_lo, b_hi) & before(b_lo, a_hi) & ~is_empty(a_lo, a_hi) & ~is_empty(b_lo, b_hi)


def _starts(a: Column, b: Column) -> Column:
    """-1, 0, 1; a null start is before all."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def _ends(a: Column, b: Column) -> Column:
    """-1, 0, 1; a null end is after all."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)


def allen(a_lo: Column | str, a_hi: Column | str, b_lo: Column | str, b_hi: Column | str) -> Column:
    """Which of Allen's thirteen relations the first interval has to the second."""
    a_lo, a_hi, b_lo, b_hi = map(_c, (a_lo, a_hi, b_lo, b_hi))
    s, e = _starts(a_lo, b_lo), _ends(a_hi, b_hi)
    return (
        F.when((s == 0) & (e == 0), "equals")
        .when(a_hi == b_lo, "meets")
        .when(a_hi < b_lo, "before")
        .when(b_hi == a_lo, "met_by")
        .when(b_hi < a_lo, "after")
        .when((s == 0) & (e < 0), "starts")
        .when(s == 0, "started_by")
        .when((e == 0) & (s > 0), "finishes")
        .when(e == 0, "finished_by")
        .when((s < 0) & (e < 0), "overlaps")
        .when((s > 0) & (e > 0), "overlapped_by")
        .when((s > 0) & (e < 0), "during")
        .otherwise("contains")
    )


def temporal_fit(lo: Column | str, hi: Column | str, at: Column) -> Column:
    """How well a claim's validity fits an instant: not yet, ended, undated, in force."""
    lo, hi = _c(lo), _c(hi)
    return F.when(lo > at, 0.3).when(hi <= at, 0.4).when(lo.isNull() & hi.isNull(), 0.8).otherwise(1.0)

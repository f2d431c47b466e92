"""Vectors as arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero, or lengths differ."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def valid(a: Column, size: int) -> Column:
    """Whether a vector has the size and only finite parts."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return a.isNotNull() & (F.size(a) == size) & ~F.coalesce(F.exists(a, bad), F.lit(False))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes, as a long."""
    octets = F.regexp_extract_all(F.hex(x.cast("binary")), F.lit("(..)"))
    step = lambda h, b: ((h.bitwiseXOR(F.conv(b, 16, 10).cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return F.aggregate(octets, F.lit(2166136261).cast("long"), step)

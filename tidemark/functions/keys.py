"""Deterministic keys and canonical values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_key(namespace: str, *parts: Column) -> Column:
    """SHA-256 over version, namespace and parts, joined by NUL; a null part counts as empty."""
    fields = [F.lit("v1"), F.lit(namespace), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return F.sha2(F.concat_ws("\0", *fields).cast("binary"), 256)


def content_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def canonical_json(x: Column) -> Column:
    """Compact JSON with sorted keys; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(x))


def decimal_text(x: Column) -> Column:
    """A decimal without superfluous zeros, so that 1.50 equals 1.5."""
    text = x.try_cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def object_key(kind: Column, value: Column) -> Column:
    """The canonical form by which claim values are compared: the kind, a colon, the kind's normal form of the value."""
    normal = (
        F.when(kind == "symbol", F.upper(value))
        .when(kind == "integer", value.try_cast("bigint").cast("string"))
        .when(kind == "decimal", decimal_text(value))
        .when(kind == "boolean", F.lower(value.try_cast("boolean").cast("string")))
        .when(kind == "json", canonical_json(value))
        .when(kind == "geo", F.format_string("%.6f,%.6f", F.split(value, ",")[0].try_cast("double"), F.split(value, ",")[1].try_cast("double")))
        .otherwise(value)
    )
    return F.concat(kind, F.lit(":"), normal)


def coerce(kind: Column, value: Column) -> Column:
    """The kind a raw column value really has: as asked where it parses, else string."""
    fits = (
        F.when(kind == "integer", value.try_cast("bigint").isNotNull())
        .when(kind == "decimal", value.try_cast("decimal(38,18)").isNotNull())
        .when(kind == "boolean", value.try_cast("boolean").isNotNull())
        .when(kind == "timestamp", value.try_cast("timestamp_ntz").isNotNull())
        .when(kind == "date", value.try_cast("date").isNotNull())
        .otherwise(True)
    )
    return F.when(fits, kind).otherwise("string")


def _escape(x: Column) -> Column:
    return F.url_encode(x)


def scope_key(qualifiers: Column) -> Column:
    """A map of context qualifiers as ``role=value`` pairs, sorted, escaped, joined by semicolons."""
    pairs = F.array_sort(F.map_entries(qualifiers))
    return F.array_join(F.transform(pairs, lambda e: F.concat(_escape(e["key"]), F.lit("="), _escape(e["value"]))), ";")


def qualifiers(key: Column) -> Column:
    """Back to the map; a key that isn't of that form is the value of ``context``; an empty one is an empty map."""
    pair = lambda p: F.struct(F.url_decode(F.split(p, "=")[0]), F.url_decode(F.split(p, "=")[1]))
    formed = F.map_from_entries(F.transform(F.split(key, ";"), pair))
    return F.when(key == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).when(key.rlike("^[^=;]+=[^=;]*(;[^=;]+=[^=;]*)*$"), formed).otherwise(F.create_map(F.lit("context"), key))

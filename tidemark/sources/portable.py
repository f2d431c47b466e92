"""Portable packages: JSON lines in dependency order, chained by digests.

The chain h(i) = sha256(h(i-1), line, newline) is sequential by its nature. It is folded section by section over a sorted
stream of lines on the driver side iterator, one partition at a time, so nothing but one partition is held at once. For
large exports ``tree_digest`` gives an order-independent digest that combines in parallel.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections in the order in which an import can resolve their references. Fixed values.
SECTIONS = ("sources", "entities", "entity_identifiers", "assertions", "conflict_sets")


def to_lines(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``section_no``, ``section``, ``id``, ``line`` of tables given as section -> (rows, id column)."""
    out = None
    for n, s in enumerate(SECTIONS):
        if s in tables:
            df, key = tables[s]
            rows = df.distinct().select(F.lit(n).alias("section_no"), F.lit(s).alias("section"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))
            out = rows if out is None else out.unionByName(rows)
    return out


def chain(lines: Iterable[str], before: bytes = b"") -> bytes:
    h = before
    for line in lines:
        h = hashlib.sha256(h + line.encode() + b"\n").digest()
    return h


def manifest(lines: DataFrame) -> dict:
    """Overall and per-section digests and counts of lines."""
    overall, sections, counts = b"", {}, {}
    for r in lines.orderBy("section_no", "id", "line").toLocalIterator():
        overall = chain([r.line], overall)
        sections[r.section] = chain([r.line], sections.get(r.section, b""))
        counts[r.section] = counts.get(r.section, 0) + 1
    return {"digest": overall.hex(), "sections": {s: {"digest": h.hex(), "count": counts[s]} for s, h in sections.items()}}


def section_digests(lines: DataFrame) -> DataFrame:
    """``section``, ``rows``, ``tree_digest``: the sum of the lines' hashes, which any order and partitioning gives alike."""
    part = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.groupBy("section").agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("tree_digest"))


def write(lines: DataFrame, path: str) -> dict:
    """Write a package folder: its lines, and a manifest beside them."""
    m = manifest(lines)
    lines.orderBy("section_no", "id", "line").select(F.to_json(F.struct("section_no", "section", "id", "line")).alias("value")).write.text(f"{path}/records")
    lines.sparkSession.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return m


def read(spark, path: str) -> tuple[DataFrame, dict]:
    rows = spark.read.text(f"{path}/records").select(F.from_json("value", "section_no int, section string, id string, line string").alias("r")).select("r.*")
    return rows, json.loads(spark.read.text(f"{path}/manifest").first()[0])


def verify(lines: DataFrame, expected: dict) -> list[str]:
    """What is wrong with a package: names of bad sections, ``overall`` if only the order between sections differs."""
    got = manifest(lines)
    names = sorted(set(got["sections"]) | set(expected["sections"]))
    bad = [s for s in names if got["sections"].get(s) != expected["sections"].get(s)]
    return bad or ([] if got["digest"] == expected["digest"] else ["overall"])

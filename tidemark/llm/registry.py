"""Registered queries on training texts and records, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, groups, pieces, repetition, tokens
from tidemark.plans.tables import spread, table

KEYS = ["graph_space_id", "kind", "id_namespace", "value"]


def _entity_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").select("entity_id", "merged_into_id")
    ids = rows.select(F.col("entity_id").alias("b")).distinct()
    merges = rows.select(F.col("entity_id").alias("a"), F.col("merged_into_id").alias("b")).dropna().join(ids, "b", "left_semi").select("a", "b")
    value = F.lower(F.regexp_replace("id_value", r"^\s+|\s+$", ""))
    named = table(spark, d, "entity_identifiers").select("graph_space_id", "kind", "id_namespace", "entity_id", value.alias("value")).filter("value != ''")
    named = named.join(ids.withColumnRenamed("b", "entity_id"), "entity_id", "left_semi")
    return groups.groups(merges.unionByName(groups.key_pairs(named, KEYS, "entity_id")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _entity_groups(spark, d).select("group_id", F.col("id").alias("entity_id"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with its group, alone or not."""
    found = p2_found(spark, d)
    ids = table(spark, d, "entities").select("entity_id").dropna().distinct()
    return ids.join(found, "entity_id", "left").select(F.coalesce("group_id", "entity_id").alias("group_id"), "entity_id")


SECTION = ["artifact_id", "section_no", "heading_path", "artifact_char_start"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows are split as often as they are there, and their sections come out once: no text is shuffled."""
    rows = table(spark, d, "handbook_sections").select("artifact_id", "section_no", "content")
    found = pieces.split(spread(rows), "content", ["artifact_id", "section_no"])
    return found.filter("piece > 0").select("artifact_id", "section_no").distinct()


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "handbook_sections").select(*SECTION, "content")
    # of rows with one content the first place, then the first path
    rows = rows.groupBy("artifact_id", "section_no", F.sha2("content", 256).alias("hash")).agg(F.min(F.struct("artifact_char_start", "heading_path")).alias("m"), F.any_value("content").alias("content"))
    rows = rows.select("artifact_id", "section_no", "m.heading_path", "m.artifact_char_start", "content")
    found = pieces.split(rows, "content", SECTION)
    return found.select("artifact_id", "section_no", "piece", "content", "token_count", "heading_path", (F.col("artifact_char_start") + F.col("char_start")).alias("artifact_char_start"))


def _texts(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).select(F.col(key).alias("id"), "text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(_texts(spark, d, "documents", "doc_id")).select(F.col("id").alias("doc_id"), "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contained_pairs(_texts(spark, d, "eval_items", "item_id"), _texts(spark, d, "documents", "doc_id"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with how much of it each document holds."""
    found = contamination.contained(_texts(spark, d, "eval_items", "item_id"), _texts(spark, d, "documents", "doc_id"))
    return found.withColumn("contained_share", F.round(F.col("joint") / F.col("item_sequences"), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(_texts(spark, d, "documents", "doc_id")).select(F.col("id").alias("doc_id"))


def p9_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(_texts(spark, d, "documents", "doc_id")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable] = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_chunks, p7_ids, p8_found, p8_leaks, p9_found, p9_repetition)}

_GROUPS = """
WITH RECURSIVE ids AS (SELECT DISTINCT entity_id FROM entities),
keyed AS (
  SELECT DISTINCT entity_id, graph_space_id AS g, kind AS k, id_namespace AS n, lower(trim(id_value)) AS v
  FROM entity_identifiers WHERE trim(id_value) <> '' AND entity_id IN (SELECT entity_id FROM ids)),
hubs AS (SELECT g, k, n, v, min(entity_id) AS hub FROM keyed GROUP BY ALL),
half AS (
  SELECT entity_id AS a, merged_into_id AS b FROM entities WHERE merged_into_id IN (SELECT entity_id FROM ids)
  UNION SELECT hub, entity_id FROM keyed JOIN hubs USING (g, k, n, v)),
links AS (SELECT a, b FROM half WHERE a <> b UNION SELECT b, a FROM half WHERE a <> b),
walk AS (
  SELECT DISTINCT a AS start, a AS node FROM links
  UNION SELECT w.start, l.b FROM walk w JOIN links l ON l.a = w.node),
found AS (SELECT min(start) AS group_id, node AS entity_id FROM walk GROUP BY node)
"""

SQL = {
    "p2_found": _GROUPS + "SELECT group_id, entity_id FROM found",
    "p2_groups": _GROUPS + "SELECT coalesce(group_id, entity_id) AS group_id, entity_id FROM ids LEFT JOIN found USING (entity_id)",
    "p4_found": "SELECT DISTINCT artifact_id, section_no FROM handbook_sections WHERE floor(length(content) / 4.0 + 0.5) > 320",
}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

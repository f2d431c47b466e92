"""The test tables as the canonical ones, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import table

KNOWN, VALID = "2024-09-01 00:00:00", "2024-06-01 00:00:00"


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_events").distinct()


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Assertions, each once, with a lifecycle: some expire, all decay from a month after they were recorded."""
    rows = table(spark, d, "assertions").distinct()
    return (
        rows.withColumn("active_from", F.col("observed_at"))
        .withColumn("active_until", F.lit(None).cast("timestamp_ntz"))
        .withColumn("expires_at", F.when(F.col("memory_kind").isin("working", "preference"), F.col("recorded_at") + F.expr("INTERVAL 180 DAYS")))
        .withColumn("decay_starts_at", F.col("recorded_at") + F.expr("INTERVAL 30 DAYS"))
    )


def sourced(spark: SparkSession, d: str) -> DataFrame:
    """Claims with the source, trust, position and classification of their request."""
    r = requests(spark, d).select(F.col("request_id").alias("source_request_id"), "source_id", "source_sequence", "source_commit_time", "classification", "operation")
    s = table(spark, d, "sources").select("source_id", "trust_level")
    return claims(spark, d).join(r, "source_request_id").join(s, "source_id")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's latest exported state."""
    w = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("merged_at"), F.desc_nulls_last("retired_at"))
    return table(spark, d, "entities").distinct().withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


CLAIMS = """c AS (
  SELECT DISTINCT *, observed_at AS active_from, NULL::TIMESTAMP AS active_until,
    CASE WHEN memory_kind IN ('working', 'preference') THEN recorded_at + INTERVAL 180 DAY END AS expires_at,
    recorded_at + INTERVAL 30 DAY AS decay_starts_at
  FROM assertions)"""
REQUESTS = "r AS (SELECT DISTINCT * FROM ingest_events)"
SOURCED = f"""{CLAIMS}, {REQUESTS}, sc AS (
  SELECT c.*, r.source_id, r.source_sequence, r.source_commit_time, r.classification, r.operation, s.trust_level
  FROM c JOIN r ON r.request_id = c.source_request_id JOIN sources s ON s.source_id = r.source_id)"""
ENTITIES = """en AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY merged_at DESC NULLS LAST, retired_at DESC NULLS LAST) AS n
    FROM (SELECT DISTINCT * FROM entities)) WHERE n = 1)"""

"""From claims back to where they come from, and to their neighbours in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores


def chain(claims: DataFrame, requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Each claim with its request and source, kept where one is missing. Sources are left to Catalyst's size check."""
    r = requests.select(F.col("request_id").alias("source_request_id"), "source_id", "external_id", "media_type", "content_hash").dropDuplicates(["source_request_id"])
    s = sources.select("source_id", "source_name", "trust_level").dropDuplicates(["source_id"])
    return claims.join(r, "source_request_id", "left").join(s, "source_id", "left")


def evidence(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """``quality`` of the evidence for each (subject, predicate, value): links, quotes, independent sources."""
    r = requests.select(F.col("request_id").alias("source_request_id"), "source_id").dropDuplicates(["source_request_id"])
    g = claims.join(r, "source_request_id", "left").groupBy("subject_id", "predicate_name", "object_key").agg(
        F.count("source_id").alias("links"), F.count(F.when(F.col("object_kind") == "string", F.col("source_id"))).alias("quoted"), F.countDistinct("source_id").alias("sources")
    )
    return g.withColumn("quality", scores.evidence_quality(F.col("links"), F.col("quoted"), F.col("sources")))


def orphans(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Claims whose request isn't there."""
    return claims.join(requests.select(F.col("request_id").alias("source_request_id")), "source_request_id", "left_anti")


def neighbours(chunks: DataFrame, hits: DataFrame, document: str, order: list[str], key: str) -> DataFrame:
    """The previous and next chunk of each hit in reading order, found before any filter on hits.

    Reading order needs a document's chunks together: bounded by the text of one document.
    """
    w = Window.partitionBy(document).orderBy(*order)
    near = chunks.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))
    return near.join(hits.select(key).distinct(), key, "left_semi").select(key, "previous", "next")


def cited(texts: DataFrame, keys: DataFrame, most: int = 3) -> DataFrame:
    """Identifiers that texts cite: ``id``, ``idempotency_key``, ``uses``, the most cited ``most`` of each text.

    texts: id, content. keys: idempotency_key. Only tokens with a digit that are a key count.
    """
    words = texts.select("id", F.explode(F.regexp_extract_all(F.col("content"), F.lit(r"([A-Za-z0-9][A-Za-z0-9:/_-]*[0-9][A-Za-z0-9:/_-]*)"))).alias("idempotency_key"))
    g = words.groupBy("id", "idempotency_key").agg(F.count("*").alias("uses")).join(keys.select("idempotency_key").distinct(), "idempotency_key", "left_semi")
    w = Window.partitionBy("id").orderBy(F.desc("uses"), "idempotency_key")
    return g.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("id", "idempotency_key", "uses")


def status_rollup(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """Per source: requests, those with claims, claims by standing."""
    c = claims.groupBy(F.col("source_request_id").alias("request_id")).agg(F.count("*").alias("claims"), F.sum(F.col("status").isin("active", "disputed").cast("long")).alias("believed"))
    return requests.join(c, "request_id", "left").groupBy("source_id").agg(F.count("*").alias("requests"), F.count("claims").alias("with_claims"), F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"), F.coalesce(F.sum("believed"), F.lit(0)).alias("believed"))

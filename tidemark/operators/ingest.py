"""Accepting requests: each event once, conflicting redeliveries flagged, artifacts by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keys


def first_wins(requests: DataFrame) -> DataFrame:
    """One row per (source_id, idempotency_key): the first recorded, with ``deliveries`` and ``conflict``.

    A conflict is a redelivery under the same key with another content hash. First and counts combine before the shuffle,
    so a source with a third of all rows needs no special way. A null key is a key of its own.
    """
    rest = [c for c in requests.columns if c not in ("source_id", "idempotency_key")]
    first = F.min_by(F.struct(*rest), F.struct("recorded_at", "request_id"))
    g = requests.groupBy("source_id", "idempotency_key").agg(first.alias("r"), F.count("*").alias("deliveries"), (F.min("content_hash") != F.max("content_hash")).alias("conflict"))
    return g.select("source_id", "idempotency_key", "r.*", "deliveries", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def version_guard(requests: DataFrame) -> DataFrame:
    """The same for (source_id, external_id, source_sequence) where both are given: which request holds the version."""
    rows = requests.filter("external_id <> '' and source_sequence <> ''")
    return rows.groupBy("source_id", "external_id", "source_sequence").agg(F.min_by("request_id", F.struct("recorded_at", "request_id")).alias("request_id"), F.countDistinct("content_hash").alias("contents"))


def accept(new: DataFrame, accepted: DataFrame) -> DataFrame:
    """What is really new against what was accepted before, each once."""
    return first_wins(new).join(accepted.select("source_id", "idempotency_key").distinct(), ["source_id", "idempotency_key"], "left_anti")


def artifacts(requests: DataFrame) -> DataFrame:
    """Content-addressed artifacts: one per workspace and hash, where it lies in the archive, how often it came."""
    g = requests.filter("content_hash is not null").groupBy("workspace_id", "content_hash").agg(F.count("*").alias("uses"), F.min("recorded_at").alias("first_at"))
    h = F.col("content_hash")
    return g.withColumn("path", F.concat_ws("/", "workspace_id", F.lit("sha256"), F.substring(h, 1, 2), F.substring(h, 3, 2), h))


def with_keys(requests: DataFrame) -> DataFrame:
    """Derived keys: idempotency of those that bring none, partition of the work on one record."""
    own = keys.derive_key("idempotency", F.col("source_id"), F.col("external_id"), F.col("source_sequence"), F.col("content_hash"))
    return requests.withColumn("derived_key", F.when(F.coalesce("idempotency_key", F.lit("")) == "", own).otherwise(F.col("idempotency_key"))).withColumn("partition_key", keys.derive_key("partition", F.col("workspace_id"), F.col("source_id"), F.col("external_id")))


def claimable(queue: DataFrame, at: str) -> DataFrame:
    """The head of each partition of a work queue that is due and has nothing in flight; an empty partition is its own.

    queue: id, partition_key, status, visible_at, created_at, claim_expires_at.
    """
    now = F.lit(at).cast("timestamp_ntz")
    busy = queue.filter((F.col("status") == "claimed") & (F.col("claim_expires_at") > now) & (F.col("partition_key") != "")).select("partition_key").distinct()
    due = queue.filter((F.col("status") == "pending") & (F.col("visible_at") <= now)).join(busy, "partition_key", "left_anti")
    w = Window.partitionBy(F.when(F.col("partition_key") == "", F.col("id")).otherwise(F.col("partition_key"))).orderBy("visible_at", "created_at", "id")
    return due.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("items"), F.min("created_at").alias("oldest"))


def high_water(progress: DataFrame, keys_: list[str]) -> DataFrame:
    """Checkpoints that only move forward: the furthest position of each, and all that was processed."""
    return progress.groupBy(*keys_).agg(F.max(F.struct("recorded_at", "request_id")).alias("p"), F.sum("processed").cast("long").alias("processed")).select(*keys_, F.col("p.recorded_at").alias("recorded_at"), F.col("p.request_id").alias("request_id"), "processed")


def after(rows: DataFrame, recorded_at: str, request_id: str) -> DataFrame:
    """Keyset continuation: rows beyond (recorded_at, request_id)."""
    at = F.lit(recorded_at).cast("timestamp_ntz")
    return rows.filter((F.col("recorded_at") > at) | ((F.col("recorded_at") == at) & (F.col("request_id") > request_id)))

"""Consolidating observations, forgetting, decay, purge and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores


def consolidate(observations: DataFrame, least: int = 3, least_sources: int = 1, least_confidence: float = 0.5) -> DataFrame:
    """Facts that repeated observations support.

    observations: subject_id, predicate_name, object_key, assertion_id, source_id, confidence, valid_from. Counts, means and
    minima combine before the shuffle, so a group of any size is a few partial rows.
    """
    g = observations.groupBy("subject_id", "predicate_name", "object_key").agg(
        F.count("*").alias("members"),
        F.countDistinct("source_id").alias("sources"),
        (F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("confidence")).alias("mean"),  # exact sum: any order gives the same
        F.min("valid_from").alias("valid_from"),
        F.min_by("assertion_id", F.struct("recorded_at", "assertion_id")).alias("first_assertion_id"),
    )
    g = g.withColumn("confidence", scores.consolidated(F.col("mean"), F.col("members"), F.col("sources")))
    return g.filter((F.col("members") >= least) & (F.col("sources") >= least_sources) & (F.col("confidence") >= least_confidence)).drop("mean")


def not_yet_derived(groups: DataFrame, derived: DataFrame) -> DataFrame:
    """Groups whose fact isn't there already, so that consolidating twice adds nothing."""
    return groups.join(derived.select("subject_id", "predicate_name", "object_key").distinct(), ["subject_id", "predicate_name", "object_key"], "left_anti")


def deactivated(claims: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Move the context clock of the named claims (assertion_id): nothing about world or knowledge changes."""
    named = ids.select("assertion_id").distinct().withColumn("named", F.lit(True))
    return claims.join(named, "assertion_id", "left").withColumn("active_until", F.when(F.col("named"), F.least(F.coalesce("active_until", F.lit(at).cast("timestamp_ntz")), F.lit(at).cast("timestamp_ntz"))).otherwise(F.col("active_until"))).drop("named")


def reactivated(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Take back a deactivation; an expiry that the source set stays."""
    named = ids.select("assertion_id").distinct().withColumn("named", F.lit(True))
    return claims.join(named, "assertion_id", "left").withColumn("active_until", F.when(F.col("named").isNull(), F.col("active_until"))).drop("named")


FORGETTABLE = ("deactivate", "expire", "retract", "suppress")


def closed_before(cutoff: Column) -> Column:
    """Whether a claim was over before the cut-off: quarantined, superseded, retracted, or its last end is past."""
    ended = F.greatest("valid_to", "expires_at")
    return (
        (F.col("status") == "quarantined")
        | ((F.col("status") == "superseded") & F.coalesce(F.col("superseded_at") < cutoff, F.lit(False)))
        | ((F.col("status") == "retracted") & F.coalesce(F.col("retracted_at") < cutoff, F.lit(False)))
        | (F.col("status").isin("active", "disputed") & F.coalesce(ended < cutoff, F.lit(False)))
    )


def purgeable(requests: DataFrame, claims: DataFrame, held: DataFrame, cutoff: Column) -> DataFrame:
    """Requests recorded before the cut-off, without a hold, all of whose claims are closed, and no retained claim refers to.

    requests: request_id, recorded_at. claims: assertion_id, source_request_id, supersedes_id and what ``closed_before`` reads.
    """
    old = requests.filter(F.col("recorded_at") < cutoff).select("request_id").distinct()
    old = old.join(held.select("request_id").distinct(), "request_id", "left_anti")
    alive = claims.filter(~F.coalesce(closed_before(cutoff), F.lit(False))).select(F.col("source_request_id").alias("request_id")).distinct()
    candidates = old.join(alive, "request_id", "left_anti")
    retained = claims.join(candidates.withColumnRenamed("request_id", "source_request_id"), "source_request_id", "left_anti").select(F.col("supersedes_id").alias("assertion_id")).dropna().distinct()
    needed = claims.join(retained, "assertion_id", "left_semi").select(F.col("source_request_id").alias("request_id")).distinct()
    return candidates.join(needed, "request_id", "left_anti")


def prunable_months(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Month partitions that lie wholly before the cut-off: ``month``, ``rows``."""
    month = F.date_trunc("month", at).cast("timestamp_ntz")
    g = rows.groupBy(month.alias("month")).agg(F.count("*").alias("rows"))
    return g.filter(F.add_months("month", 1).cast("timestamp_ntz") <= cutoff)

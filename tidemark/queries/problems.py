"""Registered queries of the general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import change_feed, known_at, late_events, periods
from tidemark.plans.tables import Scratch, table


def _arrival() -> Column:
    return F.coalesce("source_commit_time", "recorded_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.late_events(table(spark, d, "ingest_events"), "source_id", "idempotency_key", "event_time", _arrival())


def p1_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return late_events.period_counts(table(spark, d, "ingest_events"), "source_id", "idempotency_key", "event_time", _arrival())


def p1_corrections(spark: SparkSession, d: str) -> DataFrame:
    return late_events.corrections(table(spark, d, "ingest_events"), "source_id", "idempotency_key", "event_time", _arrival())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    state = change_feed.current_state(table(spark, d, "change_events"), "stream_name", "record_key", "operation", "source_sequence")
    return state.select(F.col("stream").alias("stream_name"), "record_id", "source_sequence")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    state = change_feed.current_state(table(spark, d, "change_events"), "stream_name", "record_key", "operation", "source_sequence", "after_image")
    return state.select(F.col("stream").alias("stream_name"), "record_id", "source_sequence", F.col("image").alias("after_image"))


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """The feed as four batches by arrival, compacted after the second."""
    feed, kept = table(spark, d, "change_events"), change_feed.ChangeTable(spark, Scratch(spark).folder())
    arrived = F.coalesce(F.quarter("recorded_at"), F.lit(1))
    for number in range(1, 5):
        kept.append(change_feed.changes(feed.filter(arrived == number), "stream_name", "record_key", "operation", "source_sequence", "after_image"), number)
        if number == 2:
            kept.compact()
    return kept.state().select(F.col("stream").alias("stream_name"), "record_id", "source_sequence", F.col("image").alias("after_image"))


SLOT = ("subject_id", "predicate")


def _slot_intervals(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "assertions").filter(F.col("status").isin("active", "disputed"))
    rows = periods.slot_intervals(claims, {"subject_id": "subject_id", "predicate": "predicate_name"}, "valid_from", "valid_to")
    return periods.of_slots(rows, table(spark, d, "conflict_sets").select(*SLOT), SLOT)


def _text(c: str) -> Column:
    return F.substring(F.col(c).cast("string"), 1, 19).alias(c)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.gaps(_slot_intervals(spark, d), SLOT).select(*SLOT, _text("gap_from"), _text("gap_to"))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods.periods(_slot_intervals(spark, d), SLOT).select(*SLOT, _text("period_from"), _text("period_to"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assertions")
    e = F.col("event_time")
    events = rows.filter("memory_kind = 'episodic'").select(F.col("subject_id").alias("subject"), F.col("assertion_id").alias("event_id"), e.alias("known_at"), e.alias("valid_at"))
    claims = rows.filter("memory_kind = 'semantic'").select(F.col("subject_id").alias("subject"), F.col("predicate_name").alias("attribute"), F.col("assertion_id").alias("claim_id"), "valid_from", "valid_to", "recorded_at", F.least("superseded_at", "retracted_at").alias("closed_at"))
    return known_at.known_at(events, claims)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select(F.col("event_id").alias("event_claim_id"), F.col("claim_id").alias("known_claim_id")).distinct()


def p6_known_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select(F.col("event_id").alias("event_claim_id"), F.col("attribute").alias("predicate_name"), F.col("claim_id").alias("known_claim_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_daily_counts, p1_corrections, p3_found, p3_state, p3_batches, p5_found, p5_periods, p6_found, p6_known_attributes)}

_EVENTS = """
WITH ev AS (
  SELECT source_id, idempotency_key, min(coalesce(source_commit_time, recorded_at)) AS arrived, max(event_time) AS happened
  FROM ingest_events GROUP BY 1, 2)
"""
_LATE = "arrived > date_trunc('day', happened) + INTERVAL 3 DAY"

_FEED = """
WITH feed AS (
  SELECT stream_name, source_sequence, after_image, lower(trim(operation)) AS op,
    (SELECT string_agg(k || '=' || coalesce(json_extract_string(record_key, '$."' || k || '"'), 'null'), ',' ORDER BY k)
     FROM (SELECT unnest(json_keys(record_key)) AS k)) AS record_id
  FROM change_events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stream_name, record_id ORDER BY
      CASE WHEN regexp_full_match(source_sequence, '[0-9]+') THEN length(ltrim(source_sequence, '0')) ELSE 0 END DESC,
      CASE WHEN regexp_full_match(source_sequence, '[0-9]+') THEN ltrim(source_sequence, '0') ELSE source_sequence END DESC,
      after_image DESC NULLS LAST) AS n
  FROM feed WHERE op IN ('insert', 'update', 'snapshot', 'delete'))
"""

_COVER = """
WITH iv AS (
  SELECT DISTINCT a.subject_id, a.predicate_name AS predicate, coalesce(valid_from, TIMESTAMP '0001-01-01 00:00:00') AS lo,
    coalesce(valid_to, TIMESTAMP '9999-12-31 23:59:59.999999') AS hi
  FROM assertions a WHERE status IN ('active', 'disputed')
    AND EXISTS (SELECT 1 FROM conflict_sets c WHERE c.subject_id = a.subject_id AND c.predicate = a.predicate_name)),
cv AS (
  SELECT *, max(hi) OVER (PARTITION BY subject_id, predicate ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM iv WHERE hi > lo)
"""

_KNOWN = """
WITH ranked AS (
  SELECT e.assertion_id AS event_claim_id, k.predicate_name, k.assertion_id AS known_claim_id,
    row_number() OVER (PARTITION BY e.assertion_id, k.predicate_name ORDER BY k.recorded_at DESC, k.assertion_id DESC) AS n
  FROM (SELECT DISTINCT assertion_id, subject_id, event_time FROM assertions WHERE memory_kind = 'episodic' AND event_time IS NOT NULL) e
  JOIN (SELECT DISTINCT assertion_id, subject_id, predicate_name, valid_from, valid_to, recorded_at, superseded_at, retracted_at
        FROM assertions WHERE memory_kind = 'semantic') k
    ON k.subject_id = e.subject_id AND (k.valid_from IS NULL OR k.valid_from <= e.event_time)
    AND (k.valid_to IS NULL OR k.valid_to > e.event_time) AND k.recorded_at <= e.event_time
    AND (k.superseded_at IS NULL OR k.superseded_at > e.event_time) AND (k.retracted_at IS NULL OR k.retracted_at > e.event_time))
"""

SQL = {
    "p1_found": _EVENTS + f"SELECT source_id, idempotency_key FROM ev WHERE {_LATE}",
    "p1_daily_counts": _EVENTS + f"""
      SELECT source_id, date_trunc('day', happened)::TIMESTAMP AS period_start, count(*) AS events
      FROM ev WHERE happened IS NOT NULL AND arrived IS NOT NULL AND NOT ({_LATE}) GROUP BY 1, 2""",
    "p1_corrections": _EVENTS + f""",
      ok AS (SELECT source_id, date_trunc('day', happened)::TIMESTAMP AS period_start, arrived FROM ev WHERE happened IS NOT NULL AND arrived IS NOT NULL AND NOT ({_LATE})),
      tick AS (SELECT source_id, period_start, greatest(period_start + INTERVAL 1 DAY, CASE WHEN arrived = date_trunc('day', arrived) THEN arrived ELSE date_trunc('day', arrived) + INTERVAL 1 DAY END)::TIMESTAMP AS published_at, count(*) AS n FROM ok GROUP BY 1, 2, 3),
      cum AS (SELECT *, sum(n) OVER (PARTITION BY source_id, period_start ORDER BY published_at) AS upto FROM tick)
      SELECT source_id, period_start, published_at, (upto - n)::BIGINT AS old_events, upto::BIGINT AS new_events FROM cum""",
    "p3_found": _FEED + "SELECT stream_name, record_id, source_sequence FROM ranked WHERE n = 1 AND op <> 'delete'",
    "p3_state": _FEED + "SELECT stream_name, record_id, source_sequence, after_image FROM ranked WHERE n = 1 AND op <> 'delete'",
    "p3_batches": _FEED + "SELECT stream_name, record_id, source_sequence, after_image FROM ranked WHERE n = 1 AND op <> 'delete'",
    "p5_found": _COVER + """
      SELECT subject_id, predicate, strftime(reach, '%Y-%m-%d %H:%M:%S') AS gap_from, strftime(lo, '%Y-%m-%d %H:%M:%S') AS gap_to
      FROM cv WHERE reach < lo""",
    "p5_periods": _COVER + """,
      st AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < lo THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM cv),
      pr AS (SELECT subject_id, predicate, g, min(lo) AS lo, max(hi) AS hi FROM st GROUP BY 1, 2, 3)
      SELECT subject_id, predicate,
        CASE WHEN lo > TIMESTAMP '0001-01-01 00:00:00' THEN strftime(lo, '%Y-%m-%d %H:%M:%S') END AS period_from,
        CASE WHEN hi < TIMESTAMP '9999-12-31 23:59:59.999999' THEN strftime(hi, '%Y-%m-%d %H:%M:%S') END AS period_to
      FROM pr""",
    "p6_found": _KNOWN + "SELECT DISTINCT event_claim_id, known_claim_id FROM ranked WHERE n = 1",
    "p6_known_attributes": _KNOWN + "SELECT event_claim_id, predicate_name, known_claim_id FROM ranked WHERE n = 1",
}

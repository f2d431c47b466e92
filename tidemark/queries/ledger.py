"""Queries of ingestion, change logs, decoding, projections, provenance and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keys, ordering, scores, text, vectors
from tidemark.operators import asof, ingest, ledger, projection, provenance
from tidemark.plans import retrieve
from tidemark.operators.change_feed import changes, position
from tidemark.plans.tables import spread, table
from tidemark.queries.bindings import CLAIMS, ENTITIES, REQUESTS, SOURCED, claims, entities, requests, sourced
from tidemark.queries.retrieval import FNV, hashed
from tidemark.sources import change_log, chunks, decode, portable

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ingestion


@query(f"""WITH {REQUESTS} SELECT source_id, idempotency_key, arg_min(request_id, (recorded_at, request_id)) AS request_id, count(*) AS deliveries, coalesce(min(content_hash) <> max(content_hash), false) AS conflict FROM r GROUP BY 1, 2""")
def dedupe_idempotency(spark, d):
    return ingest.first_wins(requests(spark, d)).select("source_id", "idempotency_key", "request_id", "deliveries", "conflict")


@query(f"WITH {REQUESTS} SELECT source_id, count(*) AS keys, count(*) FILTER (n > 1) AS redelivered FROM (SELECT source_id, idempotency_key, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1")
def idempotency_conflicts(spark, d):
    return ingest.first_wins(requests(spark, d)).groupBy("source_id").agg(F.count("*").alias("keys"), F.count(F.when(F.col("deliveries") > 1, 1)).alias("redelivered"))


@query(f"WITH {REQUESTS} SELECT source_id, external_id, source_sequence, arg_min(request_id, (recorded_at, request_id)) AS request_id, count(DISTINCT content_hash) AS contents FROM r WHERE external_id <> '' AND source_sequence <> '' GROUP BY 1, 2, 3")
def external_version_guard(spark, d):
    return ingest.version_guard(requests(spark, d))


@query(f"""WITH {REQUESTS} SELECT source_id, count(*) AS accepted FROM (SELECT DISTINCT source_id, idempotency_key FROM r WHERE recorded_at >= TIMESTAMP '2025-06-01') n
 WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.recorded_at < TIMESTAMP '2025-06-01' AND o.source_id = n.source_id AND o.idempotency_key = n.idempotency_key) GROUP BY 1""")
def accept_new(spark, d):
    r = requests(spark, d)
    at = asof.instant("2025-06-01 00:00:00")
    return ingest.accept(r.filter(F.col("recorded_at") >= at), r.filter(F.col("recorded_at") < at)).groupBy("source_id").agg(F.count("*").alias("accepted"))


@query(f"WITH {REQUESTS} SELECT workspace_id, content_hash, count(*) AS uses, min(recorded_at) AS first_at, workspace_id || '/sha256/' || content_hash[1:2] || '/' || content_hash[3:4] || '/' || content_hash AS path FROM r WHERE content_hash IS NOT NULL GROUP BY 1, 2")
def artifacts(spark, d):
    return ingest.artifacts(requests(spark, d))


_KEY = "sha256(concat_ws(chr(0), 'v1', %s))"


@query(f"""WITH {REQUESTS} SELECT request_id, {_KEY % "'partition', coalesce(workspace_id, ''), coalesce(source_id, ''), coalesce(external_id, '')"} AS partition_key,
 CASE WHEN coalesce(idempotency_key, '') = '' THEN {_KEY % "'idempotency', coalesce(source_id, ''), coalesce(external_id, ''), coalesce(source_sequence, ''), coalesce(content_hash, '')"} ELSE idempotency_key END AS derived_key FROM r""")
def derive_keys(spark, d):
    return ingest.with_keys(requests(spark, d)).select("request_id", "partition_key", "derived_key")


_QUEUE = f"""{REQUESTS}, q AS (SELECT request_id AS id, coalesce(external_id, '') AS partition_key, CASE WHEN operation = 'correction' THEN 'claimed' WHEN operation = 'delete' THEN 'done' ELSE 'pending' END AS status,
 recorded_at AS visible_at, coalesce(source_commit_time, recorded_at) AS created_at, recorded_at + INTERVAL 30 DAY AS claim_expires_at FROM r)"""


def _queue(spark, d) -> DataFrame:
    return requests(spark, d).select(
        F.col("request_id").alias("id"), F.coalesce("external_id", F.lit("")).alias("partition_key"), F.when(F.col("operation") == "correction", "claimed").when(F.col("operation") == "delete", "done").otherwise("pending").alias("status"),
        F.col("recorded_at").alias("visible_at"), F.coalesce("source_commit_time", "recorded_at").alias("created_at"), (F.col("recorded_at") + F.expr("INTERVAL 30 DAYS")).alias("claim_expires_at"),
    )


@query(f"""WITH {_QUEUE} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY CASE WHEN partition_key = '' THEN id ELSE partition_key END ORDER BY visible_at, created_at, id) AS n FROM q
 WHERE status = 'pending' AND visible_at <= TIMESTAMP '2025-06-01' AND (partition_key = '' OR NOT EXISTS (SELECT 1 FROM q b WHERE b.partition_key = q.partition_key AND b.status = 'claimed' AND b.claim_expires_at > TIMESTAMP '2025-06-01'))) WHERE n = 1""")
def outbox_claimable(spark, d):
    return ingest.claimable(_queue(spark, d), "2025-06-01 00:00:00").select("id")


@query(f"WITH {_QUEUE} SELECT status, count(*) AS items, min(created_at) AS oldest FROM q GROUP BY 1")
def outbox_depth(spark, d):
    return ingest.depth(_queue(spark, d))


@query(f"WITH {REQUESTS} SELECT source_id, max(recorded_at) AS recorded_at, arg_max(request_id, (recorded_at, request_id)) AS request_id, count(*) AS processed FROM r GROUP BY 1")
def checkpoint_high_water(spark, d):
    return ingest.high_water(requests(spark, d).withColumn("processed", F.lit(1)), ["source_id"])


@query(f"WITH {REQUESTS} SELECT request_id FROM r WHERE (recorded_at, request_id) > (TIMESTAMP '2025-02-01', '')")
def replay_after(spark, d):
    return ingest.after(requests(spark, d), "2025-02-01 00:00:00", "").select("request_id")


@query(f"WITH {REQUESTS} SELECT e.request_id FROM r e WHERE idempotency_key IN (SELECT idempotency_key FROM r WHERE operation = 'correction')")
def events_by_keys(spark, d):
    r = requests(spark, d)
    return r.join(r.filter("operation = 'correction'").select("idempotency_key"), "idempotency_key", "left_semi").select("request_id")


# change logs


def _feed(spark, d) -> DataFrame:
    """The change feed, each change once."""
    t = table(spark, d, "change_events")
    op = F.lower(F.trim("operation"))
    return t.select("stream_name", op.alias("operation"), F.col("record_key").alias("key"), F.col("before_image").alias("before"), F.col("after_image").alias("after"), "source_sequence", "change_offset").withColumn("record_id", change_log.record_id(F.col("key"))).withColumn("at", position(F.col("source_sequence")))


_RECORD = """(SELECT string_agg(k || '=' || coalesce(json_extract_string(record_key, '$."' || k || '"'), 'null'), ',' ORDER BY k) FROM (SELECT unnest(json_keys(record_key)) AS k))"""
_ORDER = """CASE WHEN regexp_full_match(source_sequence, '[0-9]+') THEN length(ltrim(source_sequence, '0')) ELSE 0 END, CASE WHEN regexp_full_match(source_sequence, '[0-9]+') THEN ltrim(source_sequence, '0') ELSE source_sequence END"""
_F = f"""f AS (SELECT DISTINCT stream_name, lower(trim(operation)) AS operation, {_RECORD} AS record_id, source_sequence, json_extract_string(after_image, '$.state') AS state, json_extract_string(after_image, '$.amount') AS amount,
  json_extract_string(after_image, '$.rev') AS rev, json_extract_string(after_image, '$.tier') AS tier FROM change_events)"""


@query(f"WITH {_F} SELECT DISTINCT stream_name, record_id, source_sequence, operation FROM f")
def change_record_ids(spark, d):
    return _feed(spark, d).select("stream_name", "record_id", "source_sequence", "operation").distinct()


@query("""WITH c AS (SELECT DISTINCT change_id, before_image AS b, after_image AS a FROM change_events WHERE before_image IS NOT NULL AND after_image IS NOT NULL),
 k AS (SELECT change_id, b, a, unnest(list_distinct(json_keys(b) || json_keys(a))) AS n FROM c),
 x AS (SELECT change_id, n FROM k WHERE json_extract_string(b, '$."' || n || '"') IS DISTINCT FROM json_extract_string(a, '$."' || n || '"') OR list_contains(json_keys(b), n) <> list_contains(json_keys(a), n))
 SELECT change_id, string_agg(n, ',' ORDER BY n) AS changed FROM x GROUP BY 1""")
def cdc_changed_columns(spark, d):
    t = table(spark, d, "change_events").filter("before_image is not null and after_image is not null").select("change_id", "before_image", "after_image").distinct()
    names = change_log.changed_columns(F.col("before_image"), F.col("after_image"))
    return t.select("change_id", F.array_join(names, ",").alias("changed")).filter("changed <> ''").distinct()


MAPPING = [("state", "STATE", "symbol", True), ("amount", "AMOUNT", "decimal", True), ("rev", "REVISION", "integer", False), ("tier", "TIER", "symbol", True)]
_CLAIMED = f"""{_F}, u AS (SELECT stream_name, record_id, source_sequence, 'STATE' AS predicate, 'symbol' AS kind, state AS value FROM f WHERE trim(state) <> ''
   UNION ALL SELECT stream_name, record_id, source_sequence, 'AMOUNT', CASE WHEN try_cast(amount AS DECIMAL(38, 18)) IS NULL THEN 'string' ELSE 'decimal' END, amount FROM f WHERE trim(amount) <> ''
   UNION ALL SELECT stream_name, record_id, source_sequence, 'REVISION', CASE WHEN try_cast(rev AS BIGINT) IS NULL THEN 'string' ELSE 'integer' END, rev FROM f WHERE rev IS NOT NULL
   UNION ALL SELECT stream_name, record_id, source_sequence, 'TIER', 'symbol', tier FROM f WHERE trim(tier) <> ''),
 cc AS (SELECT DISTINCT stream_name, record_id, source_sequence, predicate, kind || ':' || CASE kind WHEN 'symbol' THEN upper(value) WHEN 'decimal' THEN regexp_replace(regexp_replace(value::DECIMAL(38, 18)::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') ELSE value END AS object_key FROM u)"""


def _column_claims(spark, d) -> DataFrame:
    rows = _feed(spark, d).filter("after is not null")
    return change_log.column_claims(rows, MAPPING).select("stream_name", "record_id", "at", "source_sequence", "predicate", "object_key").distinct()


@query(f"WITH {_CLAIMED} SELECT stream_name, record_id, source_sequence, predicate, object_key FROM cc")
def cdc_column_claims(spark, d):
    return _column_claims(spark, d).drop("at")


@query(f"""WITH {_CLAIMED}, o AS (SELECT *, lag(object_key) OVER (PARTITION BY stream_name, record_id, predicate ORDER BY {_ORDER}) AS prior FROM cc)
 SELECT stream_name, record_id, source_sequence, predicate, object_key FROM o WHERE prior IS DISTINCT FROM object_key OR prior IS NULL""")
def cdc_unchanged_suppression(spark, d):
    at = [F.col("at.kind"), F.col("at.size"), F.col("at.body")]
    return change_log.without_unchanged(_column_claims(spark, d), ["stream_name", "record_id", "predicate"], at).drop("at")


@query(f"""WITH {_F}, o AS (SELECT stream_name, record_id, source_sequence, operation, row_number() OVER (PARTITION BY stream_name ORDER BY record_id, {_ORDER}) AS n FROM (SELECT DISTINCT stream_name, record_id, source_sequence, operation FROM f)),
 g AS (SELECT a.stream_name, a.record_id, a.source_sequence, min(b.n) AS gone FROM o a LEFT JOIN o b ON b.stream_name = a.stream_name AND b.record_id = a.record_id AND b.operation = 'delete' AND b.n > a.n WHERE a.operation <> 'delete' GROUP BY 1, 2, 3)
 SELECT g.stream_name, g.record_id, g.source_sequence, o.source_sequence AS retracted_by FROM g LEFT JOIN o ON o.stream_name = g.stream_name AND o.n = g.gone""")
def cdc_tombstones(spark, d):
    feed = changes(table(spark, d, "change_events"), "stream_name", "record_key", "operation", "source_sequence")
    upserts = feed.filter("sets").select("stream", "record_id", "at").distinct()
    found = change_log.tombstoned(upserts, feed)
    return found.select(F.col("stream").alias("stream_name"), "record_id", F.col("at.raw").alias("source_sequence"), "retracted_by")


@query(f"WITH {_F} SELECT stream_name, count(DISTINCT record_id) AS records, count(*) FILTER (operation = 'delete') AS deletes FROM (SELECT DISTINCT stream_name, record_id, source_sequence, operation FROM f) GROUP BY 1")
def cdc_stream_counts(spark, d):
    rows = _feed(spark, d).select("stream_name", "record_id", "source_sequence", "operation").distinct()
    return rows.groupBy("stream_name").agg(F.countDistinct("record_id").alias("records"), F.count(F.when(F.col("operation") == "delete", 1)).alias("deletes"))


@query("""WITH f AS (SELECT DISTINCT change_id, stream_name, lower(trim(operation)) AS op, record_key, coalesce(after_image, before_image) AS shown FROM change_events)
 SELECT DISTINCT change_id, concat_ws(chr(10), concat_ws(' ', stream_name, op, stream_name || ':' || (SELECT string_agg(k || '=' || coalesce(json_extract_string(record_key, '$."' || k || '"'), 'null'), ',' ORDER BY k) FROM (SELECT unnest(json_keys(record_key)) AS k))),
   (SELECT string_agg(k || ': ' || coalesce(json_extract_string(shown, '$."' || k || '"'), 'null'), chr(10) ORDER BY k) FROM (SELECT unnest(json_keys(shown)) AS k))) AS content FROM f""")
def change_row_text(spark, d):
    rows = table(spark, d, "change_events").select("change_id", change_log.row_text(F.col("stream_name"), F.lower(F.trim("operation")), F.col("record_key"), F.coalesce("after_image", "before_image")).alias("content"))
    return rows.distinct()


# decoding


@query()
def decoded_segments(spark, d):
    """Every document decoded by its media type."""
    return decode.decode(table(spark, d, "documents"), "doc_id", "media_type", "text").withColumnRenamed("id", "doc_id").select("doc_id", "sequence", "content_type", "section", "row_key", "char_start", "char_end", "content")


@query()
def markdown_sections(spark, d):
    rows = table(spark, d, "documents").filter("media_type = 'text/markdown'")
    found = decode.decode(rows, "doc_id", "media_type", "text")
    return found.groupBy("heading_level").agg(F.count("*").alias("sections"), F.sum(F.length("content")).alias("chars"))


@query()
def document_chunks(spark, d):
    segments = decode.decode(table(spark, d, "documents"), "doc_id", "media_type", "text").select(F.col("id").alias("doc_id"), "sequence", F.col("content").alias("segment"), F.col("char_start").alias("segment_start"))
    found = chunks.chunk(segments, "segment", ["doc_id", "sequence", "segment_start"])
    return found.select("doc_id", "sequence", "chunk", "token_count", (F.col("segment_start") + F.col("char_start")).alias("char_start"), "content")


@query("""WITH s AS (SELECT DISTINCT artifact_id, section_no, content FROM handbook_sections WHERE trim(content) <> ''), w AS (SELECT artifact_id, section_no, lag(section_no) OVER o AS previous, lead(section_no) OVER o AS next, content FROM s WINDOW o AS (PARTITION BY artifact_id ORDER BY section_no))
 SELECT artifact_id, section_no, previous, next FROM w WHERE contains(lower(content), 'refund') OR contains(lower(content), 'invoice')""")
def chunk_neighbors(spark, d):
    s = table(spark, d, "handbook_sections").filter("trim(content) <> ''").select("artifact_id", "section_no", "content").distinct().withColumn("key", F.struct("artifact_id", "section_no"))
    hits = s.filter(F.contains(F.lower("content"), F.lit("refund")) | F.contains(F.lower("content"), F.lit("invoice")))
    near = provenance.neighbours(s, hits, "artifact_id", ["section_no"], "key")
    return near.select("key.artifact_id", "key.section_no", F.col("previous.section_no").alias("previous"), F.col("next.section_no").alias("next"))


# projections and provenance


@query(f"""WITH {CLAIMS}, {ENTITIES} SELECT assertion_id AS record_id, trim(coalesce(canonical_name, subject_id)) || ' ' || lower(replace(predicate_name, '_', ' ')) || ' ' || trim(substr(object_key, position(':' IN object_key) + 1)) AS content
 FROM c LEFT JOIN en ON en.entity_id = c.subject_id WHERE status NOT IN ('quarantined', 'retracted')""")
def project_claims(spark, d):
    return projection.claim_records(claims(spark, d), entities(spark, d)).select("record_id", "content")


@query(f"WITH {ENTITIES} SELECT entity_id AS record_id, canonical_name || ' (' || coalesce(entity_type, 'unknown') || ')' AS content FROM en WHERE retired_at IS NULL AND canonical_name IS NOT NULL")
def project_entities(spark, d):
    return projection.entity_records(entities(spark, d)).select("record_id", "content")


@query(f"""WITH {CLAIMS} SELECT assertion_id, CASE WHEN valid_from IS NOT NULL AND valid_to IS NOT NULL THEN '[' || strftime(valid_from, '%Y-%m-%d') || ' to ' || strftime(valid_to, '%Y-%m-%d') || ']'
 WHEN valid_from IS NOT NULL THEN '[since ' || strftime(valid_from, '%Y-%m-%d') || ']' WHEN valid_to IS NOT NULL THEN '[until ' || strftime(valid_to, '%Y-%m-%d') || ']' END AS qualifier FROM c""")
def validity_qualifiers(spark, d):
    return claims(spark, d).select("assertion_id", projection.validity(F.col("valid_from"), F.col("valid_to")).alias("qualifier"))


@query("""SELECT entity_id, arg_max(canonical_name, (coalesce(merged_at, TIMESTAMP '0001-01-01'), canonical_name)) AS canonical_name, max(coalesce(merged_at, TIMESTAMP '0001-01-01')) AS at FROM entities WHERE canonical_name IS NOT NULL GROUP BY 1""")
def latest_upsert(spark, d):
    rows = table(spark, d, "entities").filter("canonical_name is not null").select("entity_id", "canonical_name", F.coalesce("merged_at", F.expr("timestamp_ntz'0001-01-01 00:00:00'")).alias("at"))
    return projection.latest(rows, ["entity_id"], "at")


@query("SELECT count(*) AS texts, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT text FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'de' AND o.text = d.text))")
def embed_only_new(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"), "lang").filter("content is not null")
    done = docs.filter("lang = 'de'").select(keys.content_hash(F.col("content")).alias("content_hash")).distinct()
    return projection.to_embed(docs, done).agg(F.count("*").alias("texts"), F.sum(F.length("content")).alias("chars"))


@query(f"""WITH {CLAIMS}, {ENTITIES}, rec AS (SELECT DISTINCT assertion_id AS id, concat_ws(' ', trim(coalesce(canonical_name, subject_id)), lower(replace(predicate_name, '_', ' ')), trim(substr(object_key, position(':' IN object_key) + 1))) AS content
   FROM c LEFT JOIN en ON en.entity_id = c.subject_id WHERE status NOT IN ('quarantined', 'retracted')), {hashed("rec", "hv")} SELECT id AS record_id, bucket, round(weight, 6) AS weight FROM hv""")
def hashed_embeddings(spark, d):
    records = projection.claim_records(claims(spark, d), entities(spark, d))
    return projection.hashed_embedding(records).withColumn("weight", F.round("weight", 6))


@query(f"WITH {SOURCED} SELECT assertion_id, external_id, source_name, sc.trust_level FROM sc JOIN r ON r.request_id = sc.source_request_id JOIN sources s ON s.source_id = sc.source_id")
def provenance_chain(spark, d):
    return provenance.chain(claims(spark, d), requests(spark, d), table(spark, d, "sources")).select("assertion_id", "external_id", "source_name", "trust_level")


@query(f"""WITH {SOURCED} SELECT subject_id, predicate_name, object_key, count(*) AS links, count(DISTINCT source_id) AS sources,
 (0.6 + CASE WHEN count(*) FILTER (object_kind = 'string') > 0 THEN 0.25 ELSE 0 END + CASE WHEN count(DISTINCT source_id) > 1 THEN 0.15 ELSE 0 END)::DOUBLE AS quality FROM sc GROUP BY 1, 2, 3""")
def evidence_quality(spark, d):
    return provenance.evidence(claims(spark, d), requests(spark, d)).select("subject_id", "predicate_name", "object_key", "links", "sources", "quality")


@query(f"WITH {CLAIMS}, {REQUESTS} SELECT assertion_id FROM c WHERE source_request_id NOT IN (SELECT request_id FROM r WHERE operation <> 'delete')")
def orphan_evidence_anti(spark, d):
    return provenance.orphans(claims(spark, d), requests(spark, d).filter("operation <> 'delete'")).select("assertion_id")


@query(f"""WITH {CLAIMS}, {REQUESTS}, k AS (SELECT source_request_id, count(*) AS claims, count(*) FILTER (status IN ('active', 'disputed')) AS believed FROM c GROUP BY 1)
 SELECT source_id, count(*) AS requests, count(claims) AS with_claims, coalesce(sum(claims), 0)::BIGINT AS claims, coalesce(sum(believed), 0)::BIGINT AS believed FROM r LEFT JOIN k ON k.source_request_id = r.request_id GROUP BY 1""")
def event_status_rollup(spark, d):
    return provenance.status_rollup(requests(spark, d), claims(spark, d))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9:/_-]*[0-9][A-Za-z0-9:/_-]*')) AS k FROM documents), g AS (SELECT doc_id, k, count(*) AS uses FROM w GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, k) AS n FROM g WHERE k IN (SELECT upper(external_id) FROM ingest_events)) SELECT doc_id, k AS cited, uses FROM n WHERE n <= 3""")
def cited_identifiers(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = provenance.cited(texts, table(spark, d, "ingest_events").select(F.upper("external_id").alias("idempotency_key")))
    return found.select(F.col("id").alias("doc_id"), F.col("idempotency_key").alias("cited"), "uses")


@query()
def package_digests(spark, d):
    tables = {s: (table(spark, d, s), k) for s, k in (("sources", "source_id"), ("entities", "entity_id"), ("assertions", "assertion_id"), ("conflict_sets", "conflict_set_id"))}
    return portable.section_digests(portable.to_lines(tables))


@query("WITH n AS (SELECT DISTINCT predicate_name AS name FROM assertions) SELECT name, CASE WHEN name IN ('owned_by', 'seat_limit', 'risk_level') THEN upper(name) END AS predicate FROM n")
def predicate_lookup(spark, d):
    names = table(spark, d, "assertions").select(F.col("predicate_name").alias("name"))
    registry = spark.createDataFrame([("OWNED_BY",), ("HAS_SEAT_LIMIT",)], "predicate string")
    aliases = spark.createDataFrame([("RISK_LEVEL", "RISK_LEVEL")], "alias string, predicate string")
    found = projection.predicate_of(names, registry, aliases)
    return found.withColumn("predicate", F.regexp_replace("predicate", "^HAS_", ""))


# scalar functions over whole tables


@query(f"""WITH {CLAIMS} SELECT assertion_id, trim(regexp_replace(regexp_replace(upper(regexp_replace(predicate_name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS predicate,
 CASE object_kind WHEN 'symbol' THEN 'symbol:' || upper(substr(object_key, 8)) ELSE object_key END AS object_key FROM c""")
def normalize_predicate(spark, d):
    rows = claims(spark, d)
    return rows.select("assertion_id", text.normalize_predicate(F.col("predicate_name")).alias("predicate"), keys.object_key(F.col("object_kind"), projection.value_of(F.col("object_key"))).alias("object_key"))


@query(f"WITH {ENTITIES} SELECT entity_id, trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) AS alias FROM en")
def normalize_alias(spark, d):
    return entities(spark, d).select("entity_id", text.normalize_alias(F.col("canonical_name")).alias("alias"))


@query("SELECT doc_id, greatest(floor(length(text) / 4.0 + 0.5)::INT, 1) AS tokens FROM documents WHERE text IS NOT NULL")
def token_count(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


_SPOKEN = "[\\p{Latin}\\p{Greek}\\p{Cyrillic}]"


@query(f"""SELECT doc_id, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(floor(coalesce(list_sum(list_transform(regexp_extract_all(text, '{_SPOKEN}+|\\p{{Nd}}+|\\n|[^\\s]'),
   lambda w: CASE WHEN regexp_matches(w, '^{_SPOKEN}') THEN ceil(length(w) / 6.0) WHEN regexp_matches(w, '^\\p{{Nd}}') THEN ceil(length(w) / 3.0) ELSE 1 END)), 0) * 1.05::DOUBLE + 0.999::DOUBLE), 1) END)::INT AS tokens FROM documents WHERE text IS NOT NULL""")
def token_estimate(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text").filter("text is not null")).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_SCOPE = "CASE WHEN workspace_id IS NULL THEN '' ELSE 'kind=' || replace(url_encode(kind), '%20', '+') || ';name=' || replace(url_encode(source_name), '%20', '+') END"


@query("SELECT source_id, kind || '/' || source_name AS restored, 2 AS parts FROM sources")
def scope_key_roundtrip(spark, d):
    q = keys.qualifiers(keys.scope_key(F.create_map(F.lit("name"), F.col("source_name"), F.lit("kind"), F.col("kind"))))
    return table(spark, d, "sources").select("source_id", F.concat_ws("/", q["kind"], q["name"]).alias("restored"), F.size(q).alias("parts"))


@query("""SELECT source_id, CASE trust_level WHEN 'authoritative' THEN 1 WHEN 'high' THEN 0.95 WHEN 'standard' THEN 0.85 WHEN 'low' THEN 0.65 WHEN 'untrusted' THEN 0.4 ELSE 0.5 END::DOUBLE AS factor,
 CASE trust_level WHEN 'authoritative' THEN 1 WHEN 'standard' THEN 0.8 WHEN 'low' THEN 0.5 ELSE 0.6 END::DOUBLE AS weight, coalesce(list_position(['untrusted', 'low', 'standard', 'high', 'authoritative'], trust_level), 0)::INT AS rank FROM sources""")
def trust_scores(spark, d):
    t = F.col("trust_level")
    return table(spark, d, "sources").select("source_id", scores.trust_factor(t).alias("factor"), scores.trust_weight(t).alias("weight"), ordering.rank(t, ordering.TRUST).alias("rank"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda p: " + " OR ".join(f"regexp_matches(p, '{p.replace(chr(39), chr(39) * 2)}')" for p in text.INJECTIONS) + "))::INT AS suspicious FROM documents WHERE text IS NOT NULL")
def injection_flags(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text").filter("text is not null")).select("doc_id", F.size(text.suspicious_paragraphs(F.col("text"))).alias("suspicious"))


@query("""SELECT item_id, doc_id FROM eval_items JOIN documents ON answer IS NOT NULL AND trim(answer) <> '' AND contains(trim(regexp_replace(lower(documents.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')))""")
def grounded_quotes(spark, d):
    q = table(spark, d, "eval_items").select("item_id", text.normalize_alias(F.col("answer")).alias("quote")).filter("quote <> ''")
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize_alias(F.col("text")).alias("source"))
    return docs.join(q, F.contains("source", "quote")).select("item_id", "doc_id")


@query("""SELECT item_id, try_cast(replace(regexp_extract(answer, '^\\s*(?:([A-Z]{3}|[$€£¥])\\s*)?(-?\\d[\\d,]*(?:\\.\\d+)?)(?:\\s*([A-Z]{3}|%|[A-Za-z]+))?\\s*$', 2), ',', '') AS DECIMAL(38, 6))::DOUBLE AS amount FROM eval_items
 WHERE regexp_matches(answer, '^\\s*(?:([A-Z]{3}|[$€£¥])\\s*)?(-?\\d[\\d,]*(?:\\.\\d+)?)(?:\\s*([A-Z]{3}|%|[A-Za-z]+))?\\s*$')""")
def quantities(spark, d):
    q = text.quantity(F.col("answer"))
    return table(spark, d, "eval_items").withColumn("q", q).filter("q is not null").select("item_id", F.col("q.amount").cast("double").alias("amount"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", keys.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT DISTINCT change_id, json_extract_string(after_image, '$.state') AS state FROM change_events WHERE after_image IS NOT NULL")
def canonical_images(spark, d):
    rows = table(spark, d, "change_events").filter("after_image is not null").select("change_id", keys.canonical_json(F.col("after_image")).alias("image"))
    return rows.select("change_id", F.get_json_object("image", "$.state").alias("state")).distinct()


@query(f"WITH {ENTITIES} SELECT entity_id, ({FNV % 'canonical_name'})::BIGINT AS hash FROM en WHERE canonical_name IS NOT NULL")
def fnv_hashes(spark, d):
    return entities(spark, d).filter("canonical_name is not null").select("entity_id", vectors.fnv1a(F.col("canonical_name")).alias("hash"))


# writing


@query(f"""WITH {CLAIMS}, v AS (SELECT DISTINCT conflict_set_id, object_key FROM c WHERE conflict_set_id IS NOT NULL)
 SELECT assertion_id, coalesce((SELECT string_agg(v.object_key, '|' ORDER BY v.object_key) FROM v WHERE v.conflict_set_id = c.conflict_set_id AND v.object_key <> c.object_key), '') AS others FROM c WHERE conflict_set_id IS NOT NULL""")
def conflict_annotations(spark, d):
    return ledger.other_sides(claims(spark, d))


@query(f"""WITH {CLAIMS} SELECT assertion_id, CASE WHEN status = 'disputed' AND superseded_at IS NULL AND retracted_at IS NULL AND conflict_set_id IN (SELECT conflict_set_id FROM conflict_sets WHERE resolution <> 'open') THEN 'active' ELSE status END AS status FROM c""")
def conflict_resolve(spark, d):
    return ledger.resolved(claims(spark, d), table(spark, d, "conflict_sets").filter("resolution <> 'open'")).select("assertion_id", "status")


_PARTS = ", ".join(f"coalesce({c}::VARCHAR, '')" for c in ("workspace_id", "graph_space_id", "subject_id", "predicate_name", "object_key")) + ", '', coalesce(source_request_id, ''), coalesce(memory_kind, '')"


@query(f"WITH {CLAIMS} SELECT assertion_id, {_KEY % ("'assertion', " + _PARTS)} AS fingerprint FROM c")
def fingerprints(spark, d):
    own = ("workspace_id", "graph_space_id", "subject_id", "predicate_name", "object_key", "scope_key", "source_request_id", "memory_kind")
    rows = claims(spark, d)
    return rows.select("assertion_id", ledger.fingerprint(own, rows.columns).alias("fingerprint"))


@query(f"WITH {CLAIMS}, {REQUESTS} SELECT r.classification, count(*) AS claims, count(*) FILTER (confidence <= 0) AS lifted FROM c JOIN r ON r.request_id = c.source_request_id GROUP BY 1")
def build_claims(spark, d):
    rows = claims(spark, d).withColumn("was", F.col("confidence"))
    built = ledger.build(rows, requests(spark, d), "2026-01-01 00:00:00")
    return built.groupBy("classification").agg(F.count("*").alias("claims"), F.count(F.when(F.col("was") <= 0, 1)).alias("lifted"))


@query(f"WITH {CLAIMS} SELECT count(*) AS claims FROM (SELECT DISTINCT workspace_id, graph_space_id, subject_id, predicate_name, object_key, valid_from, valid_to, source_request_id, memory_kind FROM c)")
def commit_once(spark, d):
    rows = claims(spark, d)
    rows = rows.withColumn("fingerprint", ledger.fingerprint(ledger.FINGERPRINT, rows.columns))
    some = ledger.commit(rows.limit(0), rows.filter("memory_kind = 'semantic'"))
    return ledger.commit(some, rows).agg(F.count("*").alias("claims"))


@query()
def hybrid_query(spark, d):
    """Three questions end to end: documents and claims, entities by name, their neighbours by merges."""
    docs = table(spark, d, "documents").select(F.lit("chunk").alias("surface"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("content"))
    records = docs.unionByName(projection.claim_records(claims(spark, d), entities(spark, d)).select("surface", "record_id", "content"))
    e = entities(spark, d)
    names = e.filter("canonical_name is not null").select("entity_id", F.col("canonical_name").alias("name"))
    edges = e.filter("merged_into_id is not null").select(F.col("entity_id").alias("src"), F.col("merged_into_id").alias("dst"))
    questions = {"q1": "Which refund was disputed after the outage?", "q2": "Who reported case CASE-83453 before 2025-02-01?", "q3": "seat limit of the support region"}
    return retrieve.retrieve(records, names, edges, questions).select("query_id", "surface", "record_id", F.round("score", 6).alias("score"), "position", "anchored")

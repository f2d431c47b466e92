"""Queries of the temporal, policy, ontology and knowledge-state operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import intervals, ordering, scores
from tidemark.operators import asof, memory, ontology, policy, reconcile
from tidemark.operators.asof import ClaimQuery, claims_as_of
from tidemark.plans.tables import table
from tidemark.queries.bindings import CLAIMS, ENTITIES, KNOWN, REQUESTS, SOURCED, VALID, claims, entities, requests, sourced

QUERIES: dict = {}
SQL: dict = {}
SHOWN = ("assertion_id", "subject_id", "predicate_name", "object_key", "valid_from", "valid_to", "recorded_at")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SHOWN = ", ".join(SHOWN)
_K, _V = f"TIMESTAMP '{KNOWN}'", f"TIMESTAMP '{VALID}'"
_BELIEVED = f"recorded_at <= {_K} AND (superseded_at IS NULL OR superseded_at > {_K}) AND (retracted_at IS NULL OR retracted_at > {_K})"
_VALID = f"(valid_from IS NULL OR valid_from <= {_V}) AND (valid_to IS NULL OR valid_to > {_V})"
_OPEN = "status IN ('active', 'disputed')"


def _asked(where: str, columns: str = _SHOWN) -> str:
    return f"WITH {CLAIMS} SELECT {columns} FROM c WHERE {where}"


def _ask(spark: SparkSession, d: str, **q) -> DataFrame:
    return claims_as_of(claims(spark, d), ClaimQuery(**q)).select(*SHOWN)


@query(_asked(_BELIEVED))
def asof_belief(spark, d):
    return _ask(spark, d, known_at=KNOWN)


@query(_asked(f"{_OPEN} AND {_VALID}"))
def asof_valid(spark, d):
    return _ask(spark, d, valid_at=VALID)


@query(_asked(f"{_BELIEVED} AND {_VALID}"))
def asof_bitemporal(spark, d):
    return _ask(spark, d, known_at=KNOWN, valid_at=VALID)


@query(_asked(f"{_OPEN} AND (valid_from IS NULL OR valid_from < TIMESTAMP '2024-07-01') AND (valid_to IS NULL OR valid_to > {_V})"))
def valid_between_overlap(spark, d):
    return _ask(spark, d, valid_between=(VALID, "2024-07-01 00:00:00"))


@query(_asked(f"{_OPEN} AND event_time >= TIMESTAMP '2025-02-01' AND event_time < TIMESTAMP '2025-03-01'", _SHOWN))
def event_between(spark, d):
    return _ask(spark, d, event_between=("2025-02-01 00:00:00", "2025-03-01 00:00:00"))


@query(_asked(f"status <> 'retracted' AND (active_from IS NULL OR active_from <= {_K}) AND (active_until IS NULL OR active_until > {_K}) AND (expires_at IS NULL OR expires_at > {_K})"))
def active_at(spark, d):
    return _ask(spark, d, active_at=KNOWN, include_superseded=True)


@query(_asked(_OPEN))
def current_belief(spark, d):
    return _ask(spark, d)


@query(_asked("status <> 'retracted'"))
def include_superseded(spark, d):
    return _ask(spark, d, include_superseded=True)


@query(_asked("status IN ('superseded', 'retracted') AND memory_kind IN ('semantic') AND confidence >= 0.7 AND upper(predicate_name) IN ('SEAT_LIMIT', 'RISK_LEVEL')"))
def filtered_sets(spark, d):
    return _ask(spark, d, statuses=("superseded", "retracted"), memory_kinds=("semantic",), least_confidence=0.7, predicates=("SEAT_LIMIT", "RISK_LEVEL"))


@query(f"WITH {CLAIMS} SELECT {_SHOWN} FROM c WHERE {_OPEN} ORDER BY recorded_at DESC, assertion_id DESC LIMIT 50 OFFSET 10")
def latest_page(spark, d):
    return _ask(spark, d, limit=50, offset=10)


@query(f"""WITH {REQUESTS} SELECT request_id, source_sequence FROM r
  WHERE source_id = (SELECT max(source_id) FROM r WHERE regexp_full_match(source_sequence, '[0-9]+')) AND CASE WHEN regexp_full_match(source_sequence, '[0-9]+') THEN source_sequence::HUGEINT > 9 ELSE source_sequence > '9' END""")
def changed_since(spark, d):
    rows = requests(spark, d)
    one = rows.filter(ordering.digits(F.col("source_sequence"))).agg(F.max("source_id").alias("source_id"))
    return rows.join(one, "source_id", "left_semi").filter(asof.changed_since(F.col("source_sequence"), "9")).select("request_id", "source_sequence")


@query(f"WITH {CLAIMS}, {REQUESTS} SELECT {_SHOWN} FROM c WHERE {_OPEN} AND EXISTS (SELECT 1 FROM r WHERE r.request_id = c.source_request_id AND r.operation = 'correction')")
def source_semi(spark, d):
    return asof.from_sources(claims_as_of(claims(spark, d), ClaimQuery()), requests(spark, d).filter("operation = 'correction'")).select(*SHOWN)


@query(f"WITH {SOURCED} SELECT {_SHOWN} FROM sc WHERE {_OPEN} AND trust_level IN ('high', 'authoritative')")
def trust_floor(spark, d):
    return asof.trusted(claims_as_of(claims(spark, d), ClaimQuery()), requests(spark, d), table(spark, d, "sources"), "high").select(*SHOWN)


RULES = (
    policy.Rule("no preferences", "deny", actions=("read",), resources={"memory_kinds": ("preference",)}),
    policy.Rule("analysts", "allow", actions=("read",), roles=("reader",), max_classification="restricted"),
    policy.Rule("no restricted on weekends", "deny", actions=("read",), classifications=("restricted",), not_before=datetime(2025, 1, 4), not_after=datetime(2025, 1, 6)),
    policy.Rule("no risk", "deny", actions=("read",), resources={"predicates": ("risk_level",)}),
)
ASK = policy.Request("p1", "read", "w", datetime(2025, 3, 3), grants={"w": "reader"})
_MAY = "classification IN ('public', 'internal', 'confidential', 'restricted') AND memory_kind <> 'preference' AND predicate_name <> 'risk_level'"


def _condition():
    decision = policy.evaluate(RULES, ASK)
    return decision.filters.condition({"classification": "classification", "memory_kinds": "memory_kind", "predicates": "predicate_name", "sources": "source_id"})


@query(f"WITH {SOURCED} SELECT {_SHOWN}, classification FROM sc WHERE {_OPEN} AND {_MAY}")
def policy_filtered_claims(spark, d):
    return claims_as_of(sourced(spark, d), ClaimQuery()).filter(_condition()).select(*SHOWN, "classification")


@query(f"WITH {SOURCED} SELECT assertion_id FROM sc WHERE {_OPEN} AND NOT ({_MAY})")
def policy_denied_anti(spark, d):
    rows = claims_as_of(sourced(spark, d), ClaimQuery())
    return rows.join(rows.filter(_condition()).select("assertion_id"), "assertion_id", "left_anti").select("assertion_id")


@query(f"WITH {SOURCED} SELECT classification, count(*) AS claims, max(list_position(['public', 'internal', 'confidential', 'restricted', 'secret'], classification))::INT AS rank FROM sc GROUP BY 1")
def classification_counts(spark, d):
    return sourced(spark, d).groupBy("classification").agg(F.count("*").alias("claims"), F.max(ordering.rank(F.col("classification"), ordering.CLASSIFICATION)).alias("rank"))


_SEQ = "TIMESTAMP '0001-01-01'"


@query(f"""WITH {CLAIMS}, w AS (
  SELECT assertion_id, valid_from AS a1, valid_to AS a2, lead(valid_from) OVER o AS b1, lead(valid_to) OVER o AS b2, lead(assertion_id) OVER o AS other_id
  FROM c WHERE memory_kind = 'semantic' WINDOW o AS (PARTITION BY subject_id, predicate_name ORDER BY recorded_at, assertion_id)),
 k AS (SELECT *, CASE WHEN a1 IS NULL AND b1 IS NULL THEN 0 WHEN a1 IS NULL THEN -1 WHEN b1 IS NULL THEN 1 WHEN a1 < b1 THEN -1 WHEN a1 > b1 THEN 1 ELSE 0 END AS s,
   CASE WHEN a2 IS NULL AND b2 IS NULL THEN 0 WHEN a2 IS NULL THEN 1 WHEN b2 IS NULL THEN -1 WHEN a2 < b2 THEN -1 WHEN a2 > b2 THEN 1 ELSE 0 END AS e FROM w WHERE other_id IS NOT NULL)
 SELECT assertion_id, other_id, CASE WHEN s = 0 AND e = 0 THEN 'equals' WHEN a2 = b1 THEN 'meets' WHEN a2 < b1 THEN 'before' WHEN b2 = a1 THEN 'met_by' WHEN b2 < a1 THEN 'after'
   WHEN s = 0 AND e < 0 THEN 'starts' WHEN s = 0 THEN 'started_by' WHEN e = 0 AND s > 0 THEN 'finishes' WHEN e = 0 THEN 'finished_by'
   WHEN s < 0 AND e < 0 THEN 'overlaps' WHEN s > 0 AND e > 0 THEN 'overlapped_by' WHEN s > 0 AND e < 0 THEN 'during' ELSE 'contains' END AS relation FROM k""")
def allen_relations(spark, d):
    w = Window.partitionBy("subject_id", "predicate_name").orderBy("recorded_at", "assertion_id")
    rows = claims(spark, d).filter("memory_kind = 'semantic'").select("assertion_id", "valid_from", "valid_to", F.lead("valid_from").over(w).alias("b1"), F.lead("valid_to").over(w).alias("b2"), F.lead("assertion_id").over(w).alias("other_id"))
    return rows.filter("other_id is not null").select("assertion_id", "other_id", intervals.allen("valid_from", "valid_to", "b1", "b2").alias("relation"))


@query(f"""WITH {SOURCED} SELECT a.assertion_id, b.assertion_id AS later_id,
  CASE WHEN a.source_id <> b.source_id THEN 2 WHEN a.source_sequence <> '' AND b.source_sequence <> '' THEN
    CASE WHEN regexp_full_match(a.source_sequence, '[0-9]+') AND regexp_full_match(b.source_sequence, '[0-9]+') THEN sign(a.source_sequence::HUGEINT - b.source_sequence::HUGEINT)::INT
    WHEN a.source_sequence < b.source_sequence THEN -1 WHEN a.source_sequence > b.source_sequence THEN 1 ELSE 0 END
   WHEN a.source_commit_time < b.source_commit_time THEN -1 WHEN a.source_commit_time > b.source_commit_time THEN 1 WHEN a.source_commit_time = b.source_commit_time THEN 0 ELSE 2 END AS compared
 FROM (SELECT *, lead(assertion_id) OVER (PARTITION BY subject_id ORDER BY recorded_at, assertion_id) AS nx FROM sc) a JOIN sc b ON b.assertion_id = a.nx""")
def position_compare(spark, d):
    w = Window.partitionBy("subject_id").orderBy("recorded_at", "assertion_id")
    cols = ("assertion_id", "source_id", "source_sequence", "source_commit_time")
    rows = sourced(spark, d).select(*cols, *(F.lead(c).over(w).alias(f"b_{c}") for c in cols)).filter("b_assertion_id is not null")
    side = lambda p: {"source": F.col(p + "source_id"), "sequence": F.col(p + "source_sequence"), "commit_time": F.col(p + "source_commit_time")}
    return rows.select("assertion_id", F.col("b_assertion_id").alias("later_id"), ordering.compare_positions(side(""), side("b_")).alias("compared"))


_LO, _HI = "coalesce(valid_from, TIMESTAMP '0001-01-01')", "coalesce(valid_to, TIMESTAMP '9999-12-31')"
_CONFLICTS = f"""WITH {CLAIMS}, o AS (SELECT subject_id, predicate_name, assertion_id, object_key, {_LO} AS lo, {_HI} AS hi FROM c WHERE {_OPEN} AND (valid_to > valid_from OR valid_to IS NULL OR valid_from IS NULL)),
 m AS (SELECT subject_id, predicate_name, assertion_id FROM o a WHERE EXISTS (SELECT 1 FROM o b WHERE a.subject_id = b.subject_id AND a.predicate_name = b.predicate_name AND a.object_key <> b.object_key AND a.lo < b.hi AND b.lo < a.hi))"""


@query(_CONFLICTS + " SELECT *, min(assertion_id) OVER (PARTITION BY subject_id, predicate_name) AS conflict_set FROM m")
def conflict_members(spark, d):
    return reconcile.conflict_members(claims(spark, d), ["subject_id", "predicate_name"])


@query(_CONFLICTS + " SELECT subject_id, predicate_name, min(assertion_id) AS conflict_set, count(*) AS members FROM m GROUP BY 1, 2")
def conflict_set_sizes(spark, d):
    return reconcile.conflict_members(claims(spark, d), ["subject_id", "predicate_name"]).groupBy("subject_id", "predicate_name", "conflict_set").agg(F.count("*").alias("members"))


@query("SELECT DISTINCT conflict_set_id, subject_id, predicate, created_at FROM conflict_sets WHERE resolved_at IS NULL AND resolution = 'open'")
def open_conflicts(spark, d):
    return table(spark, d, "conflict_sets").filter("resolved_at is null and resolution = 'open'").select("conflict_set_id", "subject_id", "predicate", "created_at").distinct()


_ARRIVED = "ts + INTERVAL 1 SECOND * ((event_id * 7919) % 5400)"
_SUPER = f"""WITH a AS (SELECT event_id, user_id, {_ARRIVED} AS recorded_at FROM events),
 n AS (SELECT *, min(recorded_at) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM a)
 SELECT event_id, CASE WHEN later IS NOT NULL THEN greatest(recorded_at, later) END AS superseded_at, coalesce(later IS NOT NULL AND greatest(recorded_at, later) = recorded_at, false) AS superseded_on_arrival FROM n"""


def _arrivals(spark, d):
    late = F.make_dt_interval(secs=(F.col("event_id") * 7919) % 5400)
    return table(spark, d, "events").withColumn("recorded_at", F.col("ts") + late)


@query(_SUPER)
def reconcile_latest_wins(spark, d):
    rows = reconcile.superseded_closed_form(_arrivals(spark, d), ["user_id"], "event_id")
    return rows.select("event_id", "superseded_at", "superseded_on_arrival")


@query(f"WITH s AS ({_SUPER}) SELECT event_id, superseded_at FROM s")
def reconcile_fold_latest_wins(spark, d):
    """The general fold on the same arrivals: it has to agree with the closed form."""
    rows = _arrivals(spark, d).select(
        F.col("user_id").cast("string").alias("slot"), F.col("event_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("object_key"), F.col("ts").alias("valid_from"), F.lit(None).alias("valid_to"),
        "recorded_at", F.lit("one").alias("source"), F.col("event_id").cast("string").alias("sequence"), F.col("ts").alias("commit_time"), F.lit("high").alias("trust"), F.lit("latest_wins").alias("policy"), F.lit("append").alias("operation"), F.lit("active").alias("status"),
    )
    return reconcile.reconcile(rows).select(F.col("id").cast("long").alias("event_id"), "superseded_at")


# the fold in SQL: a step per arrival, the state of a slot being the list of its claims so far
_SIGN = "CASE WHEN {0} > {1} THEN 1 WHEN {0} < {1} THEN -1 ELSE 0 END"
_ORDER = f"""CASE WHEN o.src <> c.src OR o.src IS NULL THEN NULL
  WHEN c.seq IS NOT NULL AND o.seq IS NOT NULL THEN CASE WHEN c.num AND o.num THEN CASE WHEN length(c.bare) <> length(o.bare) THEN {_SIGN.format('length(c.bare)', 'length(o.bare)')} ELSE {_SIGN.format('c.bare', 'o.bare')} END ELSE {_SIGN.format('c.seq', 'o.seq')} END
  WHEN c.ct IS NOT NULL AND o.ct IS NOT NULL THEN {_SIGN.format('c.ct', 'o.ct')} END"""
_FOLD = f"""WITH RECURSIVE {SOURCED},
 ar AS (
  SELECT [graph_space_id, subject_id, predicate_name] AS slot, assertion_id AS id, object_key AS v, coalesce(valid_from, TIMESTAMP '0001-01-01') AS lo, coalesce(valid_to, TIMESTAMP '9999-12-31') AS hi, recorded_at AS rec,
    source_id AS src, source_request_id AS req, nullif(source_sequence, '') AS seq, coalesce(regexp_full_match(source_sequence, '[0-9]+'), false) AS num, ltrim(source_sequence, '0') AS bare, source_commit_time AS ct,
    CASE trust_level WHEN 'untrusted' THEN 1 WHEN 'low' THEN 2 WHEN 'standard' THEN 3 WHEN 'high' THEN 4 WHEN 'authoritative' THEN 5 ELSE 0 END AS pw, operation = 'correction' AS corrects,
    CASE WHEN predicate_name = 'contract_tier' THEN 'authority' WHEN predicate_name IN ('seat_limit', 'support_region') THEN 'latest' ELSE 'conflict' END AS rule
  FROM sc WHERE memory_kind = 'semantic'),
 arrived AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY rec, id) AS n FROM (SELECT DISTINCT * FROM ar)),
 walk AS (
  SELECT DISTINCT slot, 0::BIGINT AS n, []::STRUCT(id VARCHAR, v VARCHAR, lo TIMESTAMP, hi TIMESTAMP, src VARCHAR, req VARCHAR, seq VARCHAR, num BOOLEAN, bare VARCHAR, ct TIMESTAMP, pw INTEGER, cs VARCHAR, sup_at TIMESTAMP, sup_by VARCHAR, st VARCHAR)[] AS state FROM arrived
  UNION ALL
  SELECT slot, n, list_append(list_transform(state, lambda o: CASE
      WHEN list_contains(gone, o.id) THEN struct_update(o, st := 'superseded', sup_at := rec, sup_by := id)
      WHEN names IS NOT NULL AND list_contains(against, o.id) THEN struct_update(o, st := 'disputed', cs := coalesce(o.cs, names)) ELSE o END),
    {{'id': id, 'v': v, 'lo': lo, 'hi': hi, 'src': src, 'req': req, 'seq': seq, 'num': num, 'bare': bare, 'ct': ct, 'pw': pw, 'cs': names, 'sup_at': CASE WHEN late IS NOT NULL THEN rec END, 'sup_by': late,
      'st': CASE WHEN late IS NOT NULL THEN 'superseded' WHEN names IS NOT NULL THEN 'disputed' ELSE 'active' END}})
  FROM (
   SELECT *, CASE WHEN late IS NULL AND NOT wins AND len(against) > 0 THEN coalesce(list_filter(list_transform(rest, lambda o: o.cs), lambda x: x IS NOT NULL)[1], 'conflict:' || list_min(list_append(against, id))) END AS names,
     list_concat(CASE WHEN late_own IS NULL THEN own_ids ELSE [] END, CASE WHEN late IS NULL THEN earlier ELSE [] END, CASE WHEN late IS NULL AND wins THEN against ELSE [] END) AS gone
   FROM (
    SELECT *, coalesce(late_own, late_rival) AS late, list_transform(rest, lambda o: o.id) AS against, rule = 'latest' OR rule = 'authority' AND len(list_filter(rest, lambda o: o.pw >= pw)) = 0 AS wins
    FROM (
     SELECT *, list_filter(own, lambda o: o.way = -1)[1].id AS late_own, list_filter(rivals, lambda o: o.way = -1)[1].id AS late_rival, list_transform(list_filter(rivals, lambda o: o.way = 1), lambda o: o.id) AS earlier, list_filter(rivals, lambda o: coalesce(o.way, 0) <> 1) AS rest
     FROM (
      SELECT *, list_filter(able, lambda o: o.v <> v AND o.lo < hi AND lo < o.hi AND o.lo < o.hi AND lo < hi AND NOT list_contains(own_ids, o.id)) AS rivals
      FROM (
       SELECT *, list_transform(own, lambda o: o.id) AS own_ids
       FROM (
        SELECT *, list_filter(able, lambda o: corrects AND o.src = src AND o.req <> req) AS own
        FROM (
         SELECT c.*, state, list_transform(list_filter(state, lambda o: o.st IN ('active', 'disputed')), lambda o: struct_insert(o, way := {_ORDER})) AS able
         FROM walk JOIN arrived c ON c.slot = walk.slot AND c.n = walk.n + 1))))))))
"""


@query(_FOLD + """SELECT o.id AS assertion_id, o.st AS status, o.sup_at AS superseded_at, o.sup_by AS superseded_by, o.cs AS conflict_set
 FROM (SELECT unnest(state) AS o FROM (SELECT slot, arg_max(state, n) AS state FROM walk GROUP BY slot))""")
def reconcile_claims(spark, d):
    """The assertions reconciled from the start, by sources' authority for contract tiers, else latest or conflict."""
    rows = sourced(spark, d).filter("memory_kind = 'semantic'")
    rule = F.when(F.col("predicate_name") == "contract_tier", "highest_authority").when(F.col("predicate_name").isin("seat_limit", "support_region"), "latest_wins").otherwise("conflict")
    found = reconcile.reconcile(rows.select(
        F.to_json(F.array("graph_space_id", "subject_id", "predicate_name")).alias("slot"), F.col("assertion_id").alias("id"), "object_key", "valid_from", "valid_to", "recorded_at", F.col("source_id").alias("source"),
        F.col("source_sequence").alias("sequence"), F.col("source_commit_time").alias("commit_time"), F.col("trust_level").alias("trust"), rule.alias("policy"), "operation", F.lit("active").alias("status"), F.col("source_request_id").alias("request"),
    ))
    return found.select(F.col("id").alias("assertion_id"), "status", "superseded_at", "superseded_by", "conflict_set")


@query(f"""WITH {CLAIMS}, ids AS (SELECT DISTINCT assertion_id FROM assertions WHERE predicate_name = 'risk_level')
 SELECT c.assertion_id, CASE WHEN hit THEN 'retracted' ELSE status END AS status, CASE WHEN hit THEN {_K} ELSE retracted_at END AS retracted_at, CASE WHEN hit THEN 'source withdrew it' END AS retraction_reason
 FROM (SELECT c.*, (assertion_id IN (SELECT assertion_id FROM ids) AND retracted_at IS NULL AND status <> 'superseded') AS hit FROM c) c""")
def retract_claims(spark, d):
    rows = claims(spark, d)
    return reconcile.retract(rows, rows.filter("predicate_name = 'risk_level'"), KNOWN, "source withdrew it").select("assertion_id", "status", "retracted_at", "retraction_reason")


_GROUPED = f"""WITH {SOURCED}, g AS (
 SELECT subject_id, predicate_name, count(*) AS members, count(DISTINCT source_id) AS sources, sum(confidence::DECIMAL(18, 6))::DOUBLE / count(confidence) AS mean, min(valid_from) AS valid_from
 FROM sc WHERE memory_kind = 'episodic' AND {_OPEN} GROUP BY 1, 2)
 SELECT subject_id, predicate_name, members, sources, valid_from, (floor(least(0.95, mean * (0.6 + 0.25 * (1 - pow(0.6, members)) + 0.15 * (1 - pow(0.5, sources)))) * 1e6 + 0.5) / 1e6)::DOUBLE AS confidence FROM g"""


def _observations(spark, d):
    return sourced(spark, d).filter("memory_kind = 'episodic' and status in ('active', 'disputed')").withColumn("object_key", F.lit("seen"))


@query(f"SELECT subject_id, predicate_name, members, sources, valid_from, confidence FROM ({_GROUPED}) WHERE members >= 2 AND confidence >= 0.5")
def consolidate_groups(spark, d):
    found = memory.consolidate(_observations(spark, d), least=2)
    return found.select("subject_id", "predicate_name", "members", "sources", "valid_from", (F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6).alias("confidence"))


@query(f"SELECT count(*) AS facts FROM ({_GROUPED}) g WHERE members >= 2 AND confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM assertions d WHERE d.memory_kind = 'derived' AND d.subject_id = g.subject_id AND d.predicate_name = g.predicate_name)")
def consolidate_idempotent(spark, d):
    derived = claims(spark, d).filter("memory_kind = 'derived'").withColumn("object_key", F.lit("seen"))
    return memory.not_yet_derived(memory.consolidate(_observations(spark, d), least=2), derived).agg(F.count("*").alias("facts"))


@query(f"""WITH {CLAIMS} SELECT assertion_id, round(CASE WHEN decay_starts_at >= {_K} THEN 1 ELSE greatest(0.2, pow(0.5, epoch_us({_K}) / 1e6 / 2592000.0 - epoch_us(decay_starts_at) / 1e6 / 2592000.0)) END, 6)::DOUBLE AS decay,
  CASE memory_kind WHEN 'semantic' THEN 1 WHEN 'procedural' THEN 0.95 WHEN 'preference' THEN 0.9 WHEN 'derived' THEN 0.9 WHEN 'episodic' THEN 0.85 WHEN 'working' THEN 0.5 ELSE 0.8 END::DOUBLE AS priority FROM c""")
def decay_ranking(spark, d):
    at = asof.instant(KNOWN)
    return claims(spark, d).select("assertion_id", F.round(scores.decay(F.col("decay_starts_at"), at), 6).alias("decay"), scores.memory_priority(F.col("memory_kind")).alias("priority"))


@query(f"""WITH {SOURCED} SELECT assertion_id, round(greatest(0, least(1, (p + (1 - p) * x * 0.5) * (1 - y))), 6)::DOUBLE AS score FROM (
 SELECT assertion_id, confidence * CASE trust_level WHEN 'authoritative' THEN 1 WHEN 'high' THEN 0.95 WHEN 'standard' THEN 0.85 WHEN 'low' THEN 0.65 WHEN 'untrusted' THEN 0.4 ELSE 0.5 END AS p,
  CASE WHEN memory_kind = 'derived' THEN 0.5 ELSE 0 END AS x, CASE WHEN status = 'disputed' THEN 0.2 ELSE 0 END AS y FROM sc)""")
def confidence_breakdown(spark, d):
    score = scores.confidence([scores.trust_factor(F.col("trust_level")), F.col("confidence")], F.when(F.col("memory_kind") == "derived", 0.5), F.when(F.col("status") == "disputed", 0.2), F.lit(None).cast("double"))
    return sourced(spark, d).select("assertion_id", F.round(score, 6).alias("score"))


TYPES = ["person", "organization", "product", "contract"]
PREDICATES = [
    ("account_manager", ["organization", "person"], [], ["string"], []),
    ("contract_tier", ["organization", "contract"], [], ["symbol"], ["bronze", "silver", "gold"]),
    ("seat_limit", [], [], ["integer"], []),
    ("risk_level", ["person", "organization"], [], [], ["low", "high"]),
    ("owned_by", ["product"], [], [], []),
]


def _checked(spark, d):
    e = entities(spark, d).select(F.col("entity_id").alias("subject_id"), F.col("entity_type").alias("subject_type"))
    rules = spark.createDataFrame(PREDICATES, "name string, subject_types array<string>, object_types array<string>, object_kinds array<string>, allowed_values array<string>")
    rows = claims_as_of(claims(spark, d), ClaimQuery()).join(e, "subject_id", "left").withColumn("object_type", F.lit(None).cast("string")).withColumn("predicate", F.col("predicate_name")).withColumn("object_text", F.regexp_extract("object_key", "^[^:]*:(.*)$", 1))
    return ontology.violations(rows, rules, TYPES)


_CHECKED = f"""WITH {CLAIMS}, {ENTITIES}, x AS (SELECT c.*, en.entity_type AS t, substr(object_key, position(':' IN object_key) + 1) AS txt FROM c LEFT JOIN en ON en.entity_id = c.subject_id WHERE {_OPEN}),
 v AS (SELECT assertion_id, list_filter([
  CASE WHEN t <> '' AND t NOT IN ('person', 'organization', 'product', 'contract') THEN 'unknown_entity_type' END,
  CASE WHEN predicate_name NOT IN ('account_manager', 'contract_tier', 'seat_limit', 'risk_level', 'owned_by') THEN 'unknown_predicate' END,
  CASE WHEN t <> '' AND ((predicate_name IN ('account_manager', 'risk_level') AND t NOT IN ('person', 'organization')) OR (predicate_name = 'contract_tier' AND t NOT IN ('organization', 'contract')) OR (predicate_name = 'owned_by' AND t <> 'product')) THEN 'subject_type' END,
  CASE WHEN (predicate_name = 'account_manager' AND object_kind <> 'string') OR (predicate_name = 'contract_tier' AND object_kind <> 'symbol') OR (predicate_name = 'seat_limit' AND object_kind <> 'integer') THEN 'object_kind' END,
  CASE WHEN object_kind = 'symbol' AND ((predicate_name = 'contract_tier' AND upper(txt) NOT IN ('BRONZE', 'SILVER', 'GOLD')) OR (predicate_name = 'risk_level' AND upper(txt) NOT IN ('LOW', 'HIGH'))) THEN 'value' END], lambda z: z IS NOT NULL) AS codes FROM x)"""


@query(_CHECKED + " SELECT assertion_id, array_to_string(codes, ',') AS codes FROM v WHERE len(codes) > 0")
def ontology_violations(spark, d):
    return _checked(spark, d).filter(F.size("violations") > 0).select("assertion_id", F.array_join("violations", ",").alias("codes"))


@query(_CHECKED + " SELECT code, count(*) AS claims FROM (SELECT unnest(codes) AS code FROM v) GROUP BY 1")
def ontology_report(spark, d):
    return ontology.report(_checked(spark, d))


_CLOSED = f"""(status = 'quarantined' OR (status = 'superseded' AND coalesce(superseded_at < {_K}, false)) OR (status = 'retracted' AND coalesce(retracted_at < {_K}, false))
  OR (status IN ('active', 'disputed') AND coalesce(greatest(valid_to, expires_at) < {_K}, false)))"""
_PURGE = f"""WITH {CLAIMS}, {REQUESTS}, s AS (SELECT *, lag(assertion_id) OVER (PARTITION BY subject_id, predicate_name ORDER BY recorded_at, assertion_id) AS supersedes_id FROM c WHERE memory_kind = 'semantic' UNION ALL BY NAME SELECT * FROM c WHERE memory_kind <> 'semantic'),
 cand AS (SELECT DISTINCT request_id FROM r WHERE recorded_at < TIMESTAMP '2026-01-01' AND operation <> 'delete' AND NOT EXISTS (SELECT 1 FROM s WHERE s.source_request_id = r.request_id AND NOT {_CLOSED})),
 found AS (SELECT request_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM s o JOIN s t ON t.supersedes_id = o.assertion_id WHERE o.source_request_id = cand.request_id AND t.source_request_id NOT IN (SELECT request_id FROM cand)))"""


def _purgeable(spark, d):
    w = Window.partitionBy("subject_id", "predicate_name").orderBy("recorded_at", "assertion_id")
    rows = claims(spark, d)
    semantic = rows.filter("memory_kind = 'semantic'").withColumn("supersedes_id", F.lag("assertion_id").over(w))
    rows = semantic.unionByName(rows.filter("memory_kind <> 'semantic'"), allowMissingColumns=True)
    r = requests(spark, d)
    return memory.purgeable(r.filter("recorded_at < timestamp_ntz'2026-01-01 00:00:00'").withColumn("recorded_at", F.expr("timestamp_ntz'2000-01-01 00:00:00'")), rows, r.filter("operation = 'delete'"), asof.instant(KNOWN))


@query(_PURGE + " SELECT request_id FROM found")
def purge_eligible(spark, d):
    return _purgeable(spark, d)


@query(_PURGE + " SELECT count(DISTINCT f.request_id) AS requests, count(DISTINCT s.assertion_id) AS claims FROM found f LEFT JOIN s ON s.source_request_id = f.request_id")
def purge_counts(spark, d):
    found = _purgeable(spark, d)
    mine = claims(spark, d).select(F.col("source_request_id").alias("request_id"), "assertion_id")
    return found.join(mine, "request_id", "left").agg(F.countDistinct("request_id").alias("requests"), F.countDistinct("assertion_id").alias("claims"))


@query(f"WITH {REQUESTS} SELECT date_trunc('month', recorded_at)::TIMESTAMP AS month, count(*) AS rows FROM r GROUP BY 1 HAVING month + INTERVAL 1 MONTH <= TIMESTAMP '2025-06-15'")
def retention_months(spark, d):
    return memory.prunable_months(requests(spark, d), "recorded_at", asof.instant("2025-06-15 00:00:00"))


@query(f"WITH {CLAIMS} SELECT assertion_id, CASE WHEN predicate_name = 'risk_level' THEN {_K} END AS active_until FROM c")
def deactivate_claims(spark, d):
    rows = claims(spark, d)
    return memory.deactivated(rows, rows.filter("predicate_name = 'risk_level'"), KNOWN).select("assertion_id", "active_until")


@query(f"WITH {CLAIMS} SELECT assertion_id, CASE WHEN valid_from > {_V} THEN 0.3 WHEN valid_to <= {_V} THEN 0.4 WHEN valid_from IS NULL AND valid_to IS NULL THEN 0.8 ELSE 1 END::DOUBLE AS fit FROM c")
def temporal_fit(spark, d):
    return claims(spark, d).select("assertion_id", intervals.temporal_fit("valid_from", "valid_to", asof.instant(VALID)).alias("fit"))


@query("""SELECT e.event_id, e.user_id, e.ts, b.event_id AS right_event_id, b.value AS right_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON e.user_id = b.user_id AND e.ts >= b.ts""")
def asof_join_events(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("at"), "value")
    return asof.as_of_join(left, right, ["user_id"], "ts", "at", "event_id").select("event_id", "user_id", "ts", "right_event_id", "right_value")

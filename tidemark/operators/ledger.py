"""Writing to the ledger: building claims, committing them once, resolving conflicts, registries and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.functions.ordering import CLASSIFICATION, rank

FINGERPRINT = ("workspace_id", "graph_space_id", "subject_id", "predicate_name", "object_key", "scope_key", "valid_from", "valid_to", "source_request_id", "memory_kind")
#: Tables that can be rebuilt from the others, and those that can't. Fixed lists.
CANONICAL = ("sources", "requests", "artifacts", "entities", "entity_identifiers", "assertions", "evidence", "conflict_sets", "derivations", "ontologies", "policies")
REBUILDABLE = ("lexical_records", "vector_records", "graph_edges", "checkpoints", "traces")


def fingerprint(columns: Sequence[str], have: Sequence[str]) -> Column:
    """What makes a claim the same claim; missing columns count as empty."""
    return keys.derive_key("assertion", *(F.col(c) if c in have else F.lit(None).cast("string") for c in columns))


def greatest_classification(*levels: Column) -> Column:
    """The strictest of several classifications; null ones don't count."""
    top = F.greatest(*(rank(c, CLASSIFICATION) for c in levels))
    return F.when(top > 0, F.element_at(F.array(*map(F.lit, CLASSIFICATION)), top))


def build(claims: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Claims with their defaults: strictest classification, knowledge time of the system, confidence in (0, 1], fingerprint.

    claims: the assertion's own columns; requests: request_id, classification. A confidence of 0 or less is 1.
    """
    r = requests.groupBy(F.col("request_id").alias("source_request_id")).agg(F.max(F.struct(rank(F.col("classification"), CLASSIFICATION), F.col("classification"))).alias("of"))
    own = F.col("classification") if "classification" in claims.columns else F.lit(None).cast("string")
    rows = claims.join(r, "source_request_id", "left").withColumn("classification", greatest_classification(own, F.col("of.classification"))).drop("of")
    c = F.col("confidence")
    rows = rows.withColumn("confidence", F.when(c.isNull() | (c <= 0), 1.0).otherwise(F.least(c, F.lit(1.0)))).withColumn("recorded_at", F.lit(now).cast("timestamp_ntz"))
    return rows.withColumn("fingerprint", fingerprint(FINGERPRINT, rows.columns))


def commit(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with the new claims, each once by its fingerprint; what was there stays as it was."""
    fresh = new.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in new.columns if c != "fingerprint"]), "assertion_id").alias("c")).select("fingerprint", "c.*")
    return ledger.unionByName(fresh.join(ledger.select("fingerprint"), "fingerprint", "left_anti"), allowMissingColumns=True)


def append_new(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replay-safe insert: rows whose key isn't there, each key once."""
    return existing.unionByName(new.dropDuplicates(list(key)).join(existing.select(*key).distinct(), list(key), "left_anti"))


def without(rows: DataFrame, purged: DataFrame, key: str) -> DataFrame:
    return rows.join(purged.select(key).distinct(), key, "left_anti")


def gated(checked: DataFrame, reject: bool) -> DataFrame:
    """After an ontology check: claims with violations are dropped, or kept in quarantine with the reasons."""
    bad = F.size("violations") > 0
    if reject:
        return checked.filter(~bad).drop("violations")
    return checked.withColumn("quarantine_reason", F.when(bad, F.array_join("violations", ","))).withColumn("status", F.when(bad, "quarantined").otherwise(F.col("status"))).drop("violations")


def resolved(claims: DataFrame, sets: DataFrame) -> DataFrame:
    """Claims of resolved conflict sets (conflict_set_id): disputed ones that are still open are active again."""
    done = sets.select("conflict_set_id").distinct().withColumn("done", F.lit(True))
    out = claims.join(done, "conflict_set_id", "left")
    back = F.col("done") & (F.col("status") == "disputed") & F.col("superseded_at").isNull() & F.col("retracted_at").isNull()
    return out.withColumn("status", F.when(back, "active").otherwise(F.col("status"))).drop("done")


def other_sides(claims: DataFrame) -> DataFrame:
    """``assertion_id``, ``others``: the different values that the claim's conflict set holds against it, sorted."""
    rows = claims.filter("conflict_set_id is not null").select("conflict_set_id", "assertion_id", "object_key").distinct()
    values = rows.groupBy("conflict_set_id").agg(F.array_sort(F.collect_set("object_key")).alias("values"))
    return rows.join(values, "conflict_set_id").select("assertion_id", F.array_join(F.filter("values", lambda v: v != F.col("object_key")), "|").alias("others"))


def versions(definitions: DataFrame, name: str, at: str, meaning: Sequence[str]) -> DataFrame:
    """Definitions with their ``version``: it rises only where the meaning changes."""
    w = Window.partitionBy(name).orderBy(at)
    now = F.to_json(F.struct(*meaning), {"ignoreNullFields": "false"})
    changed = F.coalesce((F.lag(now).over(w) != now).cast("int"), F.lit(1))
    return definitions.withColumn("changed", changed).withColumn("version", F.sum("changed").over(w).cast("int")).drop("changed")


def active_ontology(ontologies: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each graph space's bound ontology; drafts can't be bound, unbound spaces have none. The last binding holds."""
    last = bindings.groupBy("graph_space_id").agg(F.max_by("ontology_id", "bound_at").alias("ontology_id"))
    return last.join(ontologies.filter("status <> 'draft'"), "ontology_id", "left")


def decision_inputs(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """Derived claims with the claims they rest on: inputs has derivation_id, assertion_id; claims has derivation_id."""
    given = claims.select(F.col("assertion_id").alias("input_id"), F.col("predicate_name").alias("input_predicate"), F.col("object_key").alias("input_key"))
    derived = claims.filter("derivation_id is not null").select("assertion_id", "derivation_id")
    return derived.join(inputs.select("derivation_id", F.col("assertion_id").alias("input_id")).distinct(), "derivation_id").join(given, "input_id")


def not_done(work: DataFrame, runs: DataFrame) -> DataFrame:
    """Stage memo: work (event_id, pipeline_version, stage, stage_version) that no successful run covers."""
    key = ["event_id", "pipeline_version", "stage", "stage_version"]
    return work.join(runs.filter("status = 'succeeded'").select(*key).distinct(), key, "left_anti")


def write_traces(traces: DataFrame, folder: str, at: str = "recorded_at") -> None:
    """Append retrieval traces by month, so that retention drops whole folders."""
    traces.withColumn("query_hash", F.sha2(F.col("query").cast("binary"), 256)).withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(folder)


def export_lines(claims: DataFrame, allowed: Column) -> DataFrame:
    """One JSON line per claim that a policy condition lets through."""
    return claims.filter(allowed).select("assertion_id", F.to_json(F.struct(*sorted(claims.columns))).alias("value"))


def forget(kind: str) -> str:
    """Which operator a way of forgetting maps to; a destructive one is refused: purging is an operation of its own."""
    ways = {"deactivate": "memory.deactivated", "expire": "memory.deactivated", "suppress": "memory.deactivated", "retract": "reconcile.retract"}
    if kind not in ways:
        raise ValueError(f"{kind} isn't a way of forgetting; destructive removal is purging")
    return ways[kind]


def reference_line(source: Column, external_id: Column, section: Column, at: Column) -> Column:
    """Where a passage comes from, for a reader: source, record, section, day; what is missing is left out."""
    day = F.date_format(at, "yyyy-MM-dd")
    return F.concat_ws(", ", F.when(source != "", source), F.when(external_id != "", external_id), F.when(section != "", F.concat(F.lit("section "), section)), day)

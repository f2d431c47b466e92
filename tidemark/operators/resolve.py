"""Resolving mentions of entities, conservatively: names never merge anything by likeness alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.search import similar

CONFIDENCE = {"source_identifier": 1.0, "domain_key": 0.99, "exact_alias": 0.9}
FUZZY, MOST_CANDIDATES = 0.55, 10


def first_bindings(identifiers: DataFrame) -> DataFrame:
    """Who owns each key: the first that claimed it. ``conflicts`` counts other entities that claimed it later.

    identifiers: graph_space_id, kind, id_namespace, id_value, entity_id, created_at, identifier_id. Blank values bind nothing.
    """
    key = ["graph_space_id", "kind", "id_namespace", "value"]
    rows = identifiers.withColumn("value", text.normalize_identifier(F.col("id_value"))).filter("value <> ''").dropna(subset=key)
    g = rows.groupBy(*key).agg(F.min_by("entity_id", F.struct("created_at", "identifier_id", "entity_id")).alias("entity_id"), (F.countDistinct("entity_id") - 1).alias("conflicts"))
    return g


def resolve(mentions: DataFrame, bindings: DataFrame, aliases: DataFrame, require_type: bool = True) -> DataFrame:
    """How each mention resolves: ``mention_id``, ``method``, ``entity_id``, ``confidence``, ``candidates``.

    mentions: mention_id, graph_space_id, name, entity_type, source_namespace, external_id, key_namespace, key_value.
    bindings: see first_bindings. aliases: graph_space_id, entity_id, name, entity_type.
    Source identifiers before domain keys before a single exact alias; several aliases are ambiguous, similar names are
    candidates for review only, else a new entity is made. An alias counts neither if its entity has another key in the
    mention's namespaces, nor if its type differs (unknown fits all).
    """
    m = mentions.withColumn("alias", text.normalize_alias(F.col("name")))
    b = bindings.select("graph_space_id", "kind", "id_namespace", "value", F.col("entity_id").alias("bound"))
    norm = lambda c: text.normalize_identifier(F.col(c))

    def by_key(kind: str, ns: str, value: str, name: str) -> DataFrame:
        own = m.select("mention_id", "graph_space_id", F.lit(kind).alias("kind"), F.col(ns).alias("id_namespace"), norm(value).alias("value"))
        return own.join(b, ["graph_space_id", "kind", "id_namespace", "value"]).select("mention_id", F.col("bound").alias(name))

    own_keys = m.select("mention_id", "graph_space_id", F.explode(F.array(
        F.struct(F.lit("upstream").alias("kind"), F.col("source_namespace").alias("id_namespace"), norm("external_id").alias("mine")),
        F.struct(F.lit("domain").alias("kind"), F.col("key_namespace").alias("id_namespace"), norm("key_value").alias("mine")),
    )).alias("k")).select("mention_id", "graph_space_id", "k.*").filter("mine <> ''")
    named = m.join(aliases.select("graph_space_id", text.normalize_alias(F.col("name")).alias("alias"), F.col("entity_id").alias("candidate"), F.col("entity_type").alias("type")), ["graph_space_id", "alias"])
    if require_type:
        loose = F.col("entity_type").isNull() | F.col("entity_type").isin("", "unknown")
        named = named.filter(loose | (F.col("type") == F.col("entity_type")) | (F.col("type") == "unknown"))
    named = named.select("mention_id", "candidate", "graph_space_id").distinct()
    held = b.select("graph_space_id", F.col("bound").alias("candidate"), "kind", "id_namespace", "value")
    foreign = named.join(held, ["graph_space_id", "candidate"]).join(own_keys, ["mention_id", "graph_space_id", "kind", "id_namespace"]).filter("value <> mine").select("mention_id", "candidate").distinct()
    exact = named.join(foreign, ["mention_id", "candidate"], "left_anti").groupBy("mention_id").agg(F.min("candidate").alias("alias_entity"), F.count("*").alias("exact"))

    steps = m.select("mention_id", "name", "graph_space_id").join(by_key("upstream", "source_namespace", "external_id", "by_source"), "mention_id", "left").join(by_key("domain", "key_namespace", "key_value", "by_key"), "mention_id", "left").join(exact, "mention_id", "left")
    open_ = steps.filter("by_source is null and by_key is null and exact is null and name <> ''")
    names = aliases.select(F.struct("graph_space_id", "entity_id", "name").alias("record_id"), F.col("name").alias("content")).distinct()
    near = similar(names, open_.select(F.col("mention_id").alias("query_id"), F.col("name").alias("query")), FUZZY)
    near = near.join(open_.select(F.col("mention_id").alias("query_id"), "graph_space_id"), "query_id").filter("record_id.graph_space_id = graph_space_id")
    near = near.groupBy("query_id", "record_id.entity_id").agg(F.max("score").alias("score")).groupBy(F.col("query_id").alias("mention_id")).agg(F.count("*").alias("fuzzy"))

    out = steps.join(near, "mention_id", "left")
    method = F.when(F.col("by_source").isNotNull(), "source_identifier").when(F.col("by_key").isNotNull(), "domain_key").when(F.col("exact") == 1, "exact_alias").when(F.col("exact") > 1, "ambiguous").when(F.col("fuzzy") > 0, "fuzzy_candidates").otherwise("created")
    confidence = F.when(F.col("by_source").isNotNull(), 1.0).when(F.col("by_key").isNotNull(), 0.99).when(F.col("exact") == 1, 0.9).otherwise(F.lit(None).cast("double"))
    entity = F.coalesce("by_source", "by_key", F.when(F.col("exact") == 1, F.col("alias_entity")))
    count = F.coalesce("exact", F.least("fuzzy", F.lit(MOST_CANDIDATES)), F.lit(0)).cast("long")
    return out.select("mention_id", method.alias("method"), entity.alias("entity_id"), confidence.alias("confidence"), count.alias("candidates"))


def for_review(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("method").isin("ambiguous", "fuzzy_candidates"))


def best_alias(matches: DataFrame) -> DataFrame:
    """Each entity once, with its best alias: query_id, entity_id, name, score."""
    w = Window.partitionBy("query_id", "entity_id").orderBy(F.desc("score"), "name")
    return matches.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")

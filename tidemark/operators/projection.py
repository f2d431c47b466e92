"""Projections of the ledger that search reads: sentences, edges, entities. Always recomputed, so never stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text


def value_of(object_key: Column) -> Column:
    """The value behind the kind of an object key."""
    return F.regexp_extract(object_key, r"(?s)^[^:]*:(.*)$", 1)


def spoken(predicate: Column) -> Column:
    return F.lower(F.regexp_replace(predicate, "_", " "))


def validity(lo: Column, hi: Column) -> Column:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    both = F.concat(F.lit("["), day(lo), F.lit(" to "), day(hi), F.lit("]"))
    return F.when(lo.isNotNull() & hi.isNotNull(), both).when(lo.isNotNull(), F.concat(F.lit("[since "), day(lo), F.lit("]"))).when(hi.isNotNull(), F.concat(F.lit("[until "), day(hi), F.lit("]")))


def claim_text(subject: Column, predicate: Column, value: Column, scope: Column | None = None) -> Column:
    """For the index: subject, predicate in words, value, context."""
    context = F.when(scope != "", F.concat(F.lit("in context "), scope)) if scope is not None else F.lit(None)
    return F.concat_ws(" ", F.trim(subject), spoken(predicate), F.trim(value), context)


def prompt_text(subject: Column, predicate: Column, value: Column, lo: Column, hi: Column, scope: Column | None = None) -> Column:
    """For a reader: with scope and validity."""
    context = F.when(scope != "", F.concat(F.lit("("), scope, F.lit(")"))) if scope is not None else F.lit(None)
    return F.concat_ws(" ", F.trim(subject), spoken(predicate), F.trim(value), context, validity(lo, hi))


def claim_records(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Every claim but quarantined and retracted ones as a searchable sentence."""
    names = entities.select(F.col("entity_id").alias("subject_id"), F.col("canonical_name").alias("name"), "entity_type")
    rows = claims.filter(~F.col("status").isin("quarantined", "retracted")).join(names, "subject_id", "left")
    content = claim_text(F.coalesce("name", "subject_id"), F.col("predicate_name"), value_of(F.col("object_key")))
    return rows.select(F.col("assertion_id").alias("record_id"), F.lit("assertion").alias("surface"), content.alias("content"), F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.col("predicate_name").alias("predicate"), "memory_kind", "status")


def entity_records(entities: DataFrame) -> DataFrame:
    rows = entities.filter("retired_at is null and canonical_name is not null")
    return rows.select(F.col("entity_id").alias("record_id"), F.lit("entity").alias("surface"), F.concat("canonical_name", F.lit(" ("), F.coalesce("entity_type", F.lit("unknown")), F.lit(")")).alias("content"))


def chunk_records(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.filter("trim(content) <> ''").select(F.col(key).alias("record_id"), F.lit("chunk").alias("surface"), "content")


def latest(records: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upsert by latest version: one row per key; ties go to the greatest row."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.max(F.struct(version, *(c for c in rest if c != version))).alias("r")).select(*key, "r.*")


def refreshed(vectors: DataFrame, standing: DataFrame) -> DataFrame:
    """New metadata onto kept vectors (both by record_id): nothing is embedded again."""
    return vectors.join(standing, "record_id", "left")


def to_embed(records: DataFrame, embedded: DataFrame) -> DataFrame:
    """Records whose text has no vector yet, by content hash: each text once."""
    h = F.sha2(F.col("content").cast("binary"), 256)
    return records.withColumn("content_hash", h).dropDuplicates(["content_hash"]).join(embedded.select("content_hash"), "content_hash", "left_anti")


def hashed_embedding(records: DataFrame, size: int = 1536) -> DataFrame:
    """``record_id``, ``bucket``, ``weight``: a sparse embedding by feature hashing, of length one.

    Words of two characters or more; bucket by FNV-1a modulo the size, sign by its top bit, 1 + ln(tf) as weight.
    """
    from tidemark.functions.vectors import fnv1a

    words = records.select("record_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]{2,})"))).alias("word"))
    tf = words.groupBy("record_id", "word").agg(F.count("*").alias("tf")).withColumn("h", fnv1a(F.col("word")))
    signed = F.when(F.shiftright("h", 31) == 1, -1.0).otherwise(1.0) * (1 + F.log(F.col("tf").cast("double")))
    parts = tf.groupBy("record_id", (F.col("h") % size).cast("int").alias("bucket")).agg(F.sum(signed).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("record_id")))
    return parts.withColumn("n", norm).filter("n > 0").select("record_id", "bucket", (F.col("w") / F.col("n")).alias("weight"))


def predicate_of(names: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names resolved to registered predicates: as written, by alias, or by a spelling variant.

    names: name. registry: predicate. aliases: alias, predicate. Column ``predicate`` is null for new ones.
    """
    n = names.select("name").distinct().withColumn("normal", text.normalize_predicate(F.col("name")))
    reg = registry.select(F.col("predicate").alias("hit")).distinct()
    direct = n.join(reg.select(F.col("hit").alias("normal"), F.col("hit").alias("d")), "normal", "left")
    known = direct.join(aliases.select(F.col("alias").alias("normal"), F.col("predicate").alias("a")), "normal", "left")
    variants = n.select("name", F.posexplode(text.spelling_variants(F.col("normal"))).alias("p", "hit")).join(reg, "hit").groupBy("name").agg(F.min_by("hit", "p").alias("v"))
    return known.join(variants, "name", "left").select("name", F.coalesce("d", "a", "v").alias("predicate"))

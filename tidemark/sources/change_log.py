"""Change events as rows: reading them, their keys and images, and the claims their columns make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators.change_feed import position, record_id

#: One JSON object a line.
EVENT = "stream string, operation string, key string, before string, after string, commit_time timestamp, event_time timestamp, `offset` string, sequence string, `transaction` string, schema_version string"


def lines(texts: DataFrame) -> DataFrame:
    """Events of lines (``value``); blank and comment lines are none."""
    kept = texts.filter("trim(value) <> '' and not trim(value) like '//%'")
    return kept.select(F.from_json("value", EVENT).alias("e")).select("e.*")


def replay(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark.read.text(path))


def replay_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def image(x: Column | str) -> Column:
    """A JSON object as a map of plain texts."""
    return F.from_json(x, "map<string,string>")


def changed_columns(before: Column, after: Column) -> Column:
    """The names of columns that one image lacks or that differ, sorted."""
    b, a = F.coalesce(image(before), F.create_map().cast("map<string,string>")), F.coalesce(image(after), F.create_map().cast("map<string,string>"))
    names = F.array_union(F.map_keys(b), F.map_keys(a))
    return F.array_sort(F.filter(names, lambda k: ~b[k].eqNullSafe(a[k]) | (F.array_contains(F.map_keys(b), k) != F.array_contains(F.map_keys(a), k))))


def change_key(stream: Column, offset: Column, sequence: Column, operation: Column, record: Column) -> Column:
    """What makes a change the same on redelivery: its offset, else sequence and record, else operation and record."""
    given = lambda c: c.isNotNull() & (c != "")
    return F.when(given(offset), keys.derive_key("change", stream, F.lit("offset"), offset, record)).when(given(sequence), keys.derive_key("change", stream, F.lit("sequence"), sequence, record)).otherwise(keys.derive_key("change", stream, F.lit("operation"), operation, record))


def row_text(stream: Column, operation: Column, key: Column, shown: Column) -> Column:
    """The readable form of a changed row: a head line, then a line per column in order."""
    pairs = F.array_sort(F.map_entries(image(shown)))
    head = F.concat_ws(" ", stream, operation, F.concat(stream, F.lit(":"), record_id(key)))
    return F.array_join(F.concat(F.array(head), F.coalesce(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), F.array().cast("array<string>"))), "\n")


def column_claims(changes: DataFrame, mapping: list[tuple[str, str, str, bool]]) -> DataFrame:
    """The claims that the columns of change rows make: the change's columns, ``predicate``, ``kind``, ``object_key``.

    mapping: (column, predicate, kind, skip_empty) in order. A value that doesn't parse as its kind is a string; null
    and, where skipped, blank values claim nothing. changes has ``after`` (JSON).
    """
    values = image(F.col("after"))
    entries = [F.struct(F.lit(p).alias("predicate"), F.lit(k).alias("asked"), values[c].alias("value"), F.lit(s).alias("skip")) for c, p, k, s in mapping]
    rows = changes.withColumn("m", F.explode(F.array(*entries))).select(*changes.columns, "m.*").filter("value is not null and not (skip and trim(value) = '')")
    kind = keys.coerce(F.col("asked"), F.col("value"))
    return rows.withColumn("kind", kind).withColumn("object_key", keys.object_key(F.col("kind"), F.col("value"))).drop("asked", "skip")


def without_unchanged(claims: DataFrame, slot: list[str], order: list[Column]) -> DataFrame:
    """Claims whose value differs from the one before in the order of the source; the first of each slot stays."""
    w = Window.partitionBy(*slot).orderBy(*order)
    return claims.withColumn("prior", F.lag("object_key").over(w)).filter(~F.col("prior").eqNullSafe(F.col("object_key")) | F.col("prior").isNull()).drop("prior")


def tombstoned(claims: DataFrame, feed: DataFrame) -> DataFrame:
    """Claims with ``retracted_by``: the position of the first delete of their record after them, null if none.

    claims: stream, record_id, at (position). feed: the changes of the same records with ``deletes``. One pass over the
    merged, ordered rows of each record: the next delete is the least position of a delete that follows.
    """
    marks = feed.filter("deletes").select("stream", "record_id", "at").distinct().withColumn("gone", F.col("at.raw"))
    rows = claims.withColumn("c", F.struct(*claims.columns)).select("stream", "record_id", "at", "c", F.lit(None).cast("string").alias("gone"))
    both = rows.unionByName(marks.withColumn("c", F.lit(None).cast(rows.schema["c"].dataType)))
    w = Window.partitionBy("stream", "record_id").orderBy("at.kind", "at.size", "at.body", F.col("gone").isNull()).rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("retracted_by", F.first("gone", ignorenulls=True).over(w)).filter("c is not null").select("c.*", "retracted_by")


def at_position(sequence: str) -> Column:
    return position(F.col(sequence))

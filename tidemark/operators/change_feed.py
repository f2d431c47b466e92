"""Rebuilding a table from a feed of inserts, updates and deletes.

Log-structured, with equality-delete files. A batch of changes is appended as two files: a data file with a row for each insert,
update or snapshot, as scanned, and a delete file with the record's key and the sequence of its latest change, folded before it
is shuffled. Every row and key carries its sequence number. A reader keeps the data rows that no later delete key of their record
removes, by an anti-join. ``compact`` writes what stands as one data file, and the latest key of each record as one delete file,
so that older changes that come later still find it.

The delete files know how many changes each record has. Keys of records with more than a thousandth of all, fewer than a
thousand, are broadcast and remove their rows in the scan; the others' are joined by a shuffle.

Order within a stream: two sequences of digits compare as whole numbers of any length, all others as text. Equal
sequences of a record are the same change. Where a record has both kinds, the greatest number and the greatest text
compare as text, and the record's last change is the greater of them.

Defined cases: rows without stream, key or operation, and operations other than insert, update, snapshot and delete, are
no changes; a null sequence is before all others; keys that are no JSON object stand for themselves, trimmed; a null value
inside a key is written as ``null``; repeated rows have no effect; of equal sequences with different images the greatest
text stands; an empty feed gives an empty table. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.tables import Scratch

#: Changes of a record from which on it may count as one with many.
MANY = 10_000
_AT = "struct<kind: int, size: int, body: string, raw: string>"
FILES = {"data": f"stream string, record_id string, at {_AT}, image string", "deletes": f"stream string, record_id string, n {_AT}, t {_AT}, changes long"}
SETS = ("insert", "update", "snapshot")


def record_id(key: Column) -> Column:
    """``column=value`` in the order of the columns' names, joined by commas; numbers and strings alike."""
    pairs = F.array_sort(F.map_entries(F.from_json(key, "map<string,string>")))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")
    return F.coalesce(text, F.trim(key))


def position(sequence: Column) -> Column:
    """A struct that sorts as the sequence does among its own kind: numbers by length and digits, text by itself."""
    digits = sequence.rlike("^[0-9]+$")
    bare = F.regexp_replace(sequence, "^0+(?=[0-9])", "")
    return F.struct(
        F.when(sequence.isNull(), 0).when(digits, 1).otherwise(2).alias("kind"),
        F.when(digits, F.length(bare)).otherwise(0).alias("size"),
        F.when(digits, bare).otherwise(F.coalesce(sequence, F.lit(""))).alias("body"),
        F.coalesce(sequence, F.lit("")).alias("raw"),
    )


def _number(position: Column) -> Column:
    return F.when(position["kind"] == 1, position)


def _text(position: Column) -> Column:
    return F.when(position["kind"] != 1, position)


def _last(number: Column, text: Column) -> Column:
    """The later of the greatest number and the greatest text."""
    return F.when(number.isNull(), text).when(text.isNull() | (number["raw"] > text["raw"]), number).otherwise(text)


def changes(df: DataFrame, stream: str, key: str, operation: str, sequence: str, image: str | None = None) -> DataFrame:
    """The feed's changes as ``stream``, ``record_id``, ``at`` (position), ``sets``, ``deletes``, ``image``."""
    op = F.lower(F.trim(F.col(operation), F.lit(" \t\r\n")))
    rows = df.select(
        F.col(stream).cast("string").alias("stream"),
        record_id(F.col(key).cast("string")).alias("record_id"),
        position(F.col(sequence).cast("string")).alias("at"),
        op.isin(*SETS).alias("sets"),
        (op == "delete").alias("deletes"),
        (F.col(image).cast("string") if image else F.lit(None).cast("string")).alias("image"),
    )
    return rows.filter("stream is not null and record_id is not null and (sets or deletes)")


def _standing(data: DataFrame, deletes: DataFrame) -> DataFrame:
    """Data rows that no later delete key of their record removes; copies of the same change fold to one."""
    keys = deletes.groupBy("stream", "record_id").agg(F.max("n").alias("n"), F.max("t").alias("t"), F.sum("changes").alias("changes"))
    keys = keys.select(F.col("stream").alias("d_stream"), F.col("record_id").alias("d_record"), _last(F.col("n"), F.col("t")).alias("d_at"), "changes")
    place = lambda c: F.struct(c["size"], c["body"])
    later = (F.col("at.kind") != F.col("d_at.kind")) | (place(F.col("d_at")) > place(F.col("at")))
    removed = (F.col("stream") == F.col("d_stream")) & (F.col("record_id") == F.col("d_record")) & later
    total = deletes.agg(F.sum("changes")).first()[0] or 0
    share = max(MANY, total / 1000)
    hot = keys.filter(F.col("changes") > share)
    if total > share:
        data = data.join(F.broadcast(hot), removed, "left_anti")  # at most a thousand keys
    live = data.join(keys.filter(F.col("changes") <= share), removed, "left_anti")
    # spellings of one sequence, and images of one change, are still apart
    live = live.groupBy("stream", "record_id").agg(F.max(F.struct("at", "image")).alias("row"))
    return live.select("stream", "record_id", F.when(F.col("row.at.kind") != 0, F.col("row.at.raw")).alias("source_sequence"), F.col("row.image").alias("image"))


class ChangeTable:
    """A table as data and delete files under a folder that all executors share; one writer at a time.

    Each batch has a folder of its own, so a batch that is appended again replaces itself. A compaction is a new generation of
    files; readers take the last one that was written whole.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        g = 0
        while self._files().exists(self._path(f"{self.folder}/{g + 1}/whole")):
            g += 1
        return g

    def append(self, feed: DataFrame, number: int) -> None:
        """One batch of changes, as of ``changes``."""
        deletes = feed.groupBy("stream", "record_id").agg(F.max(_number(F.col("at"))).alias("n"), F.max(_text(F.col("at"))).alias("t"), F.count("*").alias("changes"))
        self._write(self.generation(), str(number), feed.filter("sets").select("stream", "record_id", "at", "image"), deletes)

    def _write(self, generation: int, batch: str, data: DataFrame, deletes: DataFrame) -> None:
        for kind, rows in (("data", data), ("deletes", deletes)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{generation}/{kind}/batch={batch}")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(FILES[kind]).parquet(f"{self.folder}/{self.generation()}/{kind}")

    def state(self) -> DataFrame:
        """``stream``, ``record_id``, ``source_sequence`` as stored, ``image`` of the records that exist."""
        return _standing(self._read("data"), self._read("deletes"))

    def compact(self) -> None:
        data, deletes, new = self._read("data"), self._read("deletes"), self.generation() + 1
        state = _standing(data, deletes).select("stream", "record_id", position(F.col("source_sequence")).alias("at"), "image")
        keys = deletes.groupBy("stream", "record_id").agg(F.max("n").alias("n"), F.max("t").alias("t"), F.sum("changes").alias("changes"))
        self._write(new, "compacted", state, keys)
        self._files().create(self._path(f"{self.folder}/{new}/whole")).close()


def current_state(df: DataFrame, stream: str, key: str, operation: str, sequence: str, image: str | None = None) -> DataFrame:
    """The records that exist after all changes of a feed, appended as one batch to a table of its own: see ``ChangeTable.state``."""
    table = ChangeTable(df.sparkSession, Scratch(df.sparkSession).folder())
    table.append(changes(df, stream, key, operation, sequence, image), 0)
    return table.state()

"""Reading tables and keeping intermediate ones where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; a file or a folder of files, both work."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_tidemark_folder", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = spark._tidemark_folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a scan of few files would leave most of them idle before costly work on each row.

    A scan that already has a partition per core, as any large one has, stays as it is: no shuffle.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"\W*(\w+)", line)[1] for line in plan.splitlines() if re.match(r"\W*\w", line)}
    if not nodes <= {"Project", "Filter", "Relation", "LocalRelation"}:
        return df  # only scans are judged: counting the partitions of anything else would run its shuffles
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Scratch:
    """Written intermediate tables under the shared folder.

    A written table cuts the lineage and outlives any executor. ``drop`` deletes one that nothing reads any longer.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
        spark.__dict__.setdefault("_tidemark_scratch", []).append(self.root)
        self.count = 0

    def folder(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._tidemark_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for t in tables:
            if path := getattr(t, "_tidemark_path", None):
                at = hadoop.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                t._tidemark_path = None


def clean(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder. No result that still reads from it may be in use."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for root in spark.__dict__.pop("_tidemark_scratch", []):
        at = hadoop.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

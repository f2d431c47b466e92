"""Lexical, exact, fuzzy and vector search for batches of queries.

Every function takes a table of queries, so that one scan of the corpus
serves all of them. Filters (policy, scope, lifecycle) belong on the corpus before it gets here: ranks and statistics then never
see what may not be seen. Ties always end with the record's id, so a top-k is one answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions import text
from tidemark.operators.lexical import bm25, ladder, query_terms  # noqa: F401
from tidemark.operators.nearest import VectorIndex, nearest  # noqa: F401
from tidemark.plans.tables import spread

def top(hits: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """The first k hits of each query, or all, with their ``rank``."""
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def exact(records: DataFrame, queries: DataFrame, most: int = 5_000_000) -> DataFrame:
    """``query_id``, ``record_id``, ``score``, ``chars``: records that hold the query literally, case aside.

    One automaton of all queries goes over each text once, whatever their number. Queries of more than ``most`` characters in all
    (some 500 MB as an automaton) go in blocks, a pass over the records each. Null and empty queries match nothing.
    """
    q = queries.select("query_id", "query", F.lower("query").alias("low")).filter("query <> ''").distinct()
    size = q.agg(F.sum(F.length("low"))).first()[0] or 0
    n = max(1, -(-size // most))
    out = None
    for i in range(n):
        hits = _literal(records, q if n == 1 else q.filter(F.pmod(F.xxhash64("low"), F.lit(n)) == i))
        out = hits if out is None else out.unionByName(hits)
    return out.select("query_id", "record_id", text.similarity(F.col("content"), F.col("query")).alias("score"), F.length("content").alias("chars"))


def _literal(records: DataFrame, queries: DataFrame) -> DataFrame:
    """``record_id``, ``content``, ``query_id``, ``query`` of each literal hit; the queries fit into one automaton."""
    rows = queries.toArrow().to_pylist()
    number = {low: i for i, low in enumerate(dict.fromkeys(r["low"] for r in rows))}
    shared = records.sparkSession.sparkContext.broadcast(list(number))
    kind = StructType([records.schema["record_id"], records.schema["content"], StructField("at", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        words = Automaton()
        for i, low in enumerate(shared.value):
            words.add_word(low, i)
        words.make_automaton()
        for b in batches:
            of, found = [], []
            for i, low in enumerate(b.column(2)):
                hits = {at for _, at in words.iter(low.as_py())} if shared.value else ()
                found.extend(hits)
                of.extend([i] * len(hits))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of, pa.int64())) for c in (0, 1)), pa.array(found, pa.int64())], ["record_id", "content", "at"])

    texts = spread(records.select("record_id", "content").filter("content is not null")).withColumn("low", F.lower("content"))
    names = records.sparkSession.createDataFrame([(number[r["low"]], r["query_id"], r["query"]) for r in rows], StructType([StructField("at", LongType()), queries.schema["query_id"], queries.schema["query"]]))
    return texts.mapInArrow(run, kind).join(F.broadcast(names), "at").drop("at")


def similar(names: DataFrame, queries: DataFrame, least: float = 0.55) -> DataFrame:
    """``query_id``, ``record_id``, ``score``: names whose trigram similarity to the query is at least ``least``.

    Prefix filter: to reach a Jaccard similarity t, two sets must share an element among the rarest n - ceil(t n) + 1 of
    each. Only these trigrams are joined, rarest first, so a trigram that a third of all names have joins next to nothing;
    sizes must fit too. Candidates are then scored exactly.
    """
    a = names.select("record_id", "content").filter("content is not null").withColumn("g", text.trigrams(F.col("content")))
    q = queries.select("query_id", "query").filter("query is not null").withColumn("g", text.trigrams(F.col("query")))
    rarity = a.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("df"))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key)
        rows = df.select(key, F.explode("g").alias("t"), F.size("g").alias("n")).join(rarity, "t", "left")
        rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "t")))
        return rows.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select(key, "t", F.col("n").alias(f"{key}_n"))

    pairs = prefixes(a, "record_id").join(prefixes(q, "query_id"), "t")
    pairs = pairs.filter(F.least("record_id_n", "query_id_n") >= F.lit(least) * F.greatest("record_id_n", "query_id_n")).select("record_id", "query_id").distinct()
    scored = pairs.join(a.withColumnRenamed("g", "ag"), "record_id").join(q.withColumnRenamed("g", "qg"), "query_id")
    return scored.withColumn("score", text.jaccard(F.col("ag"), F.col("qg"))).filter(F.col("score") >= least).select("query_id", "record_id", "score")


def nearest_sparse(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``record_id``, ``score``, ``rank``: the k records of greatest cosine similarity above zero, exactly.

    records: record_id, bucket, weight; queries: query_id, bucket, weight; both of length one, as hashed embeddings are.
    """
    q = queries.select("query_id", "bucket", F.col("weight").alias("q"))
    hits = records.join(q, "bucket").groupBy("query_id", "record_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return top(hits.filter(F.round("score", 9) > 0), k, F.round("score", 9).desc(), F.col("record_id"))

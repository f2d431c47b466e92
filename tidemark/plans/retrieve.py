"""Hybrid retrieval and context for a batch of questions, end to end.

Questions are planned in Arrow batches, and all legs run as DataFrames over all questions at once; fusion, anchors and selection
follow. Policy, scope and lifecycle filters are the caller's condition on the records, applied before anything is ranked; where
records have times, so are the times that a question names.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import context, fusion, graph, search
from tidemark.plans import intent
from tidemark.plans.tables import Scratch

LIMIT = 20
#: Fusion needs depth: how many times the final limit each leg gives.
DEPTH = {"lexical": 3, "exact": 3, "vector": 1, "entity": 3, "graph": 2}


class Embedder(Protocol):
    """Turns a column of texts into vectors; a pandas UDF or built-in expression behind ``embed``."""

    def embed(self, content: Column) -> Column: ...


class Planner(Protocol):
    def __call__(self, query: str) -> intent.Plan: ...


def asked(spark: SparkSession, questions: dict[str, str] | DataFrame) -> DataFrame:
    """Questions as a table (query_id, query)."""
    return spark.createDataFrame(list(questions.items()), "query_id string, query string") if isinstance(questions, dict) else questions.select(F.col("query_id").cast("string").alias("query_id"), "query")


def _timed(records: DataFrame) -> bool:
    return {"valid_from", "valid_to", "recorded_at"} <= set(records.columns)


def legs(records: DataFrame, entities: DataFrame, edges: DataFrame, planned: DataFrame, allowed: Column | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """Candidates of all legs.

    records: surface, record_id, content, and optionally valid_from, valid_to, recorded_at (null is unbounded, and known from
    the start). entities: entity_id, name. edges: src, dst (entity ids). planned: as of ``intent.planned``. vectors: record_id,
    embedding; query_vectors: query_id, query. A sub-query is a stream of its question.
    """
    spark = records.sparkSession
    seen = records if allowed is None else records.filter(allowed)
    depth = {m: n * limit for m, n in DEPTH.items()}
    when = planned.select("query_id", "known_at", "valid_at")
    subs = planned.select("query_id", "modes", F.explode("subqueries").alias("s")).select("query_id", "modes", "s.*")
    subs = subs.withColumn("qid", F.to_json(F.struct("query_id", "stream")))
    of = lambda mode: subs.filter(F.array_contains("modes", mode))
    frame = lambda rows, query="query": rows.select(F.col("qid").alias("query_id"), F.col(query).alias("query"))

    def back(hits: DataFrame, mode: str) -> DataFrame:
        of_json = lambda c: F.get_json_object("query_id", f"$.{c}")
        return hits.select(of_json("query_id").alias("query_id"), F.lit(mode).alias("mode"), of_json("stream").cast("int").alias("stream"), "rank", "score", "record_id")

    def in_time(hits: DataFrame, question: Column) -> DataFrame:
        """Hits whose record holds, and was known, at the times that their question names."""
        if not _timed(seen):
            return hits
        h = hits.withColumn("own_id", question).join(when.withColumnRenamed("query_id", "own_id"), "own_id").join(seen.select("record_id", "valid_from", "valid_to", "recorded_at"), "record_id")
        starts, ends = F.coalesce(F.col("valid_from") <= F.col("valid_at"), F.lit(True)), F.coalesce(F.col("valid_to") > F.col("valid_at"), F.lit(True))
        return h.filter(starts & ends & F.coalesce(F.col("recorded_at") <= F.col("known_at"), F.lit(True))).select(*hits.columns)

    deep = None if _timed(seen) else depth  # what a question may not see is taken out before ranks are cut
    own = F.get_json_object("query_id", "$.query_id")
    texts = of("lexical").filter("searched")
    anchors = texts.select(F.col("qid").alias("query_id"), F.explode("anchors").alias("a")).select("query_id", F.explode(text.tokens(F.col("a"))).alias("term"))
    if deep:
        found = [back(search.ladder(seen, frame(texts), anchors, limit, relax=False), "lexical")]
    else:
        found = [back(search.ladder(seen, frame(texts), anchors, limit, relax=False, allowed=lambda hits: in_time(hits, own)), "lexical")]
    foci = planned.filter(F.array_contains("modes", "exact")).select("query_id", F.posexplode("focus").alias("stream", "query")).withColumn("qid", F.to_json(F.struct("query_id", "stream")))
    hits = in_time(search.exact(seen, frame(foci)), own)
    found.append(back(search.top(hits, depth["exact"], F.desc("score"), F.col("chars"), F.col("record_id")), "exact"))
    if vectors is not None and query_vectors is not None:
        own_vectors = vectors.join(seen.select("record_id"), "record_id", "left_semi")
        hits = search.nearest(own_vectors, query_vectors, depth["vector"] if deep else None, None if deep else -1.0)
        hits = search.top(in_time(hits.drop("rank"), F.col("query_id")), depth["vector"], F.round("score", 9).desc(), F.col("record_id"))
        found.append(hits.select(F.col("query_id").cast("string").alias("query_id"), F.lit("vector").alias("mode"), F.lit(0).alias("stream"), "rank", "score", "record_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.join(seen.select("record_id", "surface"), "record_id").withColumn("depth", F.lit(0))

    named = entities.select(F.col("entity_id").alias("record_id"), text.normalize_alias(F.col("name")).alias("alias"))
    looked = of("entity").withColumn("alias", text.normalize_alias(F.col("query"))).join(named, "alias")
    hits = looked.select(F.col("qid").alias("query_id"), "record_id", F.lit(1.0).alias("score")).distinct()
    ents = back(search.top(hits, depth["entity"], F.col("record_id")), "entity").withColumn("surface", F.lit("entity")).withColumn("depth", F.lit(0))
    ents = Scratch(spark).write(ents)
    roots = ents.join(planned.filter(F.array_contains("modes", "graph")).select("query_id"), "query_id", "left_semi")
    walked = graph.expand(edges, roots.select(F.col("record_id").alias("entity_id")), 2)
    reach = roots.select("query_id", F.col("record_id").alias("root")).distinct().join(walked, "root").groupBy("query_id", "entity_id").agg(F.min("depth").alias("depth"))
    reach = search.top(reach.withColumnRenamed("entity_id", "record_id").withColumn("score", 1 / (1 + F.col("depth"))), depth["graph"], F.col("depth"), F.col("record_id"))
    reach = reach.select("query_id", F.lit("graph").alias("mode"), F.lit(0).alias("stream"), "rank", "score", "record_id", F.lit("entity").alias("surface"), "depth")
    return out.unionByName(ents).unionByName(reach)


def retrieve(records: DataFrame, entities: DataFrame, edges: DataFrame, questions: dict[str, str] | DataFrame, limit: int = LIMIT, keep_tail: bool = False, allowed: Column | None = None, planner: Planner | None = None, **vectors) -> DataFrame:
    """Fused hits of each question: query_id, surface, record_id, score, position, found_by, anchored."""
    scratch = Scratch(records.sparkSession)
    # plans, and the few candidates, are written once: every later step reads them more than once
    planned = scratch.write(intent.planned(asked(records.sparkSession, questions), bool(vectors), planner))
    found = scratch.write(legs(records, entities, edges, planned, allowed, limit=limit, **vectors))
    fused = fusion.fuse(found, keep_tail).join(planned.select("query_id", (F.col("width") * limit).alias("wide")), "query_id")
    wide = fusion.diversify(fused, F.col("wide"), 1).drop("wide")
    anchors = planned.select("query_id", F.explode("focus").alias("anchor"))
    return fusion.anchored_first(wide, records, anchors, limit)


def assemble(hits: DataFrame, candidates: DataFrame, budget: int = 2000, most: int = 60, near: DataFrame | None = None, claims: DataFrame | None = None, planned: DataFrame | None = None, inputs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen items and rendered blocks: candidates are records with what ``context.select`` needs but relevance.

    With near (record_id, previous, next) hits bring their neighbours, with claims entity hits bring claims about them, and with
    planned questions what these require brings the claims of the same slots (``context.required``).
    """
    rows = hits.select("query_id", "record_id", F.col("score").alias("relevance"))
    if near is not None:
        rows = context.neighbour_relevance(rows, near)
    if claims is not None:
        rows = rows.unionByName(context.entity_claims(rows, claims)).groupBy("query_id", "record_id").agg(F.max("relevance").alias("relevance"))
    if planned is not None and claims is not None:
        focus = candidates.groupBy("record_id").agg(F.max("focus").alias("focus"))
        more = context.required(rows.join(focus, "record_id", "left"), claims, planned, inputs)
        rows = rows.withColumn("brought", F.lit(False)).unionByName(more.withColumn("brought", F.lit(True)))
        rows = rows.join(candidates, "record_id").withColumn("required", F.col("required") | F.col("brought")).drop("brought")
    else:
        rows = rows.join(candidates, "record_id")
    chosen = context.select(rows, budget, most)
    return chosen, context.render(chosen, candidates)

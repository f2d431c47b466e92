"""Walks over edges and merge pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.tables import Scratch

MOST_DEPTH, POINTER_DEPTH = 5, 32


def expand(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """``root``, ``entity_id``, ``depth``: what each root reaches over edges in either direction, at its least depth.

    edges: src, dst, filtered by policy, validity and predicates before they get here. Breadth first: each level is the
    join of the last with the edges, without what the root reached before, written to the shared folder.
    """
    depth = max(1, min(depth, MOST_DEPTH))
    scratch = Scratch(edges.sparkSession)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    levels = [roots.select(F.col("entity_id").alias("root"), "entity_id").dropna().distinct().withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        new = levels[-1].select("root", F.col("entity_id").alias("src")).join(both, "src").select("root", F.col("dst").alias("entity_id")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("root", "entity_id")
        levels.append(scratch.write(new.join(seen, ["root", "entity_id"], "left_anti").withColumn("depth", F.lit(d))))
    return reduce(DataFrame.unionByName, levels[1:])


def canonical(entities: DataFrame) -> DataFrame:
    """``entity_id``, ``canonical_id``: where following merged_into_id ends.

    Pointer doubling: after n rounds chains of 2 ** n are resolved. A pointer to an entity that isn't there ends before it;
    the members of a cycle, which has no end, all get its least id. On a chain that isn't resolved yet fewer entities move
    after each round; once as many move as before, all of them are on or before a cycle, and when the round lowered no least
    id either, they have seen all of it.
    """
    spark = entities.sparkSession
    scratch = Scratch(spark)
    ids = entities.select("entity_id").dropna().distinct()
    to = entities.select("entity_id", F.col("merged_into_id").alias("to")).filter("to is not null and to <> entity_id").groupBy("entity_id").agg(F.max("to").alias("to"))
    to = scratch.write(to.join(ids.select(F.col("entity_id").alias("to")), "to", "left_semi").select("entity_id", "to"))
    ends = to.select(F.col("entity_id").alias("to")).withColumn("moves", F.lit(True))
    at = ids.join(to, "entity_id", "left").select("entity_id", F.coalesce("to", "entity_id").alias("to"), F.coalesce("to", "entity_id").alias("least"))
    at = scratch.write(at.join(ends, "to", "left"))
    moving = None
    while True:
        far = at.select(F.col("entity_id").alias("to"), F.col("to").alias("further"), F.col("least").alias("other"))
        new = at.drop("moves").join(far, "to").select("entity_id", F.col("further").alias("to"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("lower"))
        new = scratch.write(new.join(ends, "to", "left"))
        scratch.drop(at)
        at = new
        before, (moving, lower) = moving, at.agg(F.count("moves"), F.count(F.when(F.col("moves") & F.col("lower"), 1))).first()
        if not moving or moving == before and not lower:
            break
    # what still moves is on or before a cycle; its members saw all of the cycle
    return at.select("entity_id", F.when(F.col("moves"), F.col("least")).otherwise(F.col("to")).alias("canonical_id"))


def merge_would_cycle(canonicals: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (entity_id, into_id) whose target already ends at the entity itself."""
    end = canonicals.select(F.col("entity_id").alias("into_id"), F.col("canonical_id").alias("end"))
    return merges.join(end, "into_id").filter("end = entity_id or into_id = entity_id").select("entity_id", "into_id")


def merged(entities: DataFrame, merges: DataFrame, at: str) -> DataFrame:
    """Set the redirect pointers of the named entities (entity_id, into_id); history stays, only the pointer is new."""
    m = merges.groupBy("entity_id").agg(F.max("into_id").alias("into_id"))
    out = entities.join(m, "entity_id", "left")
    return out.withColumn("merged_at", F.when(F.col("into_id").isNotNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("merged_at"))).withColumn("merged_into_id", F.coalesce("into_id", "merged_into_id")).drop("into_id")


def split(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Clear the pointers of the named entities."""
    named = ids.select("entity_id").distinct().withColumn("named", F.lit(True))
    out = entities.join(named, "entity_id", "left")
    kept = lambda c: F.when(F.col("named").isNull(), F.col(c)).alias(c)
    return out.withColumns({"merged_into_id": kept("merged_into_id"), "merged_at": kept("merged_at")}).drop("named")

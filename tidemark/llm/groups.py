"""Consolidating pairwise matches into groups.

Connected components in two parts. First the component of the vertex with the most links, where a giant one would be: it is
peeled by breadth-first joins of the frontier with the links, each level held against the two before it only. It is then
anti-joined away. Where its levels get long and thin, the rest of it is left to the second part, with what was peeled
contracted to its least member. Second, the small components: every vertex takes the least of its neighbours and itself,
labels are followed once, links are contracted to labels; at each round at least the vertices that aren't locally least
vanish, so rounds grow with the logarithm of the longest chain. Every level and round is written to the shared folder.

Matches by a common key become links of each member to the key's least member, never all pairs. Keys that hold more than
a thousandth of the memberships (fewer than a thousand keys) get their least member by a broadcast, the rest by a shuffle.

Defined cases: a pair with a null or of a record with itself links nothing; repeated pairs and rows have no effect; records
without any link are in no group; empty tables give an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.tables import Scratch

LEVELS = 40


def key_pairs(members: DataFrame, keys: list[str], record: str) -> DataFrame:
    """Pairs ``a``, ``b`` of each record with the least record of a common key. Null keys link nothing."""
    scratch = Scratch(members.sparkSession)
    rows = scratch.write(members.select(*keys, F.col(record).alias("b")).dropna().distinct())
    least = rows.groupBy(*keys).agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
    share = F.greatest(F.lit(10_000), F.lit(rows.count()) / 1000)
    hot = least.filter(F.col("n") > share).drop("n")
    cold = least.filter(F.col("n") <= share).drop("n")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(cold, keys)).filter("a != b").select("a", "b")


def _peel(scratch: Scratch, links: DataFrame) -> tuple[DataFrame | None, bool]:
    """The vertices reached from the one with the most links; whether that is its whole component."""
    spark = scratch.spark
    top = links.groupBy("a").count().orderBy(F.desc("count"), "a").first()
    if top is None:
        return None, True
    levels = [scratch.write(spark.createDataFrame([(top.a,)], "v string"))]
    reached = 1
    while len(levels) < LEVELS:
        near = links.join(levels[-1].withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), F.lit(0).alias("old"))
        for old in levels[-2:]:
            near = near.unionByName(old.select("v", F.lit(1).alias("old")))
        # what is new, and each once: one aggregation, combined before its shuffle
        new = scratch.write(near.groupBy("v").agg(F.max("old").alias("old")).filter("old = 0").select("v"))
        n = new.count()
        if n == 0:
            return reduce(DataFrame.unionByName, levels), True
        levels.append(new)
        reached += n
        if len(levels) > 8 and n < reached / 1000:
            break
    return reduce(DataFrame.unionByName, levels), False


def _followed(rest: DataFrame) -> DataFrame:
    """``v``, ``to``: each vertex with the least of its neighbours and itself, followed once."""
    least_of = rest.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
    far = least_of.select(F.col("v").alias("to"), F.col("to").alias("further"))
    return least_of.join(far, "to", "left").select("v", F.coalesce("further", "to").alias("to"))


def groups(pairs: DataFrame) -> DataFrame:
    """``group_id`` (the least member), ``id`` of every record that any pair ``a``, ``b`` links."""
    spark = pairs.sparkSession
    scratch = Scratch(spark)
    pairs = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a != b")
    links = scratch.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    peeled, whole = _peel(scratch, links)
    if peeled is None:
        return links.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    peeled = scratch.write(peeled)
    least = peeled.agg(F.min("v")).first()[0]
    rest = links.join(peeled.withColumnRenamed("v", "a"), "a", "left_anti")
    if not whole:
        back = peeled.select(F.col("v").alias("b"), F.lit(least).alias("to"))
        rest = rest.join(back, "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        rest = rest.unionByName(rest.filter(F.col("b") == least).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rest = scratch.write(rest)

    steps: list[DataFrame] = []
    while rest.count():
        step = scratch.write(_followed(rest))
        # links go both ways, so half of them are enough to move, and to turn round
        half = rest.filter("a < b").join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        half = half.join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b").filter("x != y")
        ends = half.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("l"))
        moved = ends.select("l.a", "l.b").distinct()
        moved = scratch.write(moved)
        scratch.drop(rest)
        rest = moved
        steps.append(step)
    # labels compose from the last, smallest step back to the first, which has every vertex
    labels = None
    for step in reversed(steps):
        if labels is None:
            labels = step
        else:
            onward = labels.select(F.col("v").alias("to"), F.col("to").alias("next"))
            labels = step.join(onward, "to", "left").select("v", F.coalesce("next", "to").alias("to"))

    giant = peeled.select(F.lit(least).alias("to"), F.col("v"))
    if labels is None:
        return giant.select(F.col("to").alias("group_id"), F.col("v").alias("id"))
    if not whole:
        end = labels.filter(F.col("v") == least).select("to").first()
        giant = peeled.select(F.lit(end[0] if end else least).alias("to"), F.col("v"))
        labels = labels.filter(F.col("v") != least)
    return giant.unionByName(labels.select("to", "v")).select(F.col("to").alias("group_id"), F.col("v").alias("id"))

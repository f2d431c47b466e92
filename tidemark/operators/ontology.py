"""Checking claims against an ontology: which types and predicates exist, what a predicate takes.

A broadcast of the constraints would need a bound, so they join by the predicate's name and Catalyst picks the side; each
claim gets all of its violations, not the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = ("unknown_entity_type", "unknown_predicate", "subject_type", "object_type", "object_kind", "value")


def violations(claims: DataFrame, predicates: DataFrame, entity_types: list[str]) -> DataFrame:
    """The claims with ``violations``, an array of codes.

    claims: subject_type, object_type, predicate, object_kind, object_text (types null where unknown, which no rule about
    types judges). predicates: name, subject_types, object_types, object_kinds, allowed_values (arrays, empty or null for any).
    """
    p = predicates.select(F.col("name").alias("predicate"), F.struct("*").alias("rule"))
    both = claims.join(p, "predicate", "left")
    rule = F.col("rule")
    known = rule.isNotNull()
    limited = lambda c: known & (F.coalesce(F.size(rule[c]), F.lit(0)) > 0)
    inside = lambda c, x: F.coalesce(F.array_contains(rule[c], x), F.lit(False))
    foreign = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & ~F.coalesce(F.col(c).isin(*entity_types), F.lit(False))
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    folded = F.transform(rule["allowed_values"], lambda v: F.upper(v))
    checks = [
        F.when(foreign("subject_type"), "unknown_entity_type"),
        F.when(foreign("object_type"), "unknown_entity_type"),
        F.when(~known, "unknown_predicate"),
        F.when(limited("subject_types") & given("subject_type") & ~inside("subject_types", F.col("subject_type")), "subject_type"),
        F.when(limited("object_types") & (F.col("object_kind") == "entity") & given("object_type") & ~inside("object_types", F.col("object_type")), "object_type"),
        F.when(limited("object_kinds") & given("object_kind") & ~inside("object_kinds", F.col("object_kind")), "object_kind"),
        F.when(limited("allowed_values") & (F.col("object_kind") == "symbol") & ~F.coalesce(F.array_contains(folded, F.upper("object_text")), F.lit(False)), "value"),
    ]
    return both.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull())).drop("rule")


def report(checked: DataFrame) -> DataFrame:
    """How many violations of each code there are: ``code``, ``claims``."""
    return checked.select(F.explode("violations").alias("code")).groupBy("code").agg(F.count("*").alias("claims"))

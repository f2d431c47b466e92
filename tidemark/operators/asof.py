"""The temporal query over claims: what was believed at one time about another.

Every filter is a plain predicate on the claims' columns, so Catalyst pushes it to the scan; semi-joins stay semi-joins.
Null instants switch a filter off. Unless told otherwise, believable claims (active, disputed) are given; a known time
overrides the status, because a claim superseded today was believed yesterday.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import intervals, ordering
from tidemark.functions.text import normalize_predicate

BELIEVABLE = ("active", "disputed")
DEFAULT_LIMIT, MOST = 100, 1000


def instant(x: datetime | str | None) -> Column | None:
    return None if x is None else F.lit(str(x)).cast("timestamp_ntz")


def known_at(at: Column) -> Column:
    """Recorded by then and neither superseded nor retracted by then; the status doesn't count."""
    after = lambda c: F.col(c).isNull() | (F.col(c) > at)
    return (F.col("recorded_at") <= at) & after("superseded_at") & after("retracted_at")


def valid_at(at: Column) -> Column:
    return intervals.contains("valid_from", "valid_to", at)


def valid_between(lo: Column, hi: Column) -> Column:
    """Validity overlaps [lo, hi)."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") < hi)) & (F.col("valid_to").isNull() | (F.col("valid_to") > lo))


def event_between(lo: Column, hi: Column) -> Column:
    return (F.col("event_time") >= lo) & (F.col("event_time") < hi)


def active_at(at: Column) -> Column:
    """Within the context lifecycle: active, and not expired."""
    return intervals.contains("active_from", "active_until", at) & (F.col("expires_at").isNull() | (F.col("expires_at") > at))


def edge_active_at(at: Column) -> Column:
    """Edges carry the ends of the lifecycle only."""
    after = lambda c: F.col(c).isNull() | (F.col(c) > at)
    return after("active_until") & after("expires_at")


def changed_since(sequence: Column, cursor: str) -> Column:
    """Later than a cursor, as numbers if both are digits only, else as text. Asks for rows of one source."""
    return ordering.compare_sequences(sequence, F.lit(cursor)) == ordering.AFTER


@dataclass
class ClaimQuery:
    known_at: datetime | str | None = None
    valid_at: datetime | str | None = None
    valid_between: tuple | None = None
    event_between: tuple | None = None
    active_at: datetime | str | None = None
    statuses: tuple[str, ...] = ()
    include_superseded: bool = False
    subjects: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    object_keys: tuple[str, ...] = ()
    memory_kinds: tuple[str, ...] = ()
    classifications: tuple[str, ...] = ()
    source_requests: tuple[str, ...] = ()
    least_confidence: float = 0.0
    limit: int | None = None
    offset: int = 0
    extra: list[Column] = field(default_factory=list)


def status_filter(q: ClaimQuery) -> Column | None:
    """Known time before listed statuses before include_superseded before the default."""
    if q.known_at is not None:
        return known_at(instant(q.known_at))
    if q.statuses:
        return F.col("status").isin(*q.statuses)
    if q.include_superseded:
        return F.col("status") != "retracted"
    return F.col("status").isin(*BELIEVABLE)


def claims_as_of(claims: DataFrame, q: ClaimQuery) -> DataFrame:
    """The claims that a query asks for. With a limit: the latest recorded first, then the greatest id."""
    tests = [status_filter(q), *q.extra]
    if q.valid_at is not None:
        tests.append(valid_at(instant(q.valid_at)))
    if q.valid_between:
        tests.append(valid_between(*map(instant, q.valid_between)))
    if q.event_between:
        tests.append(event_between(*map(instant, q.event_between)))
    if q.active_at is not None:
        tests.append(active_at(instant(q.active_at)))
    sets = {"subject_id": q.subjects, "object_key": q.object_keys, "memory_kind": q.memory_kinds, "classification": q.classifications, "source_request_id": q.source_requests}
    tests += [F.col(c).isin(*v) for c, v in sets.items() if v]
    if q.predicates:
        tests.append(normalize_predicate(F.col("predicate_name")).isin(*(p.upper() for p in q.predicates)))
    if q.least_confidence > 0:
        tests.append(F.col("confidence") >= q.least_confidence)
    out = claims
    for t in tests:
        if t is not None:
            out = out.filter(t)
    if q.limit is not None:
        size = DEFAULT_LIMIT if q.limit <= 0 else min(q.limit, MOST)
        out = out.orderBy(F.desc("recorded_at"), F.desc("assertion_id")).offset(max(0, q.offset)).limit(size)
    return out


def from_sources(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Claims whose request is among the given ones (``request_id``)."""
    return claims.join(requests.select(F.col("request_id").alias("source_request_id")), "source_request_id", "left_semi")


def trusted(claims: DataFrame, requests: DataFrame, sources: DataFrame, floor: str) -> DataFrame:
    """Claims whose source has at least the trust level."""
    least = ordering.TRUST.index(floor) + 1
    good = sources.filter(ordering.rank(F.col("trust_level"), ordering.TRUST) >= least).select("source_id")
    return from_sources(claims, requests.join(good, "source_id", "left_semi"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, ties: str, stretch_seconds: int = 86_400) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time; left rows without one keep nulls.

    Both sides become one stream per key and stretch of time, over which the last right row is carried forward; what a
    stretch hands to later ones is carried over the stretches of a key, one row each. A key with a third of all rows is
    thus spread over its stretches, and no product of rows is made. Of right rows at one time the greatest ``ties`` (as
    text) is the latest. Right columns other than the keys get the prefix ``right_``. Rows with a null key or time match
    nothing; repeated left rows stay.
    """
    carried = [c for c in right.columns if c not in keys]
    whole = [*(F.col(k).isNotNull() for k in keys), F.col(left_time).isNotNull()]
    fit = reduce(lambda a, b: a & b, whole)
    mine = left.select(F.struct("*").alias("l"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(left_time).alias("t"), fit.alias("fit"))
    theirs = right.dropna(subset=[*keys, right_time]).select(F.struct(*carried).alias("r"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(right_time).alias("t"), F.col(ties).cast("string").alias("tie"))
    ks = [f"k{i}" for i in range(len(keys))]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = theirs.select("r", none(mine, "l"), *ks, "t", F.lit(0).alias("side"), "tie")
    rows = rows.unionByName(mine.filter("fit").select(none(theirs, "r"), "l", *ks, "t", F.lit(1).alias("side"), F.lit(None).cast("string").alias("tie")))
    rows = rows.withColumn("stretch", F.floor(F.unix_micros(F.col("t").cast("timestamp")) / (stretch_seconds * 1_000_000)))
    inside = Window.partitionBy(*ks, "stretch").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("near", F.last("r", ignorenulls=True).over(inside)).filter("side = 1")
    ends = rows.groupBy(*ks, "stretch").agg(F.max_by("r", F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("end"))
    before = Window.partitionBy(*ks).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*ks, "stretch", F.last("end", ignorenulls=True).over(before).alias("far"))
    found = local.join(ends, [*ks, "stretch"]).select("l", F.coalesce("near", "far").alias("r"))
    found = found.unionByName(mine.filter("not fit").select("l", none(theirs, "r")))
    return found.select("l.*", *(F.col("r")[c].alias(f"right_{c}") for c in carried))

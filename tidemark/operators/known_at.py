"""Attributes as they were known at the time of an event.

Per shard (a subject's claims) and attribute, a persistent search tree over valid time: a treap keyed by the start of
validity, each node with the furthest end and the latest record below it. A claim's recording inserts it, its closing
removes it; both copy one path, and the root after each change stays. An event selects the root of its known time, then
searches it for the claim that is valid at its valid time and was recorded last. Knowledge from later times isn't in that
root, so it can't leak.

Subjects, claims and events arrive hashed by subject. A subject with more than ``limit`` claims or events is cut: by attribute,
and its claims by the order of recording into stretches of about ``limit``, from counts. No claim is in two stretches. An event
first asks the stretch of its known time: an answer there was recorded after all earlier stretches, so it stands. Only an event
without an answer goes on, to one, two, four and so on stretches before. Events beyond ``limit`` in a stretch are split, and bring
its claims with them, no more copies than events.

Defined cases: null starts and ends are unbounded; a claim never recorded, or closed when recorded, is never known; an
event without times or subject knows nothing; a null attribute is an attribute of its own; of several claims the one
recorded last is known, of equals the one with the greatest id; repeated rows have no effect; empty tables give an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import Scratch

NEVER = 2**62
#: Claims in one search tree, some 200 MB in Python with all its roots.
LIMIT = 50_000


class _Node:
    """Never changed once made."""

    __slots__ = ("left", "right", "start", "end", "rank", "heap", "far", "best")

    def __init__(self, left, right, start: int, end: int, rank: tuple, heap: int) -> None:
        self.left, self.right, self.start, self.end, self.rank, self.heap = left, right, start, end, rank, heap
        far, best = end, rank
        for kid in (left, right):
            if kid is not None:
                if kid.far > far:
                    far = kid.far
                if kid.best > best:
                    best = kid.best
        self.far, self.best = far, best


def _with(n: _Node, left, right) -> _Node:
    return _Node(left, right, n.start, n.end, n.rank, n.heap)


def _split(n, key: tuple):
    if n is None:
        return None, None
    if (n.start, n.rank) < key:
        a, b = _split(n.right, key)
        return _with(n, n.left, a), b
    a, b = _split(n.left, key)
    return a, _with(n, b, n.right)


def _join(a, b):
    if a is None or b is None:
        return a or b
    if a.heap > b.heap:
        return _with(a, a.left, _join(a.right, b))
    return _with(b, _join(a, b.left), b.right)


def inserted(n, start: int, end: int, rank: tuple):
    """The root of a tree that also has the claim; the old one stays as it was."""
    heap = crc32(repr((start, rank)).encode())
    return _inserted(n, start, end, rank, heap)


def _inserted(n, start: int, end: int, rank: tuple, heap: int):
    if n is None or heap > n.heap:
        a, b = _split(n, (start, rank))
        return _Node(a, b, start, end, rank, heap)
    if (start, rank) < (n.start, n.rank):
        return _with(n, _inserted(n.left, start, end, rank, heap), n.right)
    return _with(n, n.left, _inserted(n.right, start, end, rank, heap))


def removed(n, start: int, rank: tuple):
    if n is None:
        return None
    if (n.start, n.rank) == (start, rank):
        return _join(n.left, n.right)
    if (start, rank) < (n.start, n.rank):
        return _with(n, removed(n.left, start, rank), n.right)
    return _with(n, n.left, removed(n.right, start, rank))


def latest(n, at: int, best: tuple | None = None) -> tuple | None:
    """The greatest rank of the claims valid at a time, if greater than best."""
    while n is not None and n.far > at and (best is None or n.best > best):
        if n.start > at:
            n = n.left
            continue
        if n.end > at and (best is None or n.rank > best):
            best = n.rank
        best = latest(n.left, at, best)
        n = n.right
    return best


class History:
    """The roots of one attribute by known time. Claims are (start, end, rank, opened, closed)."""

    def __init__(self, claims: list[tuple]) -> None:
        steps = []
        for start, end, rank, opened, closed in claims:
            if closed > opened:
                steps.append((opened, 1, start, end, rank))
                if closed < NEVER:
                    steps.append((closed, 0, start, end, rank))
        steps.sort()
        self.times: list[int] = []
        self.roots: list = []
        root = None
        for time, opens, start, end, rank in steps:
            root = inserted(root, start, end, rank) if opens else removed(root, start, rank)
            if self.times and self.times[-1] == time:
                self.roots[-1] = root
            else:
                self.times.append(time)
                self.roots.append(root)

    def known(self, known: int, valid: int) -> tuple | None:
        at = bisect_right(self.times, known) - 1
        return latest(self.roots[at], valid) if at >= 0 else None


def _ints(x: pa.Array) -> list:
    return x.cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()


FOUND = "event_id string, attribute string, claim_id string, recorded timestamp_ntz, known_at timestamp_ntz, valid_at timestamp_ntz"
_ROW = ("event", "a", "i", "t1", "t2", "t3", "t4")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, claims first, then events by id: shard, is_event, attribute, id, four times."""
    shard, claims, trees, last, given = None, {}, None, None, set()
    times = pa.timestamp("us")
    for b in batches:
        out: list[tuple] = []
        cols = [b.column(i).to_pylist() for i in range(4)] + [_ints(b.column(i)) for i in range(4, 8)]
        for s, event, attribute, i, t1, t2, t3, t4 in zip(*cols):
            if s != shard:
                shard, claims, trees, last = s, {}, None, None
            if not event:
                start, end = -NEVER if t1 is None else t1, NEVER if t2 is None else t2
                claims.setdefault(attribute, set()).add((start, end, (t3, i), t3, NEVER if t4 is None else t4))
                continue
            if trees is None:
                trees, claims = [(a, History(list(x))) for a, x in claims.items()], {}
            if i != last:
                last, given = i, set()
            for a, history in trees:
                found = history.known(t1, t2)
                if found is not None and (a, found[1]) not in given:
                    given.add((a, found[1]))
                    out.append((i, a, found[1], found[0], t1, t2))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.int64()).cast(times) for c in cols[3:])], ["event_id", "attribute", "claim_id", "recorded", "known_at", "valid_at"])


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select("shard", *_ROW).repartition("shard").sortWithinPartitions("shard", "event", "i").mapInArrow(_answers, FOUND)


def known_at(events: DataFrame, claims: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``event_id``, ``attribute``, ``claim_id``: of each event and attribute the claim known then.

    events: subject, event_id, known_at, valid_at. claims: subject, attribute, claim_id, valid_from, valid_to,
    recorded_at, closed_at (the earliest time from which the claim is no longer believed).
    """
    t = lambda c: F.col(c).cast("timestamp_ntz")
    s = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    asks = events.select(s("subject").alias("s"), F.lit(True).alias("event"), none.alias("a"), s("event_id").alias("i"), t("known_at").alias("t1"), t("valid_at").alias("t2"), t("known_at").alias("t3"), t("known_at").alias("t4"))
    asks = asks.filter("s is not null and t1 is not null and t2 is not null")
    facts = claims.select(s("subject").alias("s"), F.lit(False).alias("event"), s("attribute").alias("a"), s("claim_id").alias("i"), t("valid_from").alias("t1"), t("valid_to").alias("t2"), t("recorded_at").alias("t3"), t("closed_at").alias("t4"))
    facts = facts.filter("s is not null and t3 is not null and (t4 is null or t4 > t3) and (t1 is null or t2 is null or t2 > t1)")

    rows = asks.unionByName(facts)
    counts = asks.select("s", F.lit(1).alias("e"), F.lit(0).alias("c")).unionByName(facts.select("s", F.lit(0).alias("e"), F.lit(1).alias("c"))).groupBy("s").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    scratch = Scratch(rows.sparkSession)
    hot = scratch.write(counts.filter(f"e > {limit} or c > {limit}").select("s"))  # at most one row for each ``limit`` of the input
    if hot.isEmpty():
        found = _asked(rows.withColumn("shard", F.col("s")))
        return found.select("event_id", "attribute", "claim_id")
    found = _asked(rows.join(hot, "s", "left_anti").withColumn("shard", F.col("s"))).select("event_id", "attribute", "claim_id")
    return found.unionByName(_hot(scratch, asks.join(hot, "s", "left_semi"), facts.join(hot, "s", "left_semi"), limit)).distinct()


def _hot(scratch: Scratch, asks: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """The answers for the events of subjects that are too large for one tree."""
    slot = ["s", "k"]  # subject and attribute, a null one too
    facts = facts.distinct().withColumn("k", F.to_json(F.array("a"), {"ignoreNullFields": "false"})).withColumn("at", F.struct("t3", "i"))
    # a claim in so many marks its place; every so many marks a stretch begins
    step = max(1, limit // 1000)
    marks = facts.filter(F.pmod(F.xxhash64("i", "t3"), F.lit(step)) == 0).select(*slot, "at").distinct()
    marks = marks.withColumn("r", F.row_number().over(Window.partitionBy(*slot).orderBy("at"))).filter(F.col("r") % (limit // step) == 0)
    bounds = marks.groupBy(*slot).agg(F.array_sort(F.collect_list("at")).alias("bounds"))
    placed = facts.join(bounds, slot, "left").withColumn("p", F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("at"))), F.lit(0)))
    placed = scratch.write(placed.select(*slot, "p", *_ROW))
    attributes = placed.select(*slot, "a").distinct().join(bounds, slot, "left")
    waiting = asks.distinct().drop("a").join(attributes, "s").withColumn("p", F.coalesce(F.size(F.filter("bounds", lambda b: b["t3"] <= F.col("t1"))), F.lit(0)))
    own = F.to_json(F.array("s", "i")).alias("i")  # an event of two subjects asks for each
    waiting = scratch.write(waiting.select(*slot, "p", *(own if c == "i" else c for c in _ROW)))
    results, width = [], 1
    while not waiting.isEmpty():
        sent = waiting.withColumn("p", F.explode(F.sequence(F.col("p"), F.greatest(F.lit(0), F.col("p") - (width - 1)), F.lit(-1))))
        parts = sent.groupBy(*slot, "p").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
        shard = F.to_json(F.array("s", "k", F.col("p").cast("string"), F.col("part").cast("string"))).alias("shard")
        events = sent.join(parts, [*slot, "p"]).withColumn("part", F.pmod(F.xxhash64("i", "t1", "t2"), F.col("parts")).cast("int"))
        claims = placed.join(parts, [*slot, "p"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = _asked(events.select(shard, *_ROW).unionByName(claims.select(shard, *_ROW)))
        found = scratch.write(found.groupBy("event_id", "attribute", "known_at", "valid_at").agg(F.max(F.struct("recorded", "claim_id")).alias("x")))
        results.append(found.select(F.get_json_object("event_id", "$[1]").alias("event_id"), "attribute", "x.claim_id"))
        answered = found.select(F.col("event_id").alias("i"), F.to_json(F.array("attribute"), {"ignoreNullFields": "false"}).alias("k"), F.col("known_at").alias("t1"), F.col("valid_at").alias("t2"))
        before = waiting
        waiting = scratch.write(waiting.filter(F.col("p") >= width).join(answered, ["i", "k", "t1", "t2"], "left_anti").withColumn("p", F.col("p") - width).select(*slot, "p", *_ROW))
        scratch.drop(before)
        width *= 2
    out = results[0] if results else scratch.spark.createDataFrame([], "event_id string, attribute string, claim_id string")
    for r in results[1:]:
        out = out.unionByName(r)
    return out

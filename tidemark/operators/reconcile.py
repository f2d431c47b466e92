"""Reconciling claims about one slot as they arrive.

Arrival order is recorded_at, then id. A claim that another of the same source at a later position already stands against
is superseded on arrival; earlier states of its own source are superseded by it; claims of other sources are judged by the
predicate's policy: latest_wins, highest_authority, or else a conflict set. Equal values corroborate and never compete.

The general rule is a fold over each slot's arrivals. Slots are hashed over the cluster and sorted inside the partitions,
so a slot is read as a stream; the fold keeps only claims that can still compete (active, disputed), indexed by the time they
hold for, not the slot's rows. A correction, or a claim said to replace an earlier value, retires what the same source stated
in other requests. The closed form covers one source per slot with pairwise different values and open validity, without any Python.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.functions.ordering import TRUST
from tidemark.operators.periods import LEAST, MOST

OPEN = ("active", "disputed")
#: ``policy`` is the slot's, the same in all its claims; ``replaces`` says that the source stated the value in place of an earlier one.
FIELDS = "slot string, id string, object_key string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, source string, sequence string, commit_time timestamp_ntz, trust string, policy string, operation string, status string"
OPTIONAL = "request string, replaces boolean"
RESULT = "slot string, id string, status string, superseded_at timestamp_ntz, superseded_by string, conflict_set string"


def superseded_closed_form(claims: DataFrame, slot: list[str], position: str) -> DataFrame:
    """``superseded_at`` under latest_wins: when a later position of the slot was first recorded, own arrival at the least."""
    later = Window.partitionBy(*slot).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    first = F.min("recorded_at").over(later)
    at = F.when(first.isNotNull(), F.greatest("recorded_at", first))
    return claims.withColumn("superseded_at", at).withColumn("superseded_on_arrival", F.coalesce(at == F.col("recorded_at"), F.lit(False)))


def order(a: dict, b: dict) -> int | None:
    """-1, 0, 1 between two states of one source; None where nothing tells."""
    if a["source"] is None or a["source"] != b["source"]:
        return None
    x, y = a["sequence"] or None, b["sequence"] or None
    if x is not None and y is not None:
        if x.isdecimal() and x.isascii() and y.isdecimal() and y.isascii():
            x, y = int(x), int(y)
        return (x > y) - (x < y)
    x, y = a["commit_time"], b["commit_time"]
    return None if x is None or y is None else (x > y) - (x < y)


def _two(a: tuple, b: tuple) -> tuple:
    """Of two lists of (arrival, value): the first arrival, and the first of another value."""
    some = sorted(a + b, key=lambda x: x[0])
    return next(((some[0], x) for x in some if x[1] != some[0][1]), (some[0],))


class _Node:
    __slots__ = ("key", "hi", "claim", "value", "power", "heap", "left", "right", "far", "top", "firsts")

    def __init__(self, key: tuple, hi: datetime, claim: dict, heap: float) -> None:
        self.key, self.hi, self.claim, self.heap = key, hi, claim, heap
        self.value, self.power, self.left, self.right = claim["object_key"], power(claim), None, None
        self.settle()

    def settle(self) -> "_Node":
        self.far, self.top, self.firsts = self.hi, self.power, ((self.key[1], self.value),)
        for kid in (self.left, self.right):
            if kid is not None:
                self.far, self.top, self.firsts = max(self.far, kid.far), max(self.top, kid.top), _two(self.firsts, kid.firsts)
        return self


class Overlaps:
    """Claims by the time they hold for: a treap by (start, arrival).

    Each node knows the furthest end, the greatest power and the first arrivals of two different values below it, so that a
    search leaves out what ends too early or has no other value than the one asked with.
    """

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.random = random.Random(0)

    def _split(self, n: _Node | None, key: tuple) -> tuple:
        if n is None:
            return None, None
        if n.key < key:
            n.right, rest = self._split(n.right, key)
            return n.settle(), rest
        rest, n.left = self._split(n.left, key)
        return rest, n.settle()

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.heap > b.heap:
            a.right = self._join(a.right, b)
            return a.settle()
        b.left = self._join(a, b.left)
        return b.settle()

    def add(self, lo: datetime, hi: datetime, arrival: int, claim: dict) -> None:
        new = _Node((lo, arrival), hi, claim, self.random.random())

        def into(n: _Node | None) -> _Node:
            if n is None or new.heap > n.heap:
                new.left, new.right = self._split(n, new.key)
                return new.settle()
            if new.key < n.key:
                n.left = into(n.left)
            else:
                n.right = into(n.right)
            return n.settle()

        self.root = into(self.root)

    def remove(self, lo: datetime, arrival: int) -> None:
        key = (lo, arrival)

        def out(n: _Node | None) -> _Node | None:
            if n is None:
                return None
            if n.key == key:
                return self._join(n.left, n.right)
            if key < n.key:
                n.left = out(n.left)
            else:
                n.right = out(n.right)
            return n.settle()

        self.root = out(self.root)

    def rivals(self, lo: datetime, hi: datetime, value: str | None, least: int = -1) -> Iterator[dict]:
        """Claims of another value, of ``least`` power or more, that share an instant with [lo, hi)."""
        todo = [self.root]
        while todo:
            n = todo.pop()
            if n is None or n.far <= lo or n.top < least or all(v == value for _, v in n.firsts):
                continue
            todo.append(n.left)
            if n.key[0] < hi:
                todo.append(n.right)
                if n.hi > lo and n.value != value and n.power >= least:
                    yield n.claim

    def first(self, lo: datetime, hi: datetime, value: str | None) -> dict | None:
        """Of these rivals the one that arrived first."""
        best, found, todo = None, None, [self.root]
        while todo:
            n = todo.pop()
            if n is None or n.far <= lo:
                continue
            bound = next((at for at, v in n.firsts if v != value), None)
            if bound is None or best is not None and bound >= best:
                continue
            todo.append(n.left)
            if n.key[0] < hi:
                todo.append(n.right)
                if n.hi > lo and n.value != value and (best is None or n.key[1] < best):
                    best, found = n.key[1], n.claim
        return found


def power(c: dict) -> int:
    return TRUST.index(c["trust"]) + 1 if c["trust"] in TRUST else 0


class Slot:
    """The claims of one slot that can still compete, by time (``fresh``, and ``held`` in a conflict set) and by source.

    An arrival costs time in proportion to what it retires and the logarithm of what is open. ``herald`` tells when a source's
    last correction comes: claims of a multi-value slot that no correction can reach any more are closed at once.
    """

    def __init__(self) -> None:
        self.arrivals = 0
        self.closed: list[dict] = []
        self.fresh, self.held = Overlaps(), Overlaps()
        self.sources: dict[str, dict[int, dict]] = {}
        self.placed: dict[str, Overlaps] = {}
        self.loose: dict[int, dict] = {}
        self.last: dict[str, datetime] | None = None

    @property
    def open(self) -> list[dict]:
        """In order of arrival."""
        every = {n: c for own in (self.loose, *self.sources.values()) for n, c in own.items()}
        return [every[n] for n in sorted(every)]

    def herald(self, source: str | None, until: datetime | None) -> None:
        self.last = {} if self.last is None else self.last
        if source is not None:
            self.last[source] = until

    def restore(self, claims: list[dict]) -> None:
        for c in claims:
            self._stand(c)

    def _stand(self, c: dict) -> None:
        """Keep a claim that stands from now on."""
        self.arrivals += 1
        c["n"], lo, hi = self.arrivals, c["valid_from"] or datetime.min, c["valid_to"] or datetime.max
        if c["policy"] == "multi_value" and self.last is not None and not (c["source"] in self.last and self.last[c["source"]] >= c["recorded_at"]):
            self.closed.append(c)
            return
        (self.loose if c["source"] is None else self.sources.setdefault(c["source"], {}))[c["n"]] = c
        if lo < hi and c["policy"] != "multi_value":
            (self.held if c["conflict_set"] else self.fresh).add(lo, hi, c["n"], c)
            if c["source"] is not None and (c["sequence"] or c["commit_time"]):
                self.placed.setdefault(c["source"], Overlaps()).add(lo, hi, c["n"], c)

    def _leave(self, c: dict) -> None:
        lo = c["valid_from"] or datetime.min
        (self.loose if c["source"] is None else self.sources[c["source"]]).pop(c["n"])
        (self.held if c["conflict_set"] else self.fresh).remove(lo, c["n"])
        if c["source"] in self.placed:
            self.placed[c["source"]].remove(lo, c["n"])

    def _supersede(self, others: list[dict], by: dict) -> None:
        for o in others:
            self._leave(o)
            o.update(status="superseded", superseded_at=by["recorded_at"], superseded_by=by["id"])
            self.closed.append(o)

    def arrive(self, c: dict) -> None:
        c.update(superseded_at=None, superseded_by=None, conflict_set=None)
        if c["status"] == "quarantined":
            self.closed.append(c)
            return
        c["status"] = "active"
        stale = lambda others: min((o for o in others if order(c, o) == -1), key=lambda o: o["n"], default=None)
        if c["operation"] == "correction" or c.get("replaces"):
            # what the same request states beside it isn't what it corrects
            own = [o for o in self.sources.get(c["source"], {}).values() if c.get("request") is None or o.get("request") != c["request"]]
            if (late := stale(own)) is not None:
                return self._late(c, late)
            self._supersede(own, c)
        lo, hi, value = c["valid_from"] or datetime.min, c["valid_to"] or datetime.max, c["object_key"]
        if c["policy"] == "multi_value" or lo >= hi:
            return self._stand(c)
        if c["source"] in self.placed:
            own = list(self.placed[c["source"]].rivals(lo, hi, value))
            if (late := stale(own)) is not None:
                return self._late(c, late)
            self._supersede([o for o in own if order(c, o) == 1], c)
        if c["policy"] == "latest_wins" or c["policy"] == "highest_authority" and not any(next(t.rivals(lo, hi, value, power(c)), None) for t in (self.fresh, self.held)):
            self._supersede([*self.fresh.rivals(lo, hi, value), *self.held.rivals(lo, hi, value)], c)
            return self._stand(c)
        joined = list(self.fresh.rivals(lo, hi, value))
        named = self.held.first(lo, hi, value)
        if joined or named:
            name = named["conflict_set"] if named else "conflict:" + min(m["id"] for m in [*joined, c])
            for m in joined:
                start = m["valid_from"] or datetime.min
                self.fresh.remove(start, m["n"])
                m.update(status="disputed", conflict_set=name)
                self.held.add(start, m["valid_to"] or datetime.max, m["n"], m)
            c.update(status="disputed", conflict_set=name)
        self._stand(c)

    def _late(self, c: dict, by: dict) -> None:
        c.update(status="superseded", superseded_at=c["recorded_at"], superseded_by=by["id"])
        self.closed.append(c)


def arrivals(claims: DataFrame) -> DataFrame:
    """The columns of ``FIELDS``, and those of ``OPTIONAL``, null where not given."""
    own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(FIELDS)]
    more = [(F.col(f.name) if f.name in claims.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(OPTIONAL)]
    return claims.select(*own, *more)


def reconcile(claims: DataFrame) -> DataFrame:
    """Each claim's standing after all arrivals. Input columns: ``FIELDS``, and ``OPTIONAL`` where given; ``slot`` names the
    slot as one string.

    Repeated rows of a claim arrive once. Nulls: a claim without slot is left out; a null policy is a conflict policy; a null
    sequence orders nothing; a null request is never the same one as another.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = arrivals(claims).filter("slot is not null").distinct()
    names, out_schema = rows.columns, to_arrow_schema(StructType.fromDDL(RESULT))
    # ahead of each slot's claims: when each source's last correction comes
    corrects = (F.col("operation") == "correction") | F.coalesce("replaces", F.lit(False))
    heralds = rows.filter(corrects & F.col("source").isNotNull()).groupBy("slot", "source").agg(F.max("recorded_at").alias("recorded_at"))
    rows = rows.withColumn("claim", F.lit(True)).unionByName(heralds.withColumn("claim", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition("slot").sortWithinPartitions("slot", "claim", "recorded_at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, slot = None, Slot()
        done: list[dict] = []

        def emit() -> pa.RecordBatch:
            made = [pa.array([c[f.name] for c in done], f.type) for f in out_schema]
            done.clear()
            return pa.RecordBatch.from_arrays(made, schema=out_schema)

        for b in batches:
            for c in b.to_pylist():
                if c["slot"] != at:
                    done += slot.closed + slot.open
                    at, slot = c["slot"], Slot()
                    slot.herald(None, None)
                if not c["claim"]:
                    slot.herald(c["source"], c["recorded_at"])
                    continue
                slot.arrive({k: c[k] for k in names})
                if len(slot.closed) > 10_000:
                    done += slot.closed
                    slot.closed = []
            if len(done) > 10_000:
                yield emit()
        done += slot.closed + slot.open
        yield emit()

    return rows.mapInArrow(run, RESULT)


def retract(claims: DataFrame, ids: DataFrame, at: str, reason: str) -> DataFrame:
    """Claims named by ``ids`` (assertion_id) get retracted, once; retracted and superseded ones stay as they are."""
    named = ids.select("assertion_id").distinct().withColumn("named", F.lit(True))
    hit = F.coalesce("named", F.lit(False)) & F.col("retracted_at").isNull() & (F.col("status") != "superseded")
    out = claims.join(named, "assertion_id", "left").withColumn("hit", hit)
    return (
        out.withColumn("status", F.when(F.col("hit"), "retracted").otherwise(F.col("status")))
        .withColumn("retracted_at", F.when(F.col("hit"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("retracted_at")))
        .withColumn("retraction_reason", F.when(F.col("hit"), reason))
        .drop("named", "hit")
    )


def conflict_members(claims: DataFrame, slot: list[str]) -> DataFrame:
    """Believable claims that share an instant with another claim of their slot that has a different value.

    ``conflict_set`` is named after the slot's least such claim. No pairs are made: sorted by start, a claim conflicts with
    an earlier one if the furthest end so far among other values reaches it, for which the two furthest ends of different
    values are enough; and with a later one if the next start of another value lies before its end.
    """
    rows = claims.filter(F.col("status").isin(*OPEN) & F.coalesce(F.col("valid_to") > F.col("valid_from"), F.lit(True)))
    lo, hi = F.coalesce("valid_from", F.expr(LEAST)), F.coalesce("valid_to", F.expr(MOST))
    rows = rows.dropna(subset=slot).select(*slot, "assertion_id", "object_key", lo.alias("lo"), hi.alias("hi")).distinct()
    by = Window.partitionBy(*slot).orderBy("lo", "object_key", "assertion_id")
    rows = rows.withColumn("turn", F.coalesce((F.lag("object_key").over(by) != F.col("object_key")).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("turn").over(by))
    rows = rows.withColumn("next_lo", F.min("lo").over(Window.partitionBy(*slot).orderBy("run").rangeBetween(1, 1))).drop("turn", "run")
    n = len(slot)
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, second = None, None, None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(n))))
            reached = []
            for key, value, start, end in zip(keys, b.column(n + 1).to_pylist(), b.column(n + 2).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), b.column(n + 3).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()):
                if key != at:
                    at, best, second = key, None, None
                rival = second if best and best[1] == value else best
                reached.append(rival is not None and rival[0] > start)
                if best is None or best[1] == value:
                    best = (max(end, best[0]) if best else end, value)
                elif end > best[0]:
                    best, second = (end, value), best
                elif second is None or second[1] == value or end > second[0]:
                    second = (max(end, second[0]), value) if second else (end, value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reached, pa.bool_())], [*b.schema.names, "reached"])

    found = rows.repartition(*slot).sortWithinPartitions(*slot, "lo", "object_key", "assertion_id").mapInArrow(run, StructType([*kind.fields, StructField("reached", BooleanType())]))
    found = found.filter(F.col("reached") | (F.col("next_lo") < F.col("hi")))
    sets = found.groupBy(*slot).agg(F.min("assertion_id").alias("conflict_set"))
    return found.join(sets, slot).select(*slot, "assertion_id", "conflict_set")

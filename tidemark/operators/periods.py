"""Continuous periods and gaps of the time intervals of each slot.

A slot is any tuple of key columns. The mergeable aggregate is a list of sorted disjoint intervals. Leaves of the reduction
tree are partial lists: each task folds what it scans to one list per slot, before anything is shuffled. Partial lists of a
slot then meet, two of like size at a time, by a linear merge; periods and gaps are read off the list at the root.

A slot whose partial lists hold more than ``limit`` intervals is cut by time into stretches of about that many: the lists are
cut there, each stretch has a tree of its own, and the roots' outermost periods are joined where they touch. So no task holds
more than a stretch, whatever share of the rows a slot has; what is gathered per slot grows with the number of its stretches.

Defined cases: intervals are half-open, a null start or end is unbounded; one whose end isn't after its start covers
nothing; touching intervals are continuous; a gap has covered time on both sides, so an unbounded side has none; slots
with a null key name nothing; repeated rows have no effect; a slot without any interval has neither periods nor gaps;
empty tables give empty results; slots' keys come out as strings. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import Scratch

#: The most named slots that are broadcast (some 60 MB); beyond that lists are joined with them by a shuffle.
FEW = 500_000
#: Intervals in a stretch of a slot (16 MB), and rows that a task folds at once.
LIMIT, LEAF = 1_000_000, 1_000_000
#: Stand for the unbounded sides.
LEAST, MOST = "timestamp_ntz'0001-01-01 00:00:00'", "timestamp_ntz'9999-12-31 23:59:59.999999'"
_TIMES = pa.list_(pa.timestamp("us"))


def _swept(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by start in, disjoint out."""
    reach = np.maximum.accumulate(hi)
    begins = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return lo[begins], reach[np.append(begins[1:], len(lo)) - 1]


class IntervalList:
    """Sorted disjoint half-open intervals."""

    __slots__ = ("lo", "hi")

    def __init__(self, pairs: Sequence[tuple[int, int]] = ()) -> None:
        some = sorted((a, b) for a, b in pairs if b > a)
        self.lo, self.hi = (np.array([p[i] for p in some], np.int64) for i in (0, 1))
        if some:
            self.lo, self.hi = _swept(self.lo, self.hi)

    @classmethod
    def of(cls, lo: np.ndarray, hi: np.ndarray) -> "IntervalList":
        """From a list's own starts and ends."""
        out = cls.__new__(cls)
        out.lo, out.hi = lo, hi
        return out

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.lo.tolist(), self.hi.tolist()))

    def __len__(self) -> int:
        return len(self.lo)

    def merge(self, other: "IntervalList") -> "IntervalList":
        """One list of both, in linear time: every interval's place among the other list's is found, then one sweep joins."""
        if not len(self) or not len(other):
            return self if len(self) else other
        at = np.searchsorted(self.lo, other.lo) + np.arange(len(other)) if len(other) < len(self) // 16 else None
        if at is None:
            starts = np.concatenate([self.lo, other.lo])
            place = np.argsort(starts, kind="stable")  # of two sorted runs: one merge
            return IntervalList.of(*_swept(starts[place], np.concatenate([self.hi, other.hi])[place]))
        mine = np.ones(len(self) + len(other), bool)
        mine[at] = False
        lo, hi = (np.empty(len(mine), np.int64) for _ in range(2))
        lo[mine], lo[at], hi[mine], hi[at] = self.lo, other.lo, self.hi, other.hi
        return IntervalList.of(*_swept(lo, hi))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.hi[:-1].tolist(), self.lo[1:].tolist()))

    def between(self, low: int, high: int) -> "IntervalList":
        """What of the list lies in [low, high)."""
        a, b = np.searchsorted(self.hi, low, "right"), np.searchsorted(self.lo, high, "left")
        return IntervalList.of(np.maximum(self.lo[a:b], low), np.minimum(self.hi[a:b], high))


class Tree:
    """Merges lists as they come: two of like size become one of the next level."""

    def __init__(self) -> None:
        self.levels: list[IntervalList] = []

    def add(self, new: IntervalList) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = self.levels.pop().merge(new)
        self.levels.append(new)

    def root(self) -> IntervalList:
        out = IntervalList()
        while self.levels:
            out = self.levels.pop().merge(out)
        return out


def slot_intervals(df: DataFrame, keys: dict[str, str], start: str, end: str) -> DataFrame:
    """Non-empty intervals as the slot's columns (strings), ``lo``, ``hi``."""
    lo, hi = F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz")
    rows = df.select(*(F.col(c).cast("string").alias(k) for k, c in keys.items()), F.coalesce(lo, F.expr(LEAST)).alias("lo"), F.coalesce(hi, F.expr(MOST)).alias("hi"))
    return rows.filter(F.col("hi") > F.col("lo")).dropna(subset=list(keys))


def of_slots(intervals: DataFrame, slots: DataFrame, keys: Sequence[str], few: int = FEW) -> DataFrame:
    """What is known of the named slots: their intervals, or their partial lists where the slots are too many to broadcast.

    Lists are one row per slot and task, so that a slot with a third of all intervals is a few rows in the join.
    """
    named = slots.select(*(F.col(k).cast("string").alias(k) for k in keys)).dropna().distinct()
    if named.limit(few + 1).count() <= few:
        return intervals.join(F.broadcast(named), list(keys), "left_semi")
    return partial_lists(intervals, keys).join(named, list(keys), "left_semi")


def _micros(x: pa.Array) -> np.ndarray:
    return x.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _times(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of times; ``ends`` are the lists' ends among them."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64()).cast(pa.timestamp("us")))


def partial_lists(intervals: DataFrame, keys: Sequence[str], leaf: int = LEAF) -> DataFrame:
    """The leaves: per task and slot one list (arrays ``los``, ``his``); tasks with more than ``leaf`` rows give several."""
    keys = list(keys)
    rows = intervals.select(*(F.col(k).cast("string").alias(k) for k in keys), "lo", "hi")

    def fold(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        t = t.sort_by([(k, "ascending") for k in keys] + [("lo", "ascending")]).combine_chunks()
        own = [t.column(k).combine_chunks() for k in keys]
        lo, hi = _micros(t.column("lo").combine_chunks()), _micros(t.column("hi").combine_chunks())
        n = len(lo)
        new = np.zeros(n, bool)
        new[:1] = True
        for c in own:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        # the furthest end so far within each slot: ranks of the ends, raised by the slot's number
        slot = np.cumsum(new)
        order = np.argsort(hi, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        reach = hi[order[np.maximum.accumulate(slot * n + rank) % n]]
        begins = np.flatnonzero(new | np.concatenate([[True], lo[1:] > reach[:-1]]))
        ends = reach[np.append(begins[1:], n) - 1]
        firsts = np.flatnonzero(new)
        until = np.append(np.searchsorted(begins, firsts[1:]), len(begins))
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(firsts)) for c in own), _times(lo[begins], until), _times(ends, until)], [*keys, "los", "his"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= leaf:
                yield fold(held)
                held, size = [], 0
        if size:
            yield fold(held)

    return rows.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", los array<timestamp_ntz>, his array<timestamp_ntz>")


def _lists(b: pa.RecordBatch, at: int) -> Iterator[IntervalList]:
    los, his = b.column(at), b.column(at + 1)
    ends, lo, hi = los.offsets.to_numpy(), _micros(los.values), _micros(his.values)
    base = his.offsets.to_numpy()
    for i in range(b.num_rows):
        yield IntervalList.of(lo[ends[i] : ends[i + 1]], hi[base[i] : base[i + 1]])


def _stretches(lists: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """The cuts (array ``cuts``) of each slot with more than ``limit`` intervals in all; None where no slot is.

    Every list gives the start of each of its ``limit / 1000`` th intervals; a slot's cuts are every thousandth of these.
    """
    hot = lists.groupBy(*keys).agg(F.sum(F.size("los")).alias("n")).filter(F.col("n") > limit)
    if hot.isEmpty():
        return None
    step = max(1, limit // 1000)
    marks = lists.join(hot.select(*keys), keys, "left_semi").select(*keys, F.explode(F.filter("los", lambda x, i: i % step == step - 1)).alias("mark"))
    w = Window.partitionBy(*keys).orderBy("mark")
    cuts = marks.withColumn("r", F.row_number().over(w)).filter(F.col("r") % max(1, limit // step) == 0)
    return cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("mark")).alias("cuts"))


def _cut(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Lists with ``cuts`` cut there: a row per stretch that a list has a part in."""
    n = len(keys)
    schema = ", ".join(f"{k} string" for k in keys) + ", piece int, los array<timestamp_ntz>, his array<timestamp_ntz>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, pieces, los, his, size = [], [], [], [], []
            points = b.column(n + 2)
            for i, own in enumerate(_lists(b, n)):
                cuts = _micros(points[i].values) if points[i].is_valid else np.empty(0, np.int64)
                bounds = [-(2**62), *cuts.tolist(), 2**62]
                first, last = (int(np.searchsorted(cuts, x, "right")) for x in (own.lo[0], own.hi[-1] - 1))
                for p in range(first, last + 1):
                    part = own.between(bounds[p], bounds[p + 1])
                    if len(part):
                        of.append(i)
                        pieces.append(p)
                        los.append(part.lo)
                        his.append(part.hi)
                        size.append(len(part))
            if of:
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of)) for k in range(n)), pa.array(pieces, pa.int32()), _times(np.concatenate(los), ends), _times(np.concatenate(his), ends)], [*keys, "piece", "los", "his"])

    return lists.select(*keys, "los", "his", "cuts").mapInArrow(run, schema)


def merged_lists(intervals: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> tuple[DataFrame, bool]:
    """The roots: one list per slot and stretch (``piece``), and whether any slot has several stretches."""
    keys, n = list(keys), len(keys)
    leaves = intervals if "los" in intervals.columns else partial_lists(intervals, keys)
    leaves = Scratch(intervals.sparkSession).write(leaves)
    cuts = _stretches(leaves, keys, limit)
    if cuts is None:
        parts = leaves.select(*keys, F.lit(0).alias("piece"), "los", "his")
    else:
        parts = _cut(leaves.join(cuts, keys, "left"), keys)
    parts = parts.repartition(*keys, "piece").sortWithinPartitions(*keys, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, Tree()
        done: list[tuple[tuple, IntervalList]] = []

        def emit() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for _, x in done])
            own = [pa.array([k[i] for k, _ in done], pa.string()) for i in range(n)]
            out = [*own, pa.array([k[n] for k, _ in done], pa.int32()), *(_times(np.concatenate([getattr(x, side) for _, x in done]), ends) for side in ("lo", "hi"))]
            done.clear()
            return pa.RecordBatch.from_arrays(out, [*keys, "piece", "los", "his"])

        size = 0
        for b in batches:
            for *key, own in zip(*(b.column(i).to_pylist() for i in range(n + 1)), _lists(b, n + 1)):
                if key != at:
                    if at is not None:
                        done.append((tuple(at), tree.root()))
                        size += len(done[-1][1])
                        if size > LEAF or len(done) > 10_000:
                            yield emit()
                            size = 0
                    at, tree = key, Tree()
                tree.add(own)
        if at is not None:
            done.append((tuple(at), tree.root()))
        if done:
            yield emit()

    return parts.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", piece int, los array<timestamp_ntz>, his array<timestamp_ntz>"), cuts is not None


def _borders(lists: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the last period of each stretch, with the end before it (``before``) where that is another stretch's."""
    first = lists.select(*keys, "piece", F.col("los")[0].alias("lo"), F.col("his")[0].alias("hi"))
    last = lists.filter(F.size("los") > 1).select(*keys, "piece", F.element_at("los", -1).alias("lo"), F.element_at("his", -1).alias("hi"))
    w = Window.partitionBy(*keys).orderBy("lo")
    return first.unionByName(last).withColumn("before", F.when(F.lag("piece").over(w) != F.col("piece"), F.lag("hi").over(w))).withColumn("turn", F.coalesce((F.lag("hi").over(w) < F.col("lo")).cast("int"), F.lit(1)))


def gaps(intervals: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """Each longest stretch that no interval of the slot covers, with covered time on both sides: ``gap_from``, ``gap_to``.

    intervals: as of ``slot_intervals``, or partial lists.
    """
    keys = list(keys)
    lists, cut = merged_lists(intervals, keys, limit)
    if cut:
        lists = Scratch(intervals.sparkSession).write(lists)
    n = F.size("los")
    inner = F.arrays_zip(F.slice("his", F.lit(1), n - 1).alias("from"), F.slice("los", F.lit(2), n - 1).alias("to"))
    found = lists.filter(n > 1).select(*keys, F.explode(inner).alias("_x")).select(*keys, F.col("_x.from").alias("gap_from"), F.col("_x.to").alias("gap_to"))
    if cut:
        found = found.unionByName(_borders(lists, keys).filter("before < lo").select(*keys, F.col("before").alias("gap_from"), F.col("lo").alias("gap_to")))
    return found


def periods(intervals: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """The continuous periods of each slot: ``period_from``, ``period_to``, null where unbounded."""
    keys = list(keys)
    lists, cut = merged_lists(intervals, keys, limit)
    every = F.arrays_zip(F.col("los").alias("from"), F.col("his").alias("to"))
    if cut:
        lists = Scratch(intervals.sparkSession).write(lists)
        every = F.slice(every, F.lit(2), F.greatest(F.size("los") - 2, F.lit(0)))
    found = lists.select(*keys, F.explode(every).alias("_x")).select(*keys, F.col("_x.from").alias("lo"), F.col("_x.to").alias("hi"))
    if cut:
        w = Window.partitionBy(*keys).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
        joined = _borders(lists, keys).withColumn("run", F.sum("turn").over(w)).groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        found = found.unionByName(joined.select(*keys, "lo", "hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return found.select(*keys, F.when(lo != F.expr(LEAST), lo).alias("period_from"), F.when(hi != F.expr(MOST), hi).alias("period_to"))

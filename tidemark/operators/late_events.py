"""Per-period counts by event time under late and out-of-order arrival.

An event is one (group, key); its rows are merged before anything else: the earliest arrival, the event time its rows
give. The merge hashes by (group, key), so a group that holds a third of all rows is spread over all tasks; each task then
replays its events in order of arrival, with one finger B-tree per group. Before an event is inserted, every period whose
cut-off lies before its arrival is read off the tree, emitted and evicted; an event that the tree then refuses, as its key lies
in the evicted part, is late. Whether an event is late depends on its own arrival only, so tasks needn't see each other, and
their partial counts, and the changes of counts, just add up.

Defined cases: an event without event time belongs to no period and is left out; one without any arrival time never
arrived and is left out; null groups and keys are values like others (null equals null); where rows of an event disagree
about its event time the latest counts; repeated rows count once; an empty table gives an empty result; groups and keys
come out as strings. Other columns, whatever their names, are ignored. The arrival may equal the cut-off exactly: that is in
time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.finger_tree import FingerTree

DAY = 86_400_000_000
HOUR = 3_600_000_000


def merged_events(df: DataFrame, group: str, key: str, event_time: str, arrival: Column) -> DataFrame:
    """One row per (group, key): ``g``, ``k``, earliest ``arrived``, ``happened``."""
    return (
        df.select(F.col(group).alias("g"), F.col(key).alias("k"), arrival.alias("a"), F.col(event_time).alias("e"))
        .groupBy("g", "k")
        .agg(F.min("a").alias("arrived"), F.max("e").alias("happened"))
        .filter("arrived is not null and happened is not null")
    )


def _micros(x: pa.Array) -> np.ndarray:
    return x.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)


class Replay:
    """The trees of one shard, one per group.

    ``feed`` gives back the rows that a tree refused, as their period was evicted. Evicted periods go to ``closed`` with their
    totals. With ``publishes``, the change of each period's total since it was last published goes to ``changes`` whenever
    arrivals pass the end of a period: (group, period, when, change).
    """

    def __init__(self, lateness: int, period: int, slot: int, publishes: bool = False) -> None:
        self.lateness, self.period, self.slot, self.publishes = lateness, period, slot, publishes
        self.per = period // slot
        self.trees: dict[object, list] = {}
        self.closed: list[tuple[object, int, int]] = []
        self.changes: list[tuple[object, int, int, int]] = []
        self.touched: dict[object, set[int]] = {}
        self.known: dict[tuple[object, int], int] = {}
        self.tick: int | None = None

    def horizon(self, arrived: np.ndarray) -> np.ndarray:
        """The first period still open at an arrival: its end plus the lateness isn't before the arrival."""
        return -((self.lateness - arrived) // self.period) - 1

    def total(self, tree: FingerTree, p: int) -> int:
        return tree.range_total(p * self.per, (p + 1) * self.per)

    def close(self, group: object, tree: FingerTree, before: int | None) -> None:
        """Emit and evict the periods below ``before``, or all."""
        while (first := tree.first()) is not None and (before is None or first < before * self.per):
            p = first // self.per
            self.closed.append((group, p, self.total(tree, p)))
            self.known.pop((group, p), None)
            tree.evict((p + 1) * self.per)
        if before is not None:
            tree.evict(before * self.per)

    def publish(self) -> None:
        """What changed since the last time; a period isn't published before its end, nor after its cut-off."""
        for g, periods in self.touched.items():
            for p in periods:
                n, end = self.total(self.trees[g][0], p), (p + 1) * self.period
                self.changes.append((g, p, min(max(end, self.tick), end + self.lateness), n - self.known.get((g, p), 0)))
                self.known[g, p] = n
        self.touched = {}

    def feed(self, groups: list, arrived: np.ndarray, happened: np.ndarray) -> list[int]:
        late = []
        slots, opens = (happened // self.slot).tolist(), self.horizon(arrived).tolist()
        ticks = (-(-arrived // self.period) * self.period).tolist() if self.publishes else None
        for i, (g, s, h) in enumerate(zip(groups, slots, opens)):
            if ticks and ticks[i] != self.tick:
                self.publish()
                self.tick = ticks[i]
            if not self.take(g, s, h, 1):
                late.append(i)
            elif ticks:
                self.touched.setdefault(g, set()).add(s // self.per)
        return late

    def take(self, group: object, slot: int, opens: int, n: int) -> bool:
        """n events of a slot whose arrival leaves the periods from ``opens`` on open; whether they came in time."""
        own = self.trees.get(group)
        if own is None:
            own = self.trees[group] = [FingerTree(), opens]
            own[0].evict(opens * self.per)
        elif opens > own[1]:
            own[1] = opens
            self.close(group, own[0], opens)
        return own[0].admit(slot, n)

    def finish(self) -> None:
        self.publish()
        for g, (tree, _) in self.trees.items():
            self.close(g, tree, None)


#: What a replay gives: rows that came too late, counts of periods, or changes of counts.
LATE, COUNTS, CHANGES = "g string, k string", "g string, p long, n long", "g string, p long, at long, n long"


def _replayed(events: DataFrame, lateness: int, period: int, slot: int, gives: str) -> DataFrame:
    if period % slot:
        raise ValueError("a period must hold whole slots")
    names = [x.split()[0] for x in gives.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        g, *numbers = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Replay(lateness, period, slot, gives == CHANGES)
        rows = {LATE: [], COUNTS: state.closed, CHANGES: state.changes}[gives]
        for b in batches:
            late = state.feed(b.column(0).to_pylist(), _micros(b.column(2)), _micros(b.column(3)))
            if gives != COUNTS:
                state.closed.clear()
            if gives == LATE:
                yield b.select([0, 1]).take(pa.array(late, pa.int64()))
            elif len(rows) > 10_000:
                yield batch(rows)
                rows.clear()
        if gives != LATE:
            state.finish()
            yield batch(rows)

    ordered = events.select(F.col("g").cast("string").alias("g"), F.col("k").cast("string").alias("k"), F.col("arrived").cast("timestamp_ntz").alias("a"), F.col("happened").cast("timestamp_ntz").alias("h"))
    return ordered.sortWithinPartitions("a").mapInArrow(run, gives)


def late_events(df: DataFrame, group: str, key: str, event_time: str, arrival: Column, lateness: int = 48 * HOUR, period: int = DAY, slot: int = 60_000_000) -> DataFrame:
    """The events (columns group and key) that arrive after the cut-off of the period of their event time.

    ``lateness``, ``period`` and ``slot`` (the grain of the tree's keys) are in microseconds.
    """
    found = _replayed(merged_events(df, group, key, event_time, arrival), lateness, period, slot, LATE)
    return found.select(F.col("g").alias(group), F.col("k").alias(key))


def period_counts(df: DataFrame, group: str, key: str, event_time: str, arrival: Column, lateness: int = 48 * HOUR, period: int = DAY, slot: int = 60_000_000) -> DataFrame:
    """Per group and period (``period_start``): the events that arrived up to the cut-off (``events``), each once."""
    parts = _replayed(merged_events(df, group, key, event_time, arrival), lateness, period, slot, COUNTS)
    return parts.groupBy("g", "p").agg(F.sum("n").cast("long").alias("events")).select(F.col("g").alias(group), _time(f"p * {period}").alias("period_start"), "events")


def _time(micros: str) -> Column:
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({micros} as decimal(24, 0)) / 1000000)")


def corrections(df: DataFrame, group: str, key: str, event_time: str, arrival: Column, lateness: int = 48 * HOUR, period: int = DAY, slot: int = 60_000_000) -> DataFrame:
    """Each period's count as it was published and corrected: ``period_start``, ``published_at``, ``old_events``, ``new_events``.

    Counts are published at the end of their period and at each later period's end up to the cut-off, where they changed; a
    publication holds what arrived up to and with its time. The last one is the period's count. The first has an old count of 0.
    """
    parts = _replayed(merged_events(df, group, key, event_time, arrival), lateness, period, slot, CHANGES)
    sums = parts.groupBy("g", "p", "at").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")
    # at most lateness / period + 2 rows each
    w = Window.partitionBy("g", "p").orderBy("at")
    new = F.sum("n").over(w)
    rows = sums.select("g", "p", "at", (new - F.col("n")).alias("old_events"), new.alias("new_events"))
    return rows.select(F.col("g").alias(group), _time(f"p * {period}").alias("period_start"), _time("at").alias("published_at"), "old_events", "new_events")

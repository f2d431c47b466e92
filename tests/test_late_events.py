import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.finger_tree import FingerTree
from tidemark.operators.late_events import DAY, HOUR, Replay, corrections, late_events, period_counts
from tidemark.streaming.late import stream_counts

ops = st.lists(st.one_of(st.tuples(st.just("add"), st.integers(0, 400)), st.tuples(st.just("evict"), st.integers(0, 420))), max_size=250)


@settings(max_examples=150, deadline=None)
@given(ops, st.integers(0, 400), st.integers(0, 400))
def test_tree_against_dictionary(steps, a, b):
    tree, plain = FingerTree(), {}
    for op, k in steps:
        if op == "add":
            tree.add(k, 1)
            plain[k] = plain.get(k, 0) + 1
        else:
            tree.evict(k)
            plain = {x: n for x, n in plain.items() if x >= k}
    assert list(tree.items()) == sorted(plain.items())
    assert tree.first() == min(plain, default=None)
    lo, hi = min(a, b), max(a, b)
    assert tree.range_total(lo, hi) == sum(n for x, n in plain.items() if lo <= x < hi)
    assert tree.range_total(-1, 1000) == sum(plain.values())


def test_tree_with_many_late_inserts():
    rng, tree, plain = random.Random(4), FingerTree(), {}
    for i in range(20_000):
        k = max(0, i - int(rng.expovariate(1 / 300)))
        tree.add(k, 1)
        plain[k] = plain.get(k, 0) + 1
        if i % 3000 == 2999:
            tree.evict(i - 2000)
            plain = {x: n for x, n in plain.items() if x >= i - 2000}
            assert tree.range_total(i - 1500, i - 700) == sum(n for x, n in plain.items() if i - 1500 <= x < i - 700)
    assert list(tree.items()) == sorted(plain.items())


def test_horizon_is_exclusive_at_the_cutoff():
    r = Replay(48 * HOUR, DAY, 60_000_000)
    end = 10 * DAY + 48 * HOUR
    assert r.horizon(np.array([end - 1, end, end + 1])).tolist() == [9, 9, 10]


T = datetime(2025, 3, 1)
SCHEMA = "src string, k string, happened timestamp_ntz, committed timestamp_ntz, recorded timestamp_ntz, g string, arrived int"


def rows():
    h = lambda n: T + timedelta(hours=n)
    return [
        ("a", "1", h(5), h(6), h(7), "x", 1),
        ("a", "2", h(5), h(72), h(72), "x", 1),  # exactly at the cut-off: in time
        ("a", "3", h(5), h(72) + timedelta(microseconds=1), None, "x", 1),  # late
        ("a", "4", h(5), None, h(200), "x", 1),  # late by recorded_at
        ("a", "4", h(5), h(10), h(300), "x", 1),  # another delivery arrived in time
        ("a", "5", None, h(1), h(1), "x", 1),  # no period
        ("a", "6", h(5), None, None, "x", 1),  # never arrived
        ("a", "7", None, h(100), h(100), None, None),
        ("a", "7", h(1), h(100), h(100), None, None),  # its other row gives the time: late
        (None, None, h(5), h(500), h(500), "x", 1),
        ("b", "1", h(900), h(5), h(5), "x", 1),  # clock ahead
        ("b", "1", h(900), h(5), h(5), "x", 1),
    ]


def test_late_events_and_counts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    at = F.coalesce("committed", "recorded")
    got = sorted(late_events(df, "src", "k", "happened", at).collect(), key=str)
    assert [tuple(r) for r in got] == [("a", "3"), ("a", "7"), (None, None)]
    counts = {(r.src, r.period_start): r.events for r in period_counts(df, "src", "k", "happened", at).collect()}
    assert counts == {("a", T): 3, ("b", T + timedelta(days=37)): 1}
    empty = df.limit(0)
    assert late_events(empty, "src", "k", "happened", at).count() == 0
    assert period_counts(empty, "src", "k", "happened", at).count() == 0


def test_a_tree_refuses_what_it_evicted():
    tree = FingerTree()
    assert tree.admit(5, 1)
    tree.evict(6)
    assert tree.empty and not tree.admit(5, 1) and tree.admit(6, 1)
    tree.evict(3)
    assert not tree.admit(4, 1) and list(tree.items()) == [(6, 1)]


def test_corrections(spark):
    h = lambda n: T + timedelta(hours=n)
    events = [
        ("a", "1", h(5), h(6)), ("a", "2", h(5), h(24)),  # by the end of the day
        ("a", "3", h(6), h(24) + timedelta(microseconds=1)), ("a", "4", h(7), h(48)), ("a", "5", h(8), h(60)), ("a", "6", h(8), h(73)),  # corrections; the last is late
        ("a", "7", h(30), h(6)), ("b", "1", h(30), h(31)), ("b", "2", h(30), h(100)),
    ]
    df = spark.createDataFrame(events, "src string, k string, happened timestamp_ntz, arrived timestamp_ntz").repartition(3)
    got = sorted(tuple(r) for r in corrections(df, "src", "k", "happened", F.col("arrived")).collect())
    d = lambda n: T + timedelta(days=n)
    assert got == [("a", d(0), d(1), 0, 2), ("a", d(0), d(2), 2, 4), ("a", d(0), d(3), 4, 5), ("a", d(1), d(2), 0, 1), ("b", d(1), d(2), 0, 1)]
    last = {(r[0], r[1]): r[4] for r in got}
    assert last == {(r.src, r.period_start): r.events for r in period_counts(df, "src", "k", "happened", F.col("arrived")).collect()}
    assert corrections(df.limit(0), "src", "k", "happened", F.col("arrived")).count() == 0


def test_stream_counts(spark, tmp_path):
    data = [("a", T + timedelta(hours=i), T + timedelta(hours=i, minutes=5)) for i in range(0, 200, 5)] + [("a", T + timedelta(hours=3), T + timedelta(hours=190))]
    folder = str(tmp_path / "in")
    spark.createDataFrame(data, "g string, happened timestamp_ntz, arrived timestamp_ntz").coalesce(1).write.parquet(folder)
    stream = stream_counts(spark.readStream.schema("g string, happened timestamp_ntz, arrived timestamp_ntz").parquet(folder), "g", "happened", "arrived", salts=1)
    q = stream.writeStream.format("memory").queryName("late_counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.period: (r.e, r.l) for r in spark.table("late_counts").groupBy("period").agg(F.sum("events").alias("e"), F.sum("late").alias("l")).collect()}
    first = (T - datetime(1970, 1, 1)).days
    assert got[first] == (5, 1) and got[first + 1] == (5, 0)


def test_idle_groups_close_by_the_clock(spark, tmp_path):
    data = [("a", T + timedelta(hours=1), T + timedelta(hours=2)), ("b", T, T)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(data, "g string, happened timestamp_ntz, arrived timestamp_ntz").coalesce(1).write.parquet(folder)
    stream = stream_counts(spark.readStream.schema("g string, happened timestamp_ntz, arrived timestamp_ntz").parquet(folder), "g", "happened", "arrived", idle="1 second")
    q = stream.writeStream.format("memory").queryName("idle_counts").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            got = sorted((r.grp, r.events) for r in spark.table("idle_counts").collect())
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert got == [("a", 1), ("b", 1)]

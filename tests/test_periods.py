import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.periods import IntervalList, Tree, gaps, of_slots, periods, slot_intervals

T = datetime(2020, 1, 1)
SCHEMA = "s string, p string, a timestamp_ntz, b timestamp_ntz, lo string"
pairs = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=25)


def brute(spans):
    cover = sorted((a, b) for a, b in spans if b > a)
    out = []
    for a, b in cover:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(pairs, pairs)
def test_lists_merge(x, y):
    both = IntervalList(x).merge(IntervalList(y))
    assert both.pairs == brute(x + y) == IntervalList(y).merge(IntervalList(x)).pairs
    assert both.gaps() == [(a[1], b[0]) for a, b in zip(both.pairs, both.pairs[1:])]


def day(n):
    return None if n is None else T + timedelta(days=n)


def run(spark, rows, named=None):
    df = spark.createDataFrame([(s, p, day(a), day(b), "x") for s, p, a, b in rows], SCHEMA)
    iv = slot_intervals(df, {"s": "s", "p": "p"}, "a", "b")
    if named is not None:
        iv = of_slots(iv, spark.createDataFrame(named, "s string, p string"), ["s", "p"])
    n = lambda t: None if t is None else (t - T).days
    g = sorted((r.s, r.p, n(r.gap_from), n(r.gap_to)) for r in gaps(iv, ["s", "p"]).collect())
    q = sorted(((r.s, r.p, n(r.period_from), n(r.period_to)) for r in periods(iv, ["s", "p"]).collect()), key=str)
    return g, q


def test_cases(spark):
    rows = [
        ("a", "p", 0, 10), ("a", "p", 2, 3), ("a", "p", 10, 12), ("a", "p", 20, 30), ("a", "p", 20, 30), ("a", "p", 25, 25), ("a", "p", 40, 35),
        ("b", "p", None, 5), ("b", "p", 9, None), ("b", "q", None, None), ("b", "q", 3, 4), (None, "p", 1, 2), ("c", "p", 1, 2), ("d", "p", 3, 3),
    ]
    named = [("a", "p"), ("a", "p"), ("b", "p"), ("b", "q"), ("d", "p"), ("none", "p"), (None, "p")]
    g, q = run(spark, rows, named)
    assert g == [("a", "p", 12, 20), ("b", "p", 5, 9)]
    assert q == sorted([("a", "p", 0, 12), ("a", "p", 20, 30), ("b", "p", None, 5), ("b", "p", 9, None), ("b", "q", None, None)], key=str)
    assert run(spark, []) == ([], [])


def test_hot_slots_cut_by_partitions(spark):
    rng = random.Random(7)
    for seed in range(3):
        rows = []
        for s, n in (("a", 3), ("hot", 900), ("long", 200), ("z", 4)):
            for _ in range(n):
                a = rng.randrange(3000)
                rows.append((s, "p", a, a + rng.choice([1, 2, 3, 400 if s == "long" and rng.random() < 0.05 else 1])))
        g, q = run(spark, rows)
        want = {s: brute([(a, b) for x, _, a, b in rows if x == s]) for s in {r[0] for r in rows}}
        assert q == sorted([(s, "p", a, b) for s, x in want.items() for a, b in x], key=str)
        assert g == sorted((s, "p", x[1], y[0]) for s, w in want.items() for x, y in zip(w, w[1:]))


def test_slots_beyond_the_limit_are_cut_by_time(spark):
    rng = random.Random(11)
    rows = []
    for s, n in (("a", 3), ("hot", 400), ("long", 120), ("z", 1)):
        for _ in range(n):
            a = rng.randrange(2000)
            rows.append((s, a, a + rng.choice([1, 2, 3, 700 if s == "long" else 40])))
    rows += [("hot", None, 5), ("hot", 1990, None)]
    df = spark.createDataFrame([(s, "p", day(a), day(b), "x") for s, a, b in rows], SCHEMA).repartition(6)
    iv = slot_intervals(df, {"s": "s"}, "a", "b")
    far = lambda a, b: (-(10**6) if a is None else a, 10**6 if b is None else b)
    want = {s: brute([far(a, b) for x, a, b in rows if x == s]) for s in {r[0] for r in rows}}
    n = lambda t, none: none if t is None else (t - T).days
    for limit in (5, 30, 10**6):
        got = sorted((r.s, n(r.period_from, -(10**6)), n(r.period_to, 10**6)) for r in periods(iv, ["s"], limit).collect())
        assert got == sorted((s, a, b) for s, x in want.items() for a, b in x)
        got = sorted((r.s, n(r.gap_from, None), n(r.gap_to, None)) for r in gaps(iv, ["s"], limit).collect())
        assert got == sorted((s, x[1], y[0]) for s, w in want.items() for x, y in zip(w, w[1:]))


def test_many_named_slots_join_lists(spark):
    df = spark.createDataFrame([(s, "p", day(a), day(b), "x") for s, a, b in [("a", 0, 1), ("a", 3, 4), ("b", 0, 1), ("b", 2, 3)]], SCHEMA)
    iv = slot_intervals(df, {"s": "s"}, "a", "b")
    named = spark.createDataFrame([("a",), ("a",), (None,), ("q",)], "s string")
    for few in (0, 10):
        got = [(r.s, (r.gap_from - T).days, (r.gap_to - T).days) for r in gaps(of_slots(iv, named, ["s"], few), ["s"]).collect()]
        assert got == [("a", 1, 3)]


@settings(max_examples=100, deadline=None)
@given(st.lists(pairs, max_size=9))
def test_the_tree_gives_one_list(lists):
    tree = Tree()
    for x in lists:
        tree.add(IntervalList(x))
    assert tree.root().pairs == brute([p for x in lists for p in x])
    assert all(len(b) * 2 < len(a) for a, b in zip(tree.levels, tree.levels[1:]))

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.known_at import NEVER, History, known_at

T = datetime(2020, 1, 1)
claim = st.tuples(st.integers(0, 15), st.integers(0, 20), st.integers(0, 15), st.integers(0, 25))


@settings(max_examples=200, deadline=None)
@given(st.lists(claim, max_size=25), st.integers(0, 25), st.integers(0, 25))
def test_history_against_brute_force(rows, known, valid):
    claims = [(a, b, (r, f"c{i}"), r, c if c < 22 else NEVER) for i, (a, b, r, c) in enumerate(rows)]
    best = max((rank for a, b, rank, r, c in claims if a <= valid < b and r <= known < c), default=None)
    assert History(claims).known(known, valid) == best


def day(n):
    return None if n is None else T + timedelta(days=n)


EVENTS = "subject string, event_id string, known_at timestamp_ntz, valid_at timestamp_ntz, attribute string"
CLAIMS = "subject string, attribute string, claim_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, closed_at timestamp_ntz, event_id string"


def run(spark, events, claims, limit=200_000):
    e = spark.createDataFrame([(s, i, day(k), day(v), "x") for s, i, k, v in events], EVENTS)
    c = spark.createDataFrame([(s, a, i, day(f), day(t), day(r), day(x), "y") for s, a, i, f, t, r, x in claims], CLAIMS)
    return sorted(((r.event_id, r.attribute, r.claim_id) for r in known_at(e, c, limit).collect()), key=str)


def brute(events, claims):
    out = set()
    for s, i, k, v in events:
        if None in (s, k, v):
            continue
        best = {}
        for cs, a, ci, f, t, r, x in claims:
            if cs == s and r is not None and r <= k and (x is None or x > k) and (f is None or f <= v) and (t is None or t > v):
                best[a] = max(best.get(a, (-1, "")), (r, ci))
        out |= {(i, a, b[1]) for a, b in best.items()}
    return sorted(out, key=str)


def test_cases(spark):
    events = [("s", "e1", 10, 10), ("s", "e1", 10, 10), ("s", "e2", None, 3), (None, "e3", 5, 5), ("t", "e4", 5, 5), ("s", "e5", 4, 10)]
    claims = [
        ("s", "a", "c1", None, None, 5, None), ("s", "a", "c1", None, None, 5, None), ("s", "a", "c2", 0, 20, 6, None), ("s", "a", "c3", 0, 20, 11, None),
        ("s", "b", "c4", 10, 11, 10, None), ("s", "b", "c5", 0, 10, 9, None), ("s", "b", "c6", 0, 20, 9, 10), ("s", None, "c7", 0, 20, 1, None),
        ("s", "d", "c8", 0, 20, None, None), ("s", "d", "c9", 9, 8, 1, None), ("s", "d", "d1", 0, 20, 3, 3), (None, "a", "d2", 0, 20, 1, None), ("s", "f", "d3", 0, 20, 7, None), ("s", "f", "d4", 0, 20, 7, None),
    ]
    got = run(spark, events, claims)
    assert got == brute(events, claims)
    assert ("e1", "a", "c2") in got and ("e1", None, "c7") in got and ("e1", "f", "d4") in got
    assert run(spark, [], claims) == [] and run(spark, events, []) == []


def test_hot_subjects_are_cut_and_agree(spark):
    rng = random.Random(2)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    claims = [(rng.choice(["hot", "hot", "x", "y"]), rng.choice("ab"), f"c{i}", some(60), some(90), some(70), some(120)) for i in range(150)]
    events = [(rng.choice(["hot", "hot", "x", "z"]), f"e{i}", rng.randrange(100), rng.randrange(100)) for i in range(120)]
    want = brute(events, claims)
    assert run(spark, events, claims) == want
    assert run(spark, events, claims, limit=20) == want

"""The reconcile fold: indexed claims against a plain list, request siblings, stated replacements, growth."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql.types import StructType

from tidemark.operators import reconcile
from tidemark.operators.reconcile import Slot, order, power

T = datetime(2024, 1, 1)
BASE = {"slot": "s", "valid_from": None, "valid_to": None, "source": "one", "sequence": None, "commit_time": None, "trust": "standard", "policy": "conflict", "operation": "append", "status": "active", "request": None, "replaces": False}


def day(n):
    return None if n is None else T + timedelta(days=n)


def plain(arrivals):
    """Every open claim looked at for each arrival."""
    every = []
    for c in arrivals:
        c = dict(c, superseded_at=None, superseded_by=None, conflict_set=None)
        every.append(c)
        if c["status"] == "quarantined":
            continue
        c["status"] = "active"

        def close(some, by):
            for o in some:
                o.update(status="superseded", superseded_at=by["recorded_at"], superseded_by=by["id"])

        able = [o for o in every if o is not c and o["status"] in ("active", "disputed")]
        low, high = lambda x: x["valid_from"] or datetime.min, lambda x: x["valid_to"] or datetime.max
        if c["operation"] == "correction" or c["replaces"]:
            own = [o for o in able if o["source"] == c["source"] and c["source"] is not None and (c["request"] is None or o["request"] != c["request"])]
            if any(order(c, o) == -1 for o in own):
                close([c], next(o for o in own if order(c, o) == -1) | {"recorded_at": c["recorded_at"]})
                continue
            close(own, c)
            able = [o for o in able if o not in own]
        if c["policy"] == "multi_value":
            continue
        rivals = [o for o in able if o["object_key"] != c["object_key"] and low(o) < high(c) and low(c) < high(o) and low(o) < high(o) and low(c) < high(c)]
        if any(order(c, o) == -1 for o in rivals):
            close([c], next(o for o in rivals if order(c, o) == -1) | {"recorded_at": c["recorded_at"]})
            continue
        close([o for o in rivals if order(c, o) == 1], c)
        rivals = [o for o in rivals if order(c, o) != 1]
        if not rivals:
            continue
        if c["policy"] == "latest_wins" or c["policy"] == "highest_authority" and all(power(o) < power(c) for o in rivals):
            close(rivals, c)
            continue
        name = next((o["conflict_set"] for o in rivals if o["conflict_set"]), "conflict:" + min(o["id"] for o in [*rivals, c]))
        for o in [*rivals, c]:
            o.update(status="disputed", conflict_set=o["conflict_set"] or name)
    return {c["id"]: (c["status"], c["superseded_at"], c["superseded_by"], c["conflict_set"]) for c in every}


def standing(df):
    return {r.id: (r.status, r.superseded_at, r.superseded_by, r.conflict_set) for r in reconcile.reconcile(df).collect()}


def frame(spark, rows):
    kind = StructType.fromDDL(reconcile.FIELDS + ", " + reconcile.OPTIONAL)
    return spark.createDataFrame([tuple((BASE | r)[f.name] for f in kind) for r in rows], kind)


def some(rng, slot, n):
    policy = rng.choice(["latest_wins", "highest_authority", "conflict", None, "multi_value"])
    for i in range(n):
        lo = rng.choice([None, *range(12)])
        yield {
            "slot": slot, "id": f"{slot}{i:03d}", "object_key": rng.choice("abc") if rng.random() < 0.95 else None, "valid_from": day(lo), "valid_to": day(rng.choice([None, *range(14)])), "recorded_at": day(20 + i),
            "source": rng.choice(["one", "two", None]), "sequence": rng.choice([None, "", "7", "10", "x"]), "commit_time": day(rng.choice([None, 1, 2, 3])), "trust": rng.choice(["low", "standard", "high", None]), "policy": policy,
            "operation": "correction" if rng.random() < 0.1 else "append", "status": "quarantined" if rng.random() < 0.05 else "active", "request": rng.choice([None, "r1", "r2"]), "replaces": rng.random() < 0.1,
        }


def test_indexed_claims_against_a_plain_list(spark):
    rng = random.Random(3)
    slots = [list(some(rng, f"s{k:02d}", 40)) for k in range(40)]
    want = {i: x for rows in slots for i, x in plain([BASE | r for r in rows]).items()}
    assert standing(frame(spark, [r for rows in slots for r in rows])) == want
    assert {x[0] for x in want.values()} == {"active", "disputed", "superseded", "quarantined"}


def test_claims_of_one_correction_do_not_retire_each_other(spark):
    for policy in ("multi_value", "conflict"):
        rows = [
            {"id": "a", "object_key": "1", "recorded_at": day(1), "request": "r1"},
            {"id": "b", "object_key": "2", "recorded_at": day(2), "request": "r2", "operation": "correction", "valid_to": day(9)},
            {"id": "c", "object_key": "3", "recorded_at": day(3), "request": "r2", "operation": "correction", "valid_from": day(9)},
        ]
        got = standing(frame(spark, [r | {"policy": policy} for r in rows]))
        assert {i: x[0] for i, x in got.items()} == {"a": "superseded", "b": "active", "c": "active"}


def test_a_stated_replacement_retires_the_sources_earlier_values(spark):
    rows = [
        {"id": "a", "object_key": "USD 100", "recorded_at": day(1), "request": "r1"}, {"id": "b", "object_key": "USD 110", "recorded_at": day(2), "request": "r2"},
        {"id": "x", "object_key": "USD 90", "recorded_at": day(2), "request": "r9", "source": "two"}, {"id": "c", "object_key": "USD 125", "recorded_at": day(3), "request": "r3", "replaces": True},
    ]
    got = standing(frame(spark, [r | {"policy": "multi_value"} for r in rows]))
    assert {i: (x[0], x[2]) for i, x in got.items()} == {"a": ("superseded", "c"), "b": ("superseded", "c"), "x": ("active", None), "c": ("active", None)}


def test_empty_input_and_missing_optional_columns(spark):
    df = frame(spark, [{"id": "a", "object_key": "1", "recorded_at": day(1)}])
    assert standing(df.limit(0)) == {}
    assert standing(df.drop("request", "replaces").withColumn("claim", df.id).withColumn("n", df.id))["a"][0] == "active"


def test_a_hot_slot_costs_in_proportion():
    def seconds(policy, n):
        rng, slot, t = random.Random(1), Slot(), time.process_time()
        slot.herald(None, None)
        for i in range(n):
            slot.arrive(BASE | {"id": f"c{i}", "object_key": str(rng.randrange(n)), "recorded_at": day(i % 9), "valid_from": day(rng.randrange(n)), "valid_to": None, "policy": policy})
        return time.process_time() - t

    for policy in ("conflict", "multi_value", "highest_authority"):
        seconds(policy, 500)
        assert seconds(policy, 8000) < 9 * max(seconds(policy, 2000), 0.02)

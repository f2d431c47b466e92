import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, memory, ontology, policy, reconcile
from tidemark.operators.asof import ClaimQuery, claims_as_of
from tidemark.streaming.reconcile import reconcile_stream

T = datetime(2024, 1, 1)
D = lambda n: None if n is None else T + timedelta(days=n)
CLAIM = "assertion_id string, subject_id string, predicate_name string, object_key string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, superseded_at timestamp_ntz, retracted_at timestamp_ntz, status string, confidence double"


def test_bitemporal_truth_table(spark):
    rows = [("old", "s", "p", "v:1", D(0), None, D(1), D(20), None, "superseded", 1.0), ("new", "s", "p", "v:2", D(10), None, D(20), None, None, "active", 1.0)]
    df = spark.createDataFrame(rows, CLAIM)
    ask = lambda **q: sorted(r.assertion_id for r in claims_as_of(df, ClaimQuery(**q)).collect())
    assert ask(known_at=D(5), valid_at=D(15)) == ["old"]
    assert ask(known_at=D(25), valid_at=D(15)) == ["new"]
    assert ask(known_at=D(25), valid_at=D(5)) == []
    assert ask(known_at=D(0), valid_at=D(5)) == []
    assert ask(known_at=D(20)) == ["new"]
    assert ask(valid_at=D(10)) == ["new"] and ask(valid_at=D(9)) == []
    assert ask(include_superseded=True, valid_at=D(15)) == ["new", "old"]
    assert ask(limit=1) == ["new"] and ask(limit=5, offset=1) == []


def test_as_of_join_ties_nulls_and_clashes(spark):
    left = spark.createDataFrame([("k", D(5), 1), ("k", D(1), 2), (None, D(5), 3), ("k", None, 4), ("z", D(9), 5)], "key string, t timestamp_ntz, v int")
    right = spark.createDataFrame([("k", D(2), "a", 7), ("k", D(5), "b", 8), ("k", D(5), "c", 9), (None, D(1), "d", 1), ("k", D(6), "e", 2)], "key string, t timestamp_ntz, id string, v int")
    got = {r.v: (r.right_id, r.right_v) for r in asof.as_of_join(left, right, ["key"], "t", "t", "id").collect()}
    assert got == {1: ("c", 9), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}


def arrivals(spark, rows):
    base = {"slot": "s", "valid_from": None, "valid_to": None, "source": "one", "sequence": None, "commit_time": None, "trust": "standard", "policy": "latest_wins", "operation": "append", "status": "active"}
    names = ["slot", "id", "object_key", "valid_from", "valid_to", "recorded_at", "source", "sequence", "commit_time", "trust", "policy", "operation", "status"]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], reconcile.FIELDS)


def standing(spark, rows):
    return {r.id: (r.status, r.superseded_by) for r in reconcile.reconcile(arrivals(spark, rows)).collect()}


def test_late_state_is_superseded_on_arrival(spark):
    got = standing(spark, [{"id": "b", "object_key": "2", "recorded_at": D(1), "sequence": "10"}, {"id": "a", "object_key": "1", "recorded_at": D(2), "sequence": "9"}])
    assert got == {"b": ("active", None), "a": ("superseded", "b")}


def test_policies(spark):
    two = lambda p, t1="standard", t2="standard": [{"id": "a", "object_key": "1", "recorded_at": D(1), "source": "x", "policy": p, "trust": t1}, {"id": "b", "object_key": "2", "recorded_at": D(2), "source": "y", "policy": p, "trust": t2}]
    assert standing(spark, two("latest_wins")) == {"a": ("superseded", "b"), "b": ("active", None)}
    assert standing(spark, two("highest_authority", "low", "high")) == {"a": ("superseded", "b"), "b": ("active", None)}
    assert standing(spark, two("highest_authority")) == {"a": ("disputed", None), "b": ("disputed", None)}
    assert standing(spark, two(None)) == {"a": ("disputed", None), "b": ("disputed", None)}
    assert standing(spark, two("multi_value")) == {"a": ("active", None), "b": ("active", None)}


def test_equal_values_disjoint_times_quarantine_and_corrections(spark):
    rows = [
        {"id": "a", "object_key": "1", "recorded_at": D(1), "valid_from": D(1), "valid_to": D(5)}, {"id": "b", "object_key": "2", "recorded_at": D(2), "valid_from": D(5), "valid_to": D(9)}, {"id": "c", "object_key": "1", "recorded_at": D(3), "valid_from": D(2), "valid_to": D(4)},
        {"id": "q", "object_key": "9", "recorded_at": D(4), "status": "quarantined"}, {"id": "a", "object_key": "1", "recorded_at": D(1), "valid_from": D(1), "valid_to": D(5)},
        {"slot": "t", "id": "m", "object_key": "1", "recorded_at": D(1), "policy": "multi_value"}, {"slot": "t", "id": "n", "object_key": "2", "recorded_at": D(2), "policy": "multi_value", "operation": "correction"},
        {"slot": None, "id": "z", "object_key": "1", "recorded_at": D(1)},
    ]
    assert standing(spark, rows) == {"a": ("active", None), "b": ("active", None), "c": ("active", None), "q": ("quarantined", None), "m": ("superseded", "n"), "n": ("active", None)}


def test_any_arrival_order_ends_alike_and_agrees_with_the_closed_form(spark):
    for seed in range(4):
        order = list(range(12))
        random.Random(seed).shuffle(order)
        rows = [{"id": f"c{n:02d}", "object_key": str(n), "recorded_at": D(i), "sequence": str(n)} for i, n in enumerate(order)]
        got = {r.id: r for r in reconcile.reconcile(arrivals(spark, rows)).collect()}
        assert [i for i, r in got.items() if r.status == "active"] == ["c11"]
        closed = reconcile.superseded_closed_form(arrivals(spark, rows).withColumn("n", F.col("sequence").cast("int")), ["slot"], "n")
        assert {r.id: r.superseded_at for r in closed.collect()} == {i: r.superseded_at for i, r in got.items()}


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"slot": rng.choice("stu"), "id": f"c{i:02d}", "object_key": str(rng.randrange(4)), "recorded_at": D(i), "sequence": str(rng.randrange(30)), "source": rng.choice("xy"), "policy": rng.choice(["latest_wins", "conflict"])} for i in range(30)]
    for r in rows:
        r["policy"] = {"s": "latest_wins", "t": "conflict", "u": "highest_authority"}[r["slot"]]
    folder = str(tmp_path / "in")
    for part in (rows[:13], rows[13:]):
        arrivals(spark, part).coalesce(1).write.mode("append").parquet(folder)
    q = reconcile_stream(spark.readStream.schema(reconcile.FIELDS).option("maxFilesPerTrigger", 10).parquet(folder)).writeStream.format("memory").queryName("reconciled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("reconciled").collect():
        if r.id not in last or last[r.id] not in ("superseded",):
            last[r.id] = r.status
    assert last == {i: s for i, (s, _) in standing(spark, rows).items()}


def test_conflict_members_against_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        a = rng.randrange(60)
        rows.append((f"c{i:03d}", rng.choice(["hot", "hot", "s", "t"]), "p", rng.choice("abc"), None if rng.random() < 0.05 else D(a), None if rng.random() < 0.05 else D(a + rng.randrange(0, 5)), D(1), None, None, rng.choice(["active", "disputed", "superseded"]), 1.0))
    far = lambda r: (r[4] or datetime.min, r[5] or datetime.max)
    good = [r for r in rows if r[9] != "superseded" and (r[4] is None or r[5] is None or r[5] > r[4])]
    want = {a[0] for a in good for b in good if a[1] == b[1] and a[3] != b[3] and far(a)[0] < far(b)[1] and far(b)[0] < far(a)[1]}
    got = {r.assertion_id for r in reconcile.conflict_members(spark.createDataFrame(rows, CLAIM), ["subject_id", "predicate_name"]).collect()}
    assert got == want and want


def test_policy_decisions():
    at = datetime(2025, 1, 1)
    ask = lambda **k: policy.Request("p", k.pop("action", "read"), "w", at, grants=k.pop("grants", {"w": "reader"}), **k)
    assert not policy.evaluate([], ask(grants={})).allowed
    assert policy.evaluate([], ask(grants={}, system_role="owner")).allowed
    assert policy.evaluate([], ask()).filters.permitted() == ["public", "internal"]
    assert not policy.evaluate([], ask(action="write")).allowed
    rules = [policy.Rule("raise", "allow", max_classification="secret"), policy.Rule("carve", "deny", classifications=("confidential",)), policy.Rule("src", "deny", resources={"sources": ("s1",)})]
    d = policy.evaluate(rules, ask())
    assert d.allowed and d.rule == "raise" and d.filters.permitted() == ["public", "internal", "restricted", "secret"] and d.filters.denied == {"sources": {"s1"}}
    assert policy.evaluate([*rules, policy.Rule("stop", "deny", purposes=("Audit",))], ask(purpose="audit")).rule == "stop"
    assert policy.evaluate([*rules, policy.Rule("stop", "deny", not_after=at)], ask()).allowed
    assert policy.narrowed(d.filters, "internal").max_classification == "internal"


def test_policy_nulls(spark):
    df = spark.createDataFrame([(1, "public", None, None, "", ""), (2, "public", "c", "s", "t", "p"), (3, "secret", "c", "s", "t", "p"), (4, None, "c", "s", "t", "p"), (5, "public", "d", "u", "v", "q")], "n int, classification string, collection string, source string, type string, predicate string")
    cols = {"classification": "classification", "collections": "collection", "sources": "source", "entity_types": "type", "predicates": "predicate"}
    ids = lambda f: [r.n for r in df.filter(f.condition(cols)).orderBy("n").collect()]
    f = lambda **k: policy.Filters("internal", set(), k.get("allowed", {}), k.get("denied", {}))
    assert ids(f()) == [1, 2, 5]
    assert ids(f(allowed={"collections": {"c"}})) == [1, 2]
    assert ids(f(allowed={"sources": {"s"}})) == [2]
    assert ids(f(allowed={"entity_types": {"t"}, "predicates": {"p"}})) == [1, 2]
    assert ids(f(denied={"collections": {"c"}, "sources": {"u"}})) == [1]
    assert ids(policy.Filters()) == [1, 2, 3, 4, 5]


def test_ontology_gives_all_violations(spark):
    claims = spark.createDataFrame([(1, "person", None, "tier", "symbol", "Gold"), (2, "robot", None, "tier", "integer", "1"), (3, "person", None, "other", "string", "x"), (4, None, "robot", "owns", "entity", "e"), (5, "person", None, "tier", "symbol", "tin")], "n int, subject_type string, object_type string, predicate string, object_kind string, object_text string")
    rules = spark.createDataFrame([("tier", ["person"], [], ["symbol"], ["gold"]), ("owns", [], ["person"], [], None)], "name string, subject_types array<string>, object_types array<string>, object_kinds array<string>, allowed_values array<string>")
    got = {r.n: r.violations for r in ontology.violations(claims, rules, ["person"]).collect()}
    assert got == {1: [], 2: ["unknown_entity_type", "subject_type", "object_kind"], 3: ["unknown_predicate"], 4: ["unknown_entity_type", "object_type"], 5: ["value"]}


def test_consolidation(spark):
    rows = [("s", "p", "k", f"a{i}", "x" if i < 2 else "y", 0.8, D(i), D(i)) for i in range(3)] + [("s", "p", "l", "b", "x", 0.9, None, D(1))]
    df = spark.createDataFrame(rows, "subject_id string, predicate_name string, object_key string, assertion_id string, source_id string, confidence double, valid_from timestamp_ntz, recorded_at timestamp_ntz")
    (r,) = memory.consolidate(df).collect()
    assert (r.members, r.sources, r.valid_from, r.first_assertion_id) == (3, 2, D(0), "a0")
    assert r.confidence == pytest.approx(0.8 * (0.6 + 0.25 * (1 - 0.6**3) + 0.15 * (1 - 0.5**2)))
    assert memory.not_yet_derived(memory.consolidate(df), df.filter("object_key = 'k'")).count() == 0


def test_as_of_join_of_a_hot_key_over_many_stretches(spark):
    rng = random.Random(3)
    left = [(rng.choice(["hot", "hot", "x"]), D(0) + timedelta(hours=rng.randrange(2000)), i) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "x", "y"]), D(0) + timedelta(hours=rng.randrange(2000)), f"r{i:03d}") for i in range(60)]
    got = {r.v: r.right_id for r in asof.as_of_join(spark.createDataFrame(left, "key string, t timestamp_ntz, v int"), spark.createDataFrame(right, "key string, at timestamp_ntz, id string"), ["key"], "t", "at", "id").collect()}
    want = {v: max(((at, i) for k2, at, i in right if k2 == k and at <= t), default=(None, None))[1] for k, t, v in left}
    assert got == want

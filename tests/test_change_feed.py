import random

from tidemark.operators import change_feed
from tidemark.operators.change_feed import ChangeTable, changes, current_state
from tidemark.streaming.feeds import apply_changes, state_of

SCHEMA = "s string, k string, op string, seq string, img string, stream string, at string"


def state(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(((r.stream, r.record_id, r.source_sequence, r.image) for r in current_state(df, "s", "k", "op", "seq", "img").collect()), key=str)


def test_rules(spark):
    rows = [
        ("t", '{"id":1}', "insert", "9", "a"), ("t", '{ "id" : "1" }', " UPDATE ", "10", "b"), ("t", '{"id":1}', "insert", "9", "a"),
        ("t", '{"id":2}', "insert", "1", "c"), ("t", '{"id":2}', "Delete", "2", None),
        ("t", '{"id":3}', "delete", "1", None), ("t", '{"id":3}', "snapshot", "99999999999999999999999999999999999999999999", "d"),
        ("u", '{"b":1,"a":"x"}', "insert", "01J0A", "e"), ("u", '{"a":"x","b":"1"}', "update", "01J0B", "f"),
        ("u", "not json", "insert", "1", "g"), ("u", '{"a":null}', "insert", "1", "h"),
        ("t", None, "insert", "1", "z"), (None, '{"id":1}', "insert", "1", "z"), ("t", '{"id":9}', None, "1", "z"), ("t", '{"id":9}', "truncate", "1", "z"),
        ("t", '{"id":4}', "insert", None, "i"), ("t", '{"id":5}', "insert", None, "j"), ("t", '{"id":5}', "delete", "1", None),
        ("v", '{"id":1}', "insert", "007", "k"), ("v", '{"id":1}', "delete", "6", None),
        ("w", '{"id":1}', "insert", "5", "l"), ("w", '{"id":1}', "delete", "4x", None), ("w", '{"id":2}', "delete", "5", None), ("w", '{"id":2}', "insert", "6x", "m"),
    ]
    want = [
        ("t", "id=1", "10", "b"), ("t", "id=3", "9" * 44, "d"), ("u", "a=x,b=1", "01J0B", "f"), ("u", "not json", "1", "g"), ("u", "a=null", "1", "h"),
        ("t", "id=4", None, "i"), ("v", "id=1", "007", "k"), ("w", "id=1", "5", "l"), ("w", "id=2", "6x", "m"),
    ]
    assert sorted(state(spark, rows), key=str) == sorted(want, key=str)


def test_hot_record_in_any_order(spark):
    rows = [("t", '{"id":1}', "update" if i % 7 else "delete", str(i), f"v{i}") for i in range(2000)]
    random.Random(1).shuffle(rows)
    assert state(spark, rows + rows[:500]) == [("t", "id=1", "1999", "v1999")]
    assert state(spark, [r for r in rows if int(r[3]) <= 1995]) == []


def test_empty(spark):
    assert state(spark, []) == []


def test_streamed_feed(spark, tmp_path):
    columns = "stream_name string, record_key string, operation string, source_sequence string, after_image string"
    one = [("t", '{"id":1}', "insert", "1", "a"), ("t", '{"id":2}', "insert", "5", "b")]
    two = [("t", '{"id":1}', "update", "3", "c"), ("t", '{"id":2}', "delete", "4", None), ("t", '{"id":1}', "update", "2", "d")]
    for part in (one, two):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = apply_changes(spark.readStream.schema(columns).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
    got = sorted((r.record_id, r.source_sequence, r.image) for r in state_of(spark, str(tmp_path / "out")).collect())
    assert got == [("id=1", "3", "c"), ("id=2", "5", "b")]


def test_batches_and_compaction(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("tu"), '{"id":%d}' % rng.randrange(12), rng.choice(["insert", "update", "delete"]), str(rng.randrange(60)), f"v{i}") for i in range(300)]
    frame = lambda part: changes(spark.createDataFrame([(*r, "x", "y") for r in part], SCHEMA), "s", "k", "op", "seq", "img")
    table, done = ChangeTable(spark, str(tmp_path / "t")), []
    for n in range(5):
        part = rows[n * 60 : n * 60 + 60]
        table.append(frame(part), n)
        if n == 1:
            table.append(frame(part), n)  # a replayed batch
        done += part
        got = sorted(((r.stream, r.record_id, r.source_sequence, r.image) for r in table.state().collect()), key=str)
        assert got == state(spark, done)
        if n in (1, 3):
            table.compact()
            assert sorted(((r.stream, r.record_id, r.source_sequence, r.image) for r in table.state().collect()), key=str) == got
    assert table.generation() == 2


def test_records_with_many_changes_are_removed_in_the_scan(spark, monkeypatch):
    monkeypatch.setattr(change_feed, "MANY", 50)
    rows = [("t", '{"id":%d}' % (i % 3 if i < 600 else i), "update" if i % 7 else "delete", str(i), f"v{i}") for i in range(900)]
    want = sorted([("t", f"id={i}", str(i), f"v{i}") for i in range(600, 900) if i % 7] + [("t", f"id={i % 3}", str(i), f"v{i}") for i in (597, 598, 599) if i % 7], key=str)
    assert state(spark, rows) == want

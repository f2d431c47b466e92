import json
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ingest
from tidemark.sources import change_log, chunks, decode, portable


def test_chat():
    payload = {"messages": [{"role": "user", "content": "Hi\r\nthere", "timestamp": "2026-03-25T09:58:00Z"}, {"role": "", "content": "yes", "name": "Bo"}]}
    a, b = decode.segments("application/json; charset=utf-8", json.dumps(payload))
    assert (a["content"], a["char_start"], a["char_end"], a["json_pointer"], a["event_time"]) == ("user: Hi\nthere", 0, 14, "/messages/0", datetime(2026, 3, 25, 9, 58))
    assert (b["content"], b["char_start"], b["speaker"]) == ("yes", 16, "Bo")


def test_records():
    payload = [{"id": "acme", "tier": "gold", "signed_at": "x", "created_at": "2026-03-03"}, "plain\r", {"pk": 7, "n": 1.0, "m": 1.5}]
    a, b, c = decode.segments("application/json", json.dumps(payload))
    assert a["row_key"] == "acme" and a["event_time"] == datetime(2026, 3, 3) and a["content"].startswith('{\n  "created_at"')
    assert b["content"] == "plain\n" and c["row_key"] == "7" and '"n": 1,' in c["content"] and '"m": 1.5' in c["content"]
    assert decode.segments("application/json", '{"b":1,"a":"<x>"}')[0]["content"] == '{\n  "a": "\\u003cx\\u003e",\n  "b": 1\n}'
    assert decode.segments("application/json", "{broken")[0]["error"] == "malformed JSON"
    assert decode.segments("application/json", "[]") == [] and decode.segments(None, None) == []


def test_markdown_sections():
    doc = "intro\n\n# A\n\ntext\n\n### Deep\n\nmore\n## B\n#no heading\n####### seven\n"
    got = [(s["section"], s["heading_path"], s["heading_level"], s["content"]) for s in decode.segments("text/markdown", doc)]
    assert got == [("", [], 0, "intro"), ("A", ["A"], 1, "# A\n\ntext"), ("Deep", ["A", "", "Deep"], 3, "### Deep\n\nmore"), ("B", ["A", "B"], 2, "## B\n#no heading\n####### seven")]
    assert [s["content"] for s in decode.segments("text/markdown", " \n")] == [" \n"]


def test_change_rows():
    e = {"stream": "t", "operation": "update", "key": {"b": 2, "a": "x"}, "after": {"z": None, "n": 1}, "event_time": "2025-01-02T03:04:05Z"}
    (s,) = decode.segments(decode.CHANGE, json.dumps(e))
    assert s["content"] == "t update t:a=x,b=2\nn: 1\nz: null" and s["row_key"] == "t:a=x,b=2"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é漢.\n,;!? ", max_size=600), st.integers(4, 40), st.integers(0, 50))
def test_windows_cover_every_word(t, size, overlap):
    spans = list(chunks.windows(t, size, overlap))
    seen = set()
    for lo, hi in spans:
        assert 0 < hi - lo <= max(16, size * 4) and t[lo:hi].strip()
        seen.update(range(lo, hi))
    assert all(i in seen for i, c in enumerate(t) if c.strip())


def test_windows_prefer_breaks():
    t = "word " * 60 + "end.\n\n" + "more " * 60
    lo, hi = next(iter(chunks.windows(t, 80, 10)))
    assert t[:hi].endswith("end.\n\n")
    hard = list(chunks.windows("x" * 1000, 50, 10))
    assert hard[0] == (0, 200) and hard[1] == (160, 360)


def test_chunks_and_decode_rows(spark):
    df = spark.createDataFrame([(1, "text/plain", "a b"), (2, None, None), (3, "text/markdown", "# T\nx"), (4, "text/plain", " ")], "doc_id int, media_type string, text string")
    s = decode.decode(df, "doc_id", "media_type", "text")
    assert sorted((r.id, r.content) for r in s.collect()) == [(1, "a b"), (3, "# T\nx"), (4, " ")]
    c = chunks.chunk(s.withColumnRenamed("content", "body").select("id", "body"), "body", ["id"])
    assert sorted((r.id, r.content, r.token_count) for r in c.collect()) == [(1, "a b", 1), (3, "# T\nx", 1)]
    assert decode.decode(df.limit(0), "doc_id", "media_type", "text").count() == 0


def test_change_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('// head\n\n{"stream":"t","operation":"update","key":{"id":1},"before":{"a":1,"b":2},"after":{"a":1,"b":3,"c":null},"offset":"9","commit_time":"2025-01-01T00:00:00Z"}\n')
    df = change_log.replay(spark, str(tmp_path / "log.jsonl"))
    r = df.select("stream", "offset", change_log.changed_columns(F.col("before"), F.col("after")).alias("changed"), change_log.row_text(F.col("stream"), F.col("operation"), F.col("key"), F.col("after")).alias("line")).collect()
    assert [tuple(x) for x in r] == [("t", "9", ["b", "c"], "t update t:id=1\na: 1\nb: 3\nc: null")]
    key = change_log.change_key(F.lit("s"), F.col("o"), F.col("q"), F.lit("u"), F.lit("r"))
    keys = [x[0] for x in spark.createDataFrame([("1", "2"), ("1", "3"), (None, "2"), ("", None)], "o string, q string").select(key).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_column_claims_and_suppression(spark):
    rows = [("r", "1", '{"n":"5","x":"gold","e":" "}'), ("r", "2", '{"n":"5.0","x":"gold"}'), ("r", "10", '{"n":"five","x":null}')]
    df = spark.createDataFrame(rows, "record string, seq string, after string").withColumn("at", change_log.at_position("seq"))
    c = change_log.column_claims(df, [("n", "N", "decimal", True), ("x", "X", "symbol", True), ("e", "E", "string", True)])
    assert sorted((r.seq, r.predicate, r.object_key) for r in c.collect()) == [("1", "N", "decimal:5"), ("1", "X", "symbol:GOLD"), ("10", "N", "string:five"), ("2", "N", "decimal:5"), ("2", "X", "symbol:GOLD")]
    kept = change_log.without_unchanged(c, ["record", "predicate"], [F.col("at.kind"), F.col("at.size"), F.col("at.body")])
    assert sorted((r.seq, r.predicate) for r in kept.collect()) == [("1", "N"), ("1", "X"), ("10", "N")]


def test_packages(spark, tmp_path):
    tables = {"sources": (spark.createDataFrame([("s1", None), ("s2", "x")], "source_id string, name string"), "source_id"), "entities": (spark.createDataFrame([("e1",)], "entity_id string"), "entity_id")}
    lines = portable.to_lines(tables)
    m = portable.write(lines, str(tmp_path / "pkg"))
    back, expected = portable.read(spark, str(tmp_path / "pkg"))
    assert expected == m and portable.verify(back, expected) == []
    bad = back.withColumn("line", F.when(F.col("id") == "e1", "{}").otherwise(F.col("line")))
    assert portable.verify(bad, expected) == ["entities"]
    assert portable.section_digests(lines).orderBy("section").collect() == portable.section_digests(back.repartition(3)).orderBy("section").collect()


def test_ingest(spark):
    t = lambda n: datetime(2025, 1, n)
    rows = [("s", "k", "r1", "h", t(2)), ("s", "k", "r2", "h2", t(1)), ("s", "l", "r3", "h", t(1)), (None, "k", "r4", "h", t(1)), ("s", None, "r5", None, t(1))]
    df = spark.createDataFrame(rows, "source_id string, idempotency_key string, request_id string, content_hash string, recorded_at timestamp_ntz")
    got = sorted(((r.source_id, r.idempotency_key, r.request_id, r.deliveries, r.conflict) for r in ingest.first_wins(df).collect()), key=str)
    assert got == sorted([("s", "k", "r2", 2, True), ("s", "l", "r3", 1, False), (None, "k", "r4", 1, False), ("s", None, "r5", 1, False)], key=str)
    assert ingest.accept(df, df.filter("idempotency_key = 'k' and source_id = 's'")).count() == 3
    q = spark.createDataFrame([("1", "p", "pending", t(1), t(1), None), ("2", "p", "pending", t(2), t(1), None), ("3", "", "pending", t(1), t(1), None), ("4", "", "pending", t(9), t(1), None), ("5", "b", "claimed", t(1), t(1), t(8)), ("6", "b", "pending", t(1), t(1), None)], "id string, partition_key string, status string, visible_at timestamp_ntz, created_at timestamp_ntz, claim_expires_at timestamp_ntz")
    assert sorted(r.id for r in ingest.claimable(q, "2025-01-05 00:00:00").collect()) == ["1", "3"]


def test_text_contract_of_token_counts(spark):
    df = spark.createDataFrame([("x" * n,) for n in (1, 2, 5, 6, 1281, 1282)], "t string")
    assert [r[0] for r in df.select(text.token_count(F.col("t"))).collect()] == [1, 1, 1, 2, 320, 321]

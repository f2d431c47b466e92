"""Decoding payloads into segments: plain text, markdown, chats, records, change rows.

One pass in Arrow batches, no shuffle: each payload yields an array of segments that the caller explodes. Offsets are in
characters of the decoded text, whose segments are joined by a blank line.

Defined cases: a null payload has no segments; one that claims JSON but isn't becomes one plain segment with
``error`` set; an unknown media type is plain text; empty texts are one empty segment, markdown without text too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.tables import spread

PLAIN, MARKDOWN, JSON, CHANGE = "text/plain", "text/markdown", "application/json", "application/vnd.change-row+json"
#: Where a record's key and time are looked for, in order. Fixed values.
KEY_FIELDS = ("id", "ID", "_id", "uuid", "key", "pk", "primary_key")
TIME_FIELDS = ("event_time", "timestamp", "occurred_at", "created_at", "updated_at")
HEADING = re.compile(r"^ *(#{1,6}) (.*)$")
SEGMENT = (
    "sequence int, content string, content_type string, event_time timestamp_ntz, role string, speaker string, section string, "
    "heading_path array<string>, heading_level int, json_pointer string, row_key string, char_start int, char_end int, error string"
)
FIELDS = [x.split()[0] for x in SEGMENT.split(", ")]


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def parse_time(x: object) -> datetime | None:
    """A time stamp with zone, or a date, as UTC without zone."""
    if not isinstance(x, str) or not re.match(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?$", x):
        return None
    try:
        t = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", x))
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def _numbers(x: object) -> object:
    """Whole floats as integers, so 1.0 and 1 read alike."""
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        return int(x)
    if isinstance(x, dict):
        return {k: _numbers(v) for k, v in x.items()}
    return [_numbers(v) for v in x] if isinstance(x, list) else x


def canonical(x: object) -> str:
    """Indented JSON with sorted keys; angle brackets and ampersands escaped."""
    out = json.dumps(_numbers(x), indent=2, sort_keys=True, ensure_ascii=False)
    return out.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def plain_value(x: object) -> str:
    return {None: "null", True: "true", False: "false"}.get(x, str(x)) if x is None or isinstance(x, bool) else x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False)


def _laid_out(parts: list[dict]) -> list[dict]:
    at = 0
    for i, p in enumerate(parts):
        at += 2 if at else 0
        p |= {"sequence": i, "char_start": at, "char_end": at + len(p["content"])}
        at = p["char_end"]
    return parts


def _chat(messages: list) -> list[dict] | None:
    out = []
    for i, m in enumerate(messages):
        if not isinstance(m, dict) or not all(isinstance(m.get(k, ""), str) for k in ("role", "content", "name")):
            return None
        if m.get("timestamp") is not None and parse_time(m["timestamp"]) is None:
            return None
        role = m.get("role", "")
        content = newlines(m.get("content", ""))
        out.append({"content": f"{role}: {content}" if role else content, "content_type": PLAIN, "event_time": parse_time(m.get("timestamp")), "role": role, "speaker": m.get("name") or None, "json_pointer": f"/messages/{i}"})
    return out


def _record(i: int, r: object) -> dict:
    row = r if isinstance(r, dict) else {}
    key = next((plain_value(row[k]) for k in KEY_FIELDS if k in row), "")
    time = next((t for k in TIME_FIELDS if (t := parse_time(row.get(k))) is not None), None)
    return {"content": newlines(r) if isinstance(r, str) else canonical(r), "content_type": JSON, "event_time": time, "json_pointer": f"/{i}", "row_key": key}


def json_segments(text: str) -> list[dict]:
    try:
        x = json.loads(text.strip())
    except ValueError:
        return [{"content": newlines(text), "content_type": PLAIN, "error": "malformed JSON"}]
    if isinstance(x, dict) and isinstance(x.get("messages"), list) and x["messages"] and (chat := _chat(x["messages"])):
        return chat
    if isinstance(x, list):
        return [_record(i, r) for i, r in enumerate(x)]
    return [{"content": canonical(x), "content_type": JSON}]


def markdown_segments(text: str) -> list[dict]:
    """A section per ATX heading; its path holds the titles above it, empty where a level was skipped."""
    path: list[str] = []
    sections: list[tuple[int, list[str], list[str]]] = [(0, [], [])]
    for line in newlines(text).split("\n"):
        if found := HEADING.match(line):
            n = len(found[1])
            path = [*path[: n - 1], *[""] * (n - 1 - len(path)), found[2].strip()]
            sections.append((n, path, [line]))
        else:
            sections[-1][2].append(line)
    kept = [(n, p, "\n".join(lines).rstrip("\n")) for n, p, lines in sections if p and p[-1] or "".join(lines).strip()]
    if not kept:
        return [{"content": newlines(text), "content_type": MARKDOWN}]
    return [{"content": c, "content_type": MARKDOWN, "section": p[-1] if p else "", "heading_path": p, "heading_level": n} for n, p, c in kept]


def change_segments(text: str) -> list[dict]:
    """Stream, operation and record, then a line per column."""
    try:
        e = json.loads(text)
        key = e.get("key") or {}
        record = e.get("stream", "") + ":" + ",".join(f"{k}={plain_value(key[k])}" for k in sorted(key))
        image = e.get("after") or e.get("before") or {}
    except (ValueError, AttributeError):
        return [{"content": newlines(text), "content_type": PLAIN, "error": "malformed change event"}]
    lines = [f"{e.get('stream', '')} {e.get('operation', '')} {record}", *(f"{k}: {newlines(plain_value(image[k]))}" for k in sorted(image))]
    return [{"content": "\n".join(lines).rstrip("\n"), "content_type": PLAIN, "event_time": parse_time(e.get("event_time")), "row_key": record}]


def segments(media_type: str | None, text: str | None) -> list[dict]:
    if text is None:
        return []
    base = (media_type or PLAIN).split(";")[0].strip().lower()
    of = {MARKDOWN: markdown_segments, JSON: json_segments, CHANGE: change_segments}.get(base, lambda t: [{"content": newlines(t), "content_type": PLAIN}])
    return _laid_out(of(text))


def decode(payloads: DataFrame, key: str, media_type: str, text: str) -> DataFrame:
    """One row per segment: ``id`` (the key as given) and the segment's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = payloads.select(F.col(key).alias("id"), F.col(media_type).cast("string").alias("m"), F.col(text).cast("string").alias("t"))
    id_field = rows.schema["id"]
    own = to_arrow_schema(StructType.fromDDL(SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, made = [], []
            for i, (m, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                for s in segments(m, t.as_py()):
                    of.append(i)
                    made.append(s)
            cols = [pa.array([s.get(f.name) for s in made], f.type) for f in own]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *cols], ["id", *own.names])

    return spread(rows).mapInArrow(run, StructType([id_field, *StructType.fromDDL(SEGMENT).fields]))

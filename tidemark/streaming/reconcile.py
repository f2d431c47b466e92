"""Reconciling claims as a stream: the batch fold's slots as keyed state, without a watermark.

Lateness is unbounded by design: an old claim that comes late is superseded on arrival, so dropping it would lose history.
State is what can still compete in a slot. Within a micro-batch claims are replayed in order of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.reconcile import RESULT, Slot, arrivals


def _pack(slot: Slot) -> str:
    return json.dumps([{k: {"t": v.isoformat()} if isinstance(v, datetime) else v for k, v in c.items() if k != "n"} for c in slot.open])


def _unpack(text: str) -> Slot:
    slot = Slot()
    slot.restore([{k: datetime.fromisoformat(v["t"]) if isinstance(v, dict) else v for k, v in c.items()} for c in json.loads(text)])
    return slot


def reconcile_stream(claims: DataFrame) -> DataFrame:
    """Append rows with a claim's standing whenever it changes: the last row of an id holds. Input: the batch fold's columns."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = arrivals(claims).filter("slot is not null")
    names = [f.name for f in StructType.fromDDL(RESULT)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot = _unpack(state.get[0]) if state.exists else Slot()
        before = {c["id"]: (c["status"], c["conflict_set"]) for c in slot.open}
        pdf = pd.concat(list(batches)).sort_values(["recorded_at", "id"]).drop_duplicates("id")
        for c in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            if c["id"] in before:
                continue
            slot.arrive({k: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in c.items()})
        changed = [c for c in [*slot.closed, *slot.open] if before.get(c["id"]) != (c["status"], c["conflict_set"])]
        slot.closed = []
        state.update((_pack(slot),))
        out = pd.DataFrame([[c[n] for n in names] for c in changed], columns=names)
        out["superseded_at"] = pd.to_datetime(out["superseded_at"])
        yield out

    return rows.groupBy("slot").applyInPandasWithState(step, RESULT, "open string", "append", GroupStateTimeout.NoTimeout)

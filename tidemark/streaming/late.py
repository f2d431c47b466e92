"""Per-period counts of a stream by event time: the finger tree as keyed state.

Each task first adds up its rows by group, slot and the periods that their arrival leaves open, so a hot group is shuffled as
few sums. Within a group the sums of a micro-batch are replayed in order of arrival. Unlike the batch operator, which sees all
arrivals in order, a row whose period arrivals of earlier micro-batches have closed is late whatever its own arrival. A group
that gets no rows for ``idle``, if that is given, closes its periods by the wall clock, as arrivals would by then (such a stream
always has a next batch, so it never ends by itself). The sums of the emitted rows are the counts; rows of a period come when
its cut-off has passed. A group's state holds the slots of its open periods, so its
size doesn't grow with the events. Redelivery is removed before, by the event's key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.finger_tree import FingerTree
from tidemark.operators.late_events import DAY, HOUR, Replay

OUT = "grp string, period long, events long, late long"


def stream_counts(df: DataFrame, group: str, event_time: str, arrival: str, lateness: int = 48 * HOUR, period: int = DAY, slot: int = 60_000_000, salts: int = 1, idle: str | None = None) -> DataFrame:
    """Append rows (grp, period number, events, late): add up over grp and period. A group may be split into ``salts`` states."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(F.col(group).cast("string").alias("grp"), micros(event_time).alias("happened"), micros(arrival).alias("arrived")).dropna()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = pd.DataFrame({"grp": b.grp, "slot": b.happened // slot, "opens": Replay(lateness, period, slot).horizon(b.arrived)})
            yield sums.groupby(["grp", "slot", "opens"]).size().reset_index(name="n")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g, replay = key[0], Replay(lateness, period, slot)
        if state.exists:
            saved = json.loads(state.get[0])
            tree = FingerTree()
            tree.evict(saved["horizon"] * replay.per)
            for k, n in saved["slots"]:
                tree.add(k, n)
            replay.trees[g] = [tree, saved["horizon"]]
        late: dict[int, int] = {}
        if state.hasTimedOut:
            opens = int(replay.horizon(state.getCurrentProcessingTimeMs() * 1000))
            if opens > replay.trees[g][1]:
                replay.trees[g][1] = opens
                replay.close(g, replay.trees[g][0], opens)
        else:
            for x in pd.concat(list(batches)).sort_values("opens", kind="stable").itertuples():
                if not replay.take(g, int(x.slot), int(x.opens), int(x.n)):
                    late[x.slot // replay.per] = late.get(x.slot // replay.per, 0) + x.n
        tree, horizon = replay.trees[g]
        state.update((json.dumps({"horizon": int(horizon), "slots": list(tree.items())}),))
        if wait and not tree.empty:
            state.setTimeoutDuration(wait)
        out = [(g, int(p), int(n), 0) for _, p, n in replay.closed] + [(g, int(p), 0, int(n)) for p, n in late.items()]
        yield pd.DataFrame(out, columns=["grp", "period", "events", "late"])

    sums = rows.mapInPandas(add_up, "grp string, slot long, opens long, n long").withColumn("salt", F.pmod(F.xxhash64("slot"), F.lit(salts)).cast("int"))
    return sums.groupBy("grp", "salt").applyInPandasWithState(step, OUT, "tree string", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, at: str, width: str, lateness: str | None, *by: str) -> DataFrame:
    """Counts per window; on a stream with a watermark, late rows beyond it are dropped."""
    rows = df.withWatermark(at, lateness) if lateness and df.isStreaming else df
    return rows.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")


def sliding(df: DataFrame, at: str, width: str, slide: str, *by: str) -> DataFrame:
    return df.groupBy(F.window(at, width, slide).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), *by, "events")


def sessions(df: DataFrame, at: str, gap: str, *by: str) -> DataFrame:
    return df.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "events")

"""Evaluation passages that occur, whole or in part, inside a corpus.

A prefix-filtered set join on sequences of five words. Documents are read once: only sequences that some item has leave
the scan, with their positions. These are counted (rarity), every item's and document's sequences are ordered by rarity,
and only their necessary prefixes are joined: two sets that share ``least`` elements must share one within the first
n - least + 1 of each. Sets smaller than ``least`` are dropped (length bound). Candidates are verified over all their elements,
which are 64-bit hashes of the sequences: the number of joint ones over the whole document and, on demand, the greatest number
within any window as long as the item, found by one pass over the pair's hits.

The items' sequences are kept in each Python worker if there are at most ``kept`` of them (eight bytes each). Beyond that a Bloom
filter of them, ``FILTER`` bytes at most, is; what passes it is joined with the items' sequences by a shuffle.

Defined cases: null, empty and short texts (fewer than five words) have no sequences and match nothing; repeated rows of an
item or document have no effect; rows without an id are ignored; empty tables give an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import sequence_hashes, word_hashes
from tidemark.plans.tables import Scratch, spread

WORDS = 5
#: Bytes of the filter of items' sequences, and of one part of it.
FILTER, PART = 1 << 27, 1 << 15


def _places(seqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of the filter that a sequence falls into, and two bits there."""
    x = seqs.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    bits = np.uint64(8 * PART)
    return (x >> np.uint64(40)) % np.uint64(FILTER // PART), x % bits, (x * np.uint64(0xA0761D6478BD642F) >> np.uint64(20)) % bits


def bloom(vocabulary: DataFrame) -> np.ndarray:
    """Bits of the sequences (``seq``), by parts that are made in tasks of their own; no more than ``FILTER`` bytes."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, one, two = _places(b.column(0).to_numpy())
            both = np.concatenate([one, two]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(part.astype(np.int32), 2)), pa.array(both)], ["part", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            part, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                own = parts.setdefault(p, np.zeros(8 * PART, bool))
                own[bit[part == p]] = True
                if len(parts) > 64:  # sorted by part: the earlier ones are whole
                    yield pack({k: parts.pop(k) for k in sorted(parts)[:-1]})
        yield pack(parts)

    def pack(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

    places = vocabulary.select("seq").mapInArrow(place, "part int, bit int").repartition("part").sortWithinPartitions("part")
    made = places.mapInArrow(fill, "part int, bits binary").toArrow()
    out = np.zeros((FILTER // PART, PART), np.uint8)
    for p, bits in zip(made.column("part").to_pylist(), made.column("bits").to_pylist()):
        out[p] |= np.frombuffer(bits, np.uint8)
    return out


def _passes(bits: np.ndarray, seqs: np.ndarray) -> np.ndarray:
    part, *two = _places(seqs)
    hit = np.ones(len(seqs), bool)
    for at in two:
        hit &= bits[part, at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _sequences(df: DataFrame, kept: np.ndarray | None) -> DataFrame:
    """``id``, ``seq``, ``pos``; with kept, a sorted array or a filter of two dimensions, only sequences that are in it."""
    shared = None if kept is None else df.sparkSession.sparkContext.broadcast(kept)

    def held(only: np.ndarray, h: np.ndarray) -> np.ndarray:
        if only.ndim == 2:
            return _passes(only, h)
        return only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h if len(only) else np.zeros(len(h), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if shared is None else shared.value
        for b in batches:
            ids, seqs, places = [], [], []
            size = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                h = sequence_hashes(word_hashes(text), WORDS)
                at = np.arange(len(h), dtype=np.int32)
                if only is not None and len(h):
                    hit = held(only, h)
                    h, at = h[hit], at[hit]
                if len(h):
                    ids.append(np.full(len(h), i, np.int64))
                    seqs.append(h)
                    places.append(at)
                    size += len(h)
                if size > 200_000:
                    yield _batch(ids, seqs, places)
                    ids, seqs, places, size = [], [], [], 0
            yield _batch(ids, seqs, places)

    return spread(df.select("id", "text").filter("id is not null and text is not null")).mapInArrow(run, "id long, seq long, pos int")


def _windows(shared: DataFrame) -> DataFrame:
    """``item_id``, ``doc_id``, ``window_joint``: the most different sequences of a pair whose hits end within ``span`` positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        for b in batches:
            for item, doc, pos, seq, span in zip(*(c.to_pylist() for c in b.columns)):
                if (item, doc) != at:
                    if at is not None:
                        out.append((*at, best))
                    at, best, held, window = (item, doc), 0, Counter(), deque()
                window.append((pos, seq))
                held[seq] += 1
                while window[0][0] <= pos - span:
                    gone = window.popleft()[1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                best = max(best, len(held))
        if at is not None:
            out.append((*at, best))
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "window_joint"])

    rows = shared.select("item_id", "doc_id", "pos", "seq", "span").repartition("item_id", "doc_id").sortWithinPartitions("item_id", "doc_id", "pos", "seq")
    return rows.mapInArrow(run, "item_id long, doc_id long, window_joint long")


def _batch(ids: list, seqs: list, places: list) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return pa.RecordBatch.from_arrays([pa.array(join(ids, np.int64)), pa.array(join(seqs, np.int64)), pa.array(join(places, np.int32))], ["id", "seq", "pos"])


def contained(items: DataFrame, documents: DataFrame, least: int = 8, kept: int = 2_000_000, windows: bool = True) -> DataFrame:
    """Pairs that share at least ``least`` different sequences.

    Both inputs have ``id`` (a whole number) and ``text``. Columns: item_id, doc_id, joint (different sequences shared),
    item_sequences (different sequences of the item) and, with windows, window_joint (the most within one window of the
    item's length).
    """
    spark = items.sparkSession
    scratch = Scratch(spark)
    owned = scratch.write(_sequences(items.dropDuplicates(["id", "text"]), None).groupBy("id", "seq").agg(F.min("pos").alias("pos")))
    vocabulary = owned.select("seq").distinct()
    some = vocabulary.limit(kept + 1).toArrow()
    small = some.num_rows <= kept
    if small:
        hits = _sequences(documents, np.sort(some.column("seq").to_numpy()))
    else:
        hits = _sequences(documents, bloom(vocabulary)).join(vocabulary, "seq", "left_semi")
    bounded = F.broadcast if small else (lambda df: df)
    hits = scratch.write(hits.select("id", "seq", "pos").distinct())

    once = hits.groupBy("id", "seq").agg(F.min("pos").alias("pos"))
    rarity = scratch.write(once.groupBy("seq").agg(F.count("*").alias("docs")))  # no larger than the vocabulary

    def prefix(sets: DataFrame, name: str) -> DataFrame:
        """The necessary prefix of each set, rarest first: id, seq."""
        w = Window.partitionBy("id")
        ranked = sets.join(bounded(rarity), "seq").select(
            F.col("id").alias(name), "seq", F.row_number().over(w.orderBy("docs", "seq")).alias("rank"), F.count("*").over(w).alias("n")
        )
        return ranked.filter((F.col("n") >= least) & (F.col("rank") <= F.col("n") - least + 1)).select(name, "seq")

    pairs = prefix(owned, "item_id").join(prefix(once, "doc_id"), "seq")
    pairs = pairs.select("item_id", "doc_id").distinct()

    lengths = owned.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("item_sequences"), (F.max("pos") + 1).alias("span"))
    shared = pairs.join(hits.withColumnRenamed("id", "doc_id"), "doc_id").join(owned.select(F.col("id").alias("item_id"), "seq"), ["item_id", "seq"]).join(lengths, "item_id")
    totals = shared.groupBy("item_id", "doc_id", "item_sequences").agg(F.countDistinct("seq").alias("joint")).filter(F.col("joint") >= least)
    if windows:
        totals = totals.join(_windows(shared), ["item_id", "doc_id"])
    return totals.select("item_id", "doc_id", "joint", "item_sequences", *(["window_joint"] if windows else []))


def contained_pairs(items: DataFrame, documents: DataFrame, least: int = 8) -> DataFrame:
    return contained(items, documents, least, windows=False).select("item_id", "doc_id")

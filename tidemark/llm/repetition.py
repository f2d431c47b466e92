"""Repetition inside single documents, line first.

A text is cut into lines, and a line of more than ``LONG_LINE`` characters into its sentences, each a line then. Every line is judged by
itself: navigation (short, link marks), boilerplate (a line that many documents of the corpus carry), punctuation (long prose
without any end mark), repetition (most of its sequences of five words were said before; of a line too short for any, the line
itself). Failing lines are removed; a document that loses more than ``most_lost`` of its characters is rejected.

A sequence belongs to the line it starts in, also where it runs on over line ends; each line has the number of its sequences
and of those said before. The share that TESTDATA.md defines, over the whole text, is the sum over kept and removed lines.

Boilerplate is taken from the corpus: the lines (in lower case, without outer white space) that at least ``COMMON`` of its
documents and ``LEAST`` of them carry. There are no more of them than a thousand times the mean number of lines of a document,
which bounds what is sent to the workers.

Defined cases: null and empty texts and those of fewer than five words have no sequences and a share of null; blank lines
are neither judged nor counted; rows without an id are ignored; one row per id and text. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import hashes_at, renew, sequence_hashes, word_places
from tidemark.plans.tables import spread

WORDS, LONG, LONG_LINE = 5, 30, 200
COMMON, LEAST = 0.001, 20
LINKS = re.compile(r"[|»«›‹>→•·/]")
PARAGRAPHS = re.compile(r"\r?\n[ \t]*\r?\n")
SENTENCES = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
ENDS = tuple(".!?…:;\"'”’)]}。！？」』、")
SCHEMA = (
    "id long, n_words long, sequences long, different_sequences long, lines long, repeated_lines long, paragraphs long, "
    "repeated_paragraphs long, chars long, lost_chars long, kept_sequences long, kept_different_sequences long, "
    "kept_line_sequences long, kept_line_repeats long, lost_line_sequences long, lost_line_repeats long, boilerplate_lines long"
)


def fails(line: str, words: int) -> bool:
    """Whether a line by itself is navigation or unpunctuated prose."""
    if words == 0:
        return True
    if words > LONG and not line.endswith(ENDS):
        return True
    links = len(LINKS.findall(line))
    return links > words or words <= 8 and links >= 2


def line_hash(line: str) -> int:
    """Of a line without outer white space, as a signed number."""
    return (xxhash.xxh64_intdigest(line.lower()) + 2**63) % 2**64 - 2**63


def common_lines(documents: DataFrame, share: float = COMMON, least: int = LEAST) -> frozenset[int]:
    """Hashes of the lines that at least ``share`` and ``least`` of the documents (``id``, ``text``) carry."""
    texts = documents.filter("id is not null and text is not null").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held: list[int] = []

        def fold() -> None:
            h, n = np.unique(np.array(held, np.int64), return_counts=True)
            parts.append((h, n))
            held.clear()
            if len(parts) > 8:
                h, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in parts])).astype(np.int64)
                parts[:] = [(h, n)]

        for b in batches:
            for t in b.column(0):
                held.extend({line_hash(x) for line in t.as_py().split("\n") if (x := line.strip())})
                if len(held) > 1_000_000:
                    fold()
        fold()
        for h, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["line", "n"])

    most = max(least, share * texts.count())
    counts = texts.mapInArrow(count, "line long, n long").groupBy("line").agg(F.sum("n").alias("n")).filter(F.col("n") >= most)
    return frozenset(counts.select("line").toArrow().column("line").to_pylist())


def _lines(text: str) -> list[tuple[str, list[int], bool]]:
    """Each line without outer white space, the places of its words, and whether the same line was there before."""
    seen: dict[str, list[tuple]] = {}
    out: list[tuple] = []
    for raw in text.split("\n"):
        known = seen.get(raw)
        if known is not None:
            out += known
            continue
        line = raw.strip()
        parts = [x for x in SENTENCES.split(line) if x] if len(line) > LONG_LINE else ()
        own = [(x, word_places(x)) for x in parts] if len(parts) > 1 else [(line, word_places(line))]
        seen[raw] = [(*x, True) for x in own]
        out += [(*x, False) for x in own]
    return out


def _measure(text: str, common: frozenset[int] = frozenset()) -> tuple[int, ...]:
    renew()
    lines = _lines(text)
    whole: list[int] = []
    for _, places, _ in lines:
        whole += places
    s = sequence_hashes(hashes_at(whole), WORDS)
    total = len(s)
    if total:
        order = np.argsort(s, kind="stable")
        again = np.zeros(total, np.int64)
        again[order[1:]] = s[order[1:]] == s[order[:-1]]
        said = [0, *np.cumsum(again).tolist()]
    else:
        said = [0]
    kept: list[int] = []
    n = repeated = chars = lost = boilerplate = end = 0
    blank = False
    of_kept = repeats_kept = of_lost = repeats_lost = 0
    for line, places, before in lines:
        words = len(places)
        a, end = end, end + words
        if not line:
            blank = True
            continue
        n += 1
        repeated += before
        chars += len(line)
        of = (end if end < total else total) - a if a < total else 0
        repeats = said[a + of] - said[a] if of else 0
        known = bool(common) and line_hash(line) in common
        boilerplate += known
        if known or (2 * repeats > of if of else before) or fails(line, words):
            lost += len(line)
            of_lost += of
            repeats_lost += repeats
        else:
            of_kept += of
            repeats_kept += repeats
            kept += places
    parts = [x for x in map(str.strip, PARAGRAPHS.split(text)) if x] if blank and n > 1 else [text] * (n > 0)
    after = counts = (total, total - said[-1])
    if lost:
        k = sequence_hashes(hashes_at(kept), WORDS)
        after = (len(k), len(np.unique(k)))
    return (len(whole), *counts, n, repeated, len(parts), len(parts) - len(set(parts)), chars, lost, *after, of_kept, repeats_kept, of_lost, repeats_lost, boilerplate)


def repetition(documents: DataFrame, most_lost: float = 0.5, common: frozenset[int] | None = None) -> DataFrame:
    """One row per document (``id``, ``text``): counts, ``repeated_share`` of the whole text, ``lost_share``, ``rejected``.

    ``common`` are the boilerplate lines, those of these documents if not given.
    """
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]
    shared = documents.sparkSession.sparkContext.broadcast(common_lines(documents) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *_measure(t.as_py() or "", shared.value)) for i, t in zip(b.column(0).to_pylist(), b.column(1))]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    share = lambda part, all_: F.when(all_ > 0, part / all_)
    found = spread(documents.filter("id is not null").select(F.col("id").cast("long").alias("id"), "text")).mapInArrow(run, SCHEMA)
    c = F.col
    lost = share(c("lost_chars"), c("chars"))
    return found.select(
        "id", "n_words", "sequences", "different_sequences",
        share(c("kept_line_repeats") + c("lost_line_repeats"), c("kept_line_sequences") + c("lost_line_sequences")).alias("repeated_share"),
        share(c("repeated_lines"), c("lines")).alias("repeated_line_share"),
        share(c("repeated_paragraphs"), c("paragraphs")).alias("repeated_paragraph_share"),
        share(c("boilerplate_lines"), c("lines")).alias("boilerplate_share"),
        lost.alias("lost_share"),
        F.coalesce(lost > most_lost, F.lit(False)).alias("rejected"),
        share(c("kept_sequences") - c("kept_different_sequences"), c("kept_sequences")).alias("kept_repeated_share"),
    )


def repetitive(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """The ids of documents whose repeated share is ``least`` or more."""
    return repetition(documents).filter(F.col("repeated_share") >= least).select("id").distinct()

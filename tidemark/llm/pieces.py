"""Splitting oversized texts at natural boundaries, with an overlap.

Every position of a text has a boundary strength: after a blank line, a line, a sentence, a clause, a word, a joint; no
boundary; never (inside a line end or before a combining character). A sparse table answers which position of a window is
the strongest, the rightmost of equals. From a start, the cut is the strongest in the window of permissible lengths; the
next piece starts at the strongest boundary around ``overlap`` before the cut. Tables are built block by block, so a text of
any length needs memory for its strengths and one block.

Lengths are in characters (code points), a token being four of them, halves rounded up.

Defined cases: a null or empty text gives no piece; one within the limit is one piece; a text without any boundary is cut
at the limit; every character is in a piece; pieces are exact slices, so white space and line ends stay as they are. Carried
columns may have any name. Repeated rows are the caller's to drop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Boundaries by rising strength; a cut goes to the end of the match.
BOUNDARIES = (
    (1, re.compile(r"[-/_|]")),
    (2, re.compile(r"\s+")),
    (3, re.compile(r"[,;:]\s+|[、，；：]")),
    (4, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][」』）]*")),
    (5, re.compile(r"\r\n|\r|\n")),
    (6, re.compile(r"(?:\r?\n[ \t]*){2,}")),
)
#: Positions before these never are boundaries: combining characters, joiners, selectors.
TIED = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u093c\u093e-\u094d\u0e31\u0e34-\u0e3a\u200d\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\U0001f3fb-\U0001f3ff]|(?<=\r)\n|(?<=\u200d).", re.S)
BLOCK = 1 << 16
PLACE = 40


def strengths(text: str) -> np.ndarray:
    """The strength of a cut before each position, and at the end."""
    out = np.zeros(len(text) + 1, np.int64)
    for s, pattern in BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text)]
        out[ends] = s
    out[[m.start() for m in TIED.finditer(text)]] = -1
    return out


class RangeMaximum:
    """A sparse table over keys; ``best`` gives the greatest key of a closed range."""

    def __init__(self, keys: np.ndarray, longest: int) -> None:
        self.rows, width = [keys], 1
        while 2 * width <= min(longest, len(keys)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def best(self, low: int, high: int) -> int:
        k = (high - low + 1).bit_length() - 1
        row = self.rows[k]
        return max(int(row[low]), int(row[high - (1 << k) + 1]))


class Boundaries:
    """The strongest boundary of any window of a text, by blocks of it."""

    def __init__(self, text: str, longest: int) -> None:
        s = strengths(text)
        self.keys, self.longest, self.base, self.table = (s << PLACE) + np.arange(len(s)), longest, None, None

    def strongest(self, low: int, high: int) -> tuple[int, int]:
        """(strength, position) of the strongest boundary in a closed window, the rightmost of equals."""
        base = low // BLOCK * BLOCK
        if base != self.base:
            self.base, self.table = base, RangeMaximum(self.keys[base : base + BLOCK + self.longest], self.longest)
        key = self.table.best(low - base, high - base)
        return key >> PLACE, key & ((1 << PLACE) - 1)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; ``limit`` and ``overlap`` in characters."""
    if not text:
        return []
    n, start, out = len(text), 0, []
    if n <= limit:
        return [(0, n)]
    found = Boundaries(text, limit + 1)
    slack = overlap // 4
    while n - start > limit:
        s, end = found.strongest(start + max(limit // 2, overlap + slack + 1), start + limit)
        if s < 0:
            end = start + limit
        out.append((start, end))
        low, high = max(start + 1, end - overlap - slack), max(start + 1, end - overlap + slack)
        s, nxt = found.strongest(low, high) if overlap else (1, end)
        start = nxt if s > 0 else max(start + 1, end - overlap)
    out.append((start, n))
    return out


def characters(tokens: int) -> int:
    """The most characters that still count as so many tokens."""
    return 4 * tokens + 1


def split(df: DataFrame, text: str, carried: list[str], limit: int = 320, overlap: int = 40) -> DataFrame:
    """One row per piece: the carried columns, ``piece``, ``content``, ``token_count``, ``char_start``, ``char_end`` in the text."""
    if not 0 <= overlap * 5 // 4 < limit // 2:
        raise ValueError("the overlap must be well below half of the limit")
    own = StructType([StructField(f"p_{c}", k) for c, k in (("piece", IntegerType()), ("content", StringType()), ("tokens", IntegerType()), ("start", IntegerType()), ("end", IntegerType()))])
    rows = df.select(F.struct(*carried).alias("carried"), F.col(text).cast("string").alias("text"))
    out = StructType([rows.schema["carried"], *own.fields])
    kinds = to_arrow_schema(own)
    most, back = characters(limit), 4 * overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                of, cols = [], []
                for i, t in enumerate(b.column(1)):
                    t = t.as_py()
                    for k, (lo, hi) in enumerate(pieces(t, most, back) if t else ()):
                        of.append(i)
                        cols.append((k, t[lo:hi], (hi - lo + 2) // 4, lo, hi))
                made = [pa.array(c, f.type) for c, f in zip(zip(*cols) if cols else [()] * 5, kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *made], ["carried", *kinds.names])

    found = rows.mapInArrow(run, out)
    return found.select(*(F.col("carried")[c].alias(c) for c in carried), F.col("p_piece").alias("piece"), F.col("p_content").alias("content"), F.col("p_tokens").alias("token_count"), F.col("p_start").alias("char_start"), F.col("p_end").alias("char_end"))

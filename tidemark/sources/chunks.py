"""Windows over segments: at most so many tokens, ended at a natural break in their last quarter, with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_TOKENS, OVERLAP_TOKENS, CHARS = 320, 40, 4
#: Breaks in order of preference. Fixed values.
BREAKS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
SCHEMA = "chunk int, content string, token_count int, char_start int, char_end int"


def windows(text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Iterator[tuple[int, int]]:
    """(start, end) of each window; blank ones are left out but still advance."""
    width, start, n = max(16, max_tokens * CHARS), 0, len(text)
    overlap = overlap_tokens * CHARS if overlap_tokens * CHARS < width else width // 8
    while start < n:
        end = n
        if n - start > width:
            ends = ((text.rfind(b, start, start + width), len(b)) for b in BREAKS)
            end = next((at + size for at, size in ends if at >= start + width * 3 // 4), start + width)
        if text[start:end].strip():
            yield start, end
        if end == n:
            return
        resume = end
        if 0 < overlap < end - start:
            resume = end - overlap
            gaps = [g for b in " \n" if (g := text.find(b, resume, end)) >= 0]
            # near enough in bytes: a word boundary reads better than the exact overlap
            if gaps and len(text[resume : min(gaps)].encode()) < 32:
                resume = min(gaps) + 1
        start = resume if resume > start else end


def chunk(df: DataFrame, text: str, carried: list[str], max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """One row per window: the carried columns and ``SCHEMA``; null and blank texts have none."""
    rows = df.select(F.struct(*carried).alias("c"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, cols = [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py() or ""
                for k, (lo, hi) in enumerate(windows(t, max_tokens, overlap_tokens)):
                    of.append(i)
                    cols.append((k, t[lo:hi], max(1, (hi - lo + 2) // 4), lo, hi))
            made = list(zip(*cols)) or [()] * 5
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *(pa.array(c, k) for c, k in zip(made, kinds))], ["c", "chunk", "content", "token_count", "char_start", "char_end"])

    out = rows.mapInArrow(run, StructType([rows.schema["c"], *StructType.fromDDL(SCHEMA).fields]))
    taken = {"chunk", "content", "token_count", "char_start", "char_end"} & set(carried)
    if taken:
        raise ValueError(f"carried columns clash with the result's: {sorted(taken)}")
    return out.select(*(F.col("c")[c].alias(c) for c in carried), "chunk", "content", "token_count", "char_start", "char_end")

"""Encoding texts with a public byte-level BPE vocabulary.

Forced boundaries: a pair of bytes that stands inside no vocabulary token can't be inside any merge, so a token ends
between them for certain. Texts are cut at such pairs, the fragments are encoded independently (equal ones once per
worker while its cache holds them) and the ids concatenated. Beside the pair, a cut must leave the words of the
pre-tokenizer as they are: the character before isn't white space (its runs look ahead) and the one after isn't an
apostrophe (contractions look at what precedes by position only). Between other characters a run of letters, digits or
marks is just cut in two, where the merges end anyway.

Defined cases: null and empty texts have an empty list; the strings of special tokens are ordinary text; one row per row
of the input. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.tables import spread

FOLDER = "/opt/tokenizers"
LENGTH = 512
#: How texts of this vocabulary are split into words before the merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space characters. Fixed values.
SPACES = tuple(chr(c).encode() for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


class Encoder:
    def __init__(self, file: str, length: int = LENGTH) -> None:
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.length = length
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        inside = bytearray(1 << 16)
        for token in ranks:
            for pair in zip(token, token[1:]):
                inside[pair[0] << 8 | pair[1]] = 1
        self.inside = bytes(inside)
        self.cache: dict[bytes, np.ndarray] = {}

    def next_cut(self, b: bytes, at: int) -> int:
        """The first position from ``at`` on where a text may be cut for certain; its end if there is none."""
        inside, n = self.inside, len(b)
        for i in range(at, n):
            c = b[i]
            # a pair inside no token, at the start of a character other than the apostrophe, not after white space
            if not inside[b[i - 1] << 8 | c] and c & 0xC0 != 0x80 and c != 39 and not b[max(0, i - 3) : i].endswith(SPACES):
                return i
        return n

    def fragments(self, b: bytes) -> list[bytes]:
        """A text's bytes in order, in pieces of ``length`` or a little more where it can be cut."""
        at, out, n = 0, [], len(b)
        while n - at > self.length:
            end = self.next_cut(b, at + self.length)
            out.append(b[at:end])
            at = end
        if at < n:
            out.append(b[at:])
        return out

    def array(self, text: str | None) -> np.ndarray:
        parts = []
        for f in self.fragments((text or "").encode()):
            known = self.cache.get(f)
            if known is None:
                known = self.encoding.encode_to_numpy(f.decode(), disallowed_special=()).astype(np.int32)
                if len(self.cache) >= 4096:
                    self.cache.clear()
                self.cache[f] = known
            parts.append(known)
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def ids(self, text: str | None) -> list[int]:
        return self.array(text).tolist()


@lru_cache(maxsize=2)
def encoder(file: str, length: int = LENGTH) -> Encoder:
    return Encoder(file, length)


def encoded(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``id`` and ``ids`` of each document (``id``, ``text``)."""
    file = os.path.join(folder, vocabulary + ".tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                lists = [enc.array(t.as_py()) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, lists)])
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    rows = documents.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "id long, ids array<int>")

"""Words and word sequences that compare alike across case, Unicode form and invisible characters."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import xxhash

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_format: set[str] = set()


class _Words(dict):
    """word -> its place in ``table``, which holds a 64-bit hash for each."""

    def __init__(self) -> None:
        self.table = np.empty(1 << 16, np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.empty(n, np.uint64)])
        self.table[n] = xxhash.xxh64_intdigest(word)
        return n


_known = _Words()


def folded(text: str) -> str:
    """Without format characters, in compatibility form, without case."""
    if text.isascii():
        return text.lower()
    if not _format:
        _format.update(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")
    if not text.isprintable():  # as no text with a format character is
        for c in _format.intersection(text):
            text = text.replace(c, "")
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def word_places(text: str) -> list[int]:
    """The place of each word, in order; places hold until ``renew``."""
    return list(map(_known.__getitem__, WORD.findall(folded(text))))


def hashes_at(places: list[int]) -> np.ndarray:
    return _known.table[np.array(places, dtype=np.int64)] if places else np.empty(0, np.uint64)


def renew(most: int = 500_000) -> None:
    """Forget all words once there are too many; called between texts."""
    global _known
    if len(_known) > most:
        _known = _Words()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    renew()
    return hashes_at(word_places(text))


def sequence_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, in order; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _FACTOR + words[i : i + n]
    h ^= h >> np.uint64(29)
    return (h * _FACTOR).view(np.int64)

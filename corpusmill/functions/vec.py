"""Text as arrays of code points: the vectorised base of the Python-side operators.

A batch of strings becomes one array of code points and the offsets of its texts, so that
a pandas UDF spends its time in numpy loops over the batch, not in Python loops over rows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

_MAX = sys.maxunicode + 1
#: No letter or digit lies beyond.
_LETTERS_END = 0x33480
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def lower_table() -> np.ndarray:
    """Code point -> its lower-case code point where that is a single one."""
    table = np.arange(_MAX, dtype=np.uint32)
    for c in range(_LETTERS_END):
        if not 0xD800 <= c <= 0xDFFF:
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
    return table


@functools.cache
def letter_table() -> np.ndarray:
    table = np.zeros(_MAX, dtype=bool)
    for c in range(_LETTERS_END):
        if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha():
            table[c] = True
    return table


@functools.cache
def word_table() -> np.ndarray:
    """True for letters, digits (categories L and N) and the underscore."""
    table = np.zeros(_MAX, dtype=bool)
    for c in range(_LETTERS_END):
        if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] in "LN":
            table[c] = True
    table[ord("_")] = True
    return table


def pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of len(texts) + 1 entries)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def lengths(texts: Iterable[str | None]) -> np.ndarray:
    """Characters of each text; 0 for null."""
    return np.array([len(t) if isinstance(t, str) else 0 for t in texts], dtype=np.int64)


def slices(lengths: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive texts with at most `most` characters together; a longer text stands alone."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    a, n = 0, len(lengths)
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def owner(offsets: np.ndarray) -> np.ndarray:
    """For every code point, the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    if not len(flag):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < len(flag))]
    before = np.concatenate([[False], flag[:-1]])
    before[inner] = False
    after = np.concatenate([flag[1:], [False]])
    after[inner - 1] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * int(_PRIME) % 2**64
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span, the same wherever the span stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    first = np.repeat(np.cumsum(length) - length, length)
    place = np.arange(total) - first
    index = np.repeat(starts, length) + place
    longest = int(length.max())
    size = 64
    while size < longest:
        size *= 2
    value = (codes[index].astype(np.uint64) + np.uint64(1)) * _powers(size)[place]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))


def hash_word(word: str) -> int:
    codes, offsets = pack([word])
    return int(span_hashes(codes, offsets[:1], offsets[1:])[0])


def hash_words(words: list[str]) -> np.ndarray:
    codes, offsets = pack(words)
    return span_hashes(codes, offsets[:-1], offsets[1:])

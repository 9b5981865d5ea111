"""Language of texts and of the segments of mixed texts, by rank-order n-gram profiles.

Each language has a profile: its most frequent letter n-grams (n = 1 to 3, words padded with
a blank) in order of frequency. A segment's n-grams are ranked in the same way; the distance
to a profile is the mean of how far each n-gram is out of its place, an n-gram that the
profile lacks counting the profile's length. The nearest profile wins; the confidence follows
from how far the second one lies behind.

Profiles are fitted on the labelled sample table (a few sentences per language; the table is
fixed in size). A profile holds at most PROFILE_SIZE n-grams, so what is sent to the executors
is bounded, whatever the size of the corpus.

`Trigrams` is a coarser and much faster scorer for operators that only need to know whether
two texts are written in the same language.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import vec

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: n-grams kept in a language's profile.
PROFILE_SIZE = 1500
#: n-grams of a segment that are ranked.
SEGMENT_TOP = 300
#: Rows of the sample table that are read at most to fit the first profiles.
SAMPLE_ROWS = 100_000


@dataclasses.dataclass(frozen=True)
class Profiles:
    names: tuple[str, ...]  # one per profile: language and script, as "uz-Cyrl"
    grams: np.ndarray  # uint64, sorted; all n-grams of any profile
    ranks: np.ndarray  # float32 [grams, profiles]; PROFILE_SIZE where lacking

    @property
    def languages(self) -> list[str]:
        return [x.split("-")[0] for x in self.names]


def _grams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, number of its text) of all texts: 21 bits a letter, blank-padded words."""
    low = vec.lower_table()[codes]
    letter = vec.letter_table()[low] | (low == 0x27) | (low == 0x2019) | (low == 0x2018) | (low == 0x2BB) | (low == 0x2BC)
    low = np.where((low == 0x2019) | (low == 0x2018) | (low == 0x2BB) | (low == 0x2BC), 0x27, low)
    starts, ends = vec.runs(letter, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    length = ends - starts
    own = vec.owner(offsets)[starts]
    # each word with a blank before and after it, one behind the other
    padded = length + 2
    base = np.cumsum(padded) - padded
    seq = np.full(int(padded.sum()), 0x20, dtype=np.uint64)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    seq[np.repeat(base + 1, length) + place] = low[np.repeat(starts, length) + place]
    who = np.repeat(own, padded)
    word = np.repeat(np.arange(len(padded)), padded)
    out_g, out_w = [], []
    one = seq != 0x20
    out_g.append(seq[one]), out_w.append(who[one])
    two = (seq[:-1] << np.uint64(21)) | seq[1:]
    same = word[:-1] == word[1:]
    out_g.append(two[same]), out_w.append(who[:-1][same])
    three = (seq[:-2] << np.uint64(42)) | (seq[1:-1] << np.uint64(21)) | seq[2:]
    same = word[:-2] == word[2:]
    out_g.append(three[same]), out_w.append(who[:-2][same])
    return np.concatenate(out_g), np.concatenate(out_w)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: (text number, n-gram, count), sorted by both."""
    codes, offsets = vec.pack(texts)
    g, w = _grams(codes, offsets)
    order = np.lexsort((g, w))
    g, w = g[order], w[order]
    if not len(g):
        return w, g, np.empty(0, np.int64)
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
    at = np.flatnonzero(new)
    return w[at], g[at], np.diff(np.concatenate([at, [len(g)]]))


def _profiles(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Profiles:
    """counts: for each profile, n-grams and how often they occur."""
    names = tuple(sorted(counts))
    kept = {}
    for name in names:
        g, n = counts[name]
        top = np.lexsort((g, -n))[:PROFILE_SIZE]
        kept[name] = g[top]
    grams = np.unique(np.concatenate([kept[x] for x in names])) if names else np.empty(0, np.uint64)
    ranks = np.full((len(grams), len(names)), PROFILE_SIZE, dtype=np.float32)
    for j, name in enumerate(names):
        ranks[np.searchsorted(grams, kept[name]), j] = np.arange(len(kept[name]))
    return Profiles(names, grams, ranks)


def fit(samples: DataFrame, language: str = "language", script: str = "script", text: str = "text") -> Profiles:
    """Profiles from labelled sentences; reads SAMPLE_ROWS rows at most (the table is small and fixed)."""
    rows = samples.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(language, script, text).limit(SAMPLE_ROWS).toPandas().sort_values([language, script, text])
    counts = {}
    for (lang, scr), part in rows.groupby([language, script]):
        _, g, n = _counted([" ".join(part[text])])
        counts[f"{lang}-{scr}"] = (g, n)
    return _profiles(counts)


@functools.lru_cache(maxsize=4)
def _table(grams: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 2^16 slots the n-gram and its number, and whether several n-grams fall on the slot."""
    own = np.frombuffer(grams, np.uint64)
    slot = ((own * _SPREAD) >> np.uint64(48)).astype(np.int64)
    gram, number = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
    gram[slot], number[slot] = own, np.arange(len(own))
    return gram, number, np.bincount(slot, minlength=1 << 16) > 1


def _numbers(g: np.ndarray, grams: np.ndarray, gram: np.ndarray, number: np.ndarray, several: np.ndarray) -> np.ndarray:
    """The number of every n-gram: its place in `grams`, or behind all of them by 20 bits of a hash."""
    spread = g * _SPREAD
    slot = (spread >> np.uint64(48)).astype(np.int64)
    out = np.where(gram[slot] == g, number[slot], len(grams) + ((spread >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64))
    doubt = np.flatnonzero(several[slot])
    at = np.minimum(np.searchsorted(grams, g[doubt]), len(grams) - 1)
    found = grams[at] == g[doubt]
    out[doubt[found]] = at[found]
    return out


def distances(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(mean out-of-place distance [texts, profiles] in 0..1, n-grams ranked per text).

    An n-gram of a profile has its number; others are told apart by 20 bits of a hash, which may take two
    of a text's for one. So text, count and n-gram fit in 64 bits, and both sorts are of plain integers."""
    k = len(profiles.names)
    codes, offsets = vec.pack(texts)
    g, w = _grams(codes, offsets)
    if not len(g):
        return np.ones((len(texts), k)), np.zeros(len(texts), np.int64)
    size = len(profiles.grams)
    number = _numbers(g, profiles.grams, *_table(profiles.grams.tobytes()))
    pairs = np.sort((w.astype(np.int64) << 22) | number)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    n = np.diff(np.concatenate([first, [len(pairs)]]))
    w, number = pairs[first] >> 22, pairs[first] & ((1 << 22) - 1)
    order = np.argsort((w << 32) | (np.maximum(1023 - n, 0) << 22) | number, kind="stable")
    w, number = w[order], number[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    length = np.diff(np.concatenate([start, [len(w)]]))
    rank = np.arange(len(w)) - np.repeat(start, length)
    keep = rank < SEGMENT_TOP
    w, number, rank = w[keep], number[keep], rank[keep]
    ranks = np.vstack([profiles.ranks, np.full((1, k), PROFILE_SIZE, np.float32)])
    place = ranks[np.minimum(number, size)]
    out = np.minimum(np.abs(place - rank[:, None].astype(np.float32)), PROFILE_SIZE) / PROFILE_SIZE
    out[place >= PROFILE_SIZE] = 1.0
    used = np.bincount(w, minlength=len(texts))
    total = np.zeros((len(texts), k))
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    total[w[first]] = np.add.reduceat(out.astype(np.float64), first, axis=0)
    return total / np.maximum(used, 1)[:, None], used


def identify(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into sorted distinct languages or -1 where there is no letter, confidence, distances by language)."""
    d, used = distances(texts, profiles)
    langs = sorted(set(profiles.languages))
    by = np.stack([d[:, [i for i, x in enumerate(profiles.languages) if x == lang]].min(axis=1) for lang in langs], axis=1)
    best = by.argmin(axis=1)
    two = np.sort(by, axis=1)
    lead = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9) if by.shape[1] > 1 else np.ones(len(by))
    confidence = 1.0 / (1.0 + np.exp(-(lead - 0.02) * 60.0))
    return np.where(used > 0, best, -1), np.where(used > 0, confidence, 0.0), by


class Trigrams:
    """Hashed letter trigrams with their log-probabilities by language; one pass of numpy over a batch."""

    BITS = 16

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def _hashed(cls, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets = vec.pack(texts)
        low = vec.lower_table()[codes]
        letter = vec.letter_table()[low]
        low = np.where(letter, low, 0x20).astype(np.uint32)
        if len(low) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = (low[:-2] * np.uint32(0x85EBCA6B)) ^ (low[1:-1] * np.uint32(0xC2B2AE35)) ^ (low[2:] * np.uint32(0x27D4EB2F))
        who = vec.owner(offsets)
        keep = letter[1:-1] & (who[:-2] == who[2:])
        return (h[keep] >> np.uint32(32 - cls.BITS)).astype(np.int64), who[:-2][keep]

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> "Trigrams":
        names = sorted(set(languages))
        table = np.full((1 << cls.BITS, len(names)), 0.05, dtype=np.float64)
        for j, name in enumerate(names):
            h, _ = cls._hashed([" ".join(t for t, x in zip(texts, languages) if x == name)])
            table[:, j] += np.bincount(h, minlength=1 << cls.BITS)
        return cls(names, np.log(table / table.sum(axis=0)).astype(np.float32))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-probability [texts, languages], trigrams per text)."""
        h, who = self._hashed(texts)
        n = np.bincount(who, minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            total[who[first]] = np.add.reduceat(self.table[h], first, axis=0)
        return total / np.maximum(n, 1)[:, None], n

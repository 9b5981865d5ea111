"""A linear classifier over hashed words, word pairs and character 4-grams, in numpy.

Texts are compared in one lower-case form that the caller makes (`cues.plain`), the same for training
and for scoring. The model is a table of 2^BITS weights per class, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np

from corpusmill.functions import vec

BITS = 16
#: Features that a text counts as having beside its own, so that one word alone says little.
SMOOTH = 20
#: Features from which a text counts by their mean: a very long one is no surer than a long one.
LONG = 200


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number): hashed words, pairs of neighbouring words, and 4-grams of the words with a blank on both sides."""
    codes, offsets = vec.pack(texts)
    low = vec.lower_table()[codes]
    starts, ends = vec.runs(vec.letter_table()[low] | (low == 0x27) if len(low) else np.empty(0, bool), offsets)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    length = ends - starts
    own = np.searchsorted(offsets, starts, "right") - 1
    shift = np.uint64(64 - BITS)
    words = vec.span_hashes(low, starts, ends)
    pairs = vec.mix(words[:-1] * np.uint64(31) + words[1:])
    near = own[:-1] == own[1:]
    # the words one behind the other, each with a blank before and after it
    padded = length + 2
    base = np.cumsum(padded) - padded
    seq = np.full(int(padded.sum()), 0x20, dtype=np.uint32)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    seq[np.repeat(base + 1, length) + place] = low[np.repeat(starts, length) + place]
    word = np.repeat(np.arange(len(padded)), padded)
    four = (seq[:-3] * np.uint32(0x85EBCA6B)) ^ (seq[1:-2] * np.uint32(0xC2B2AE35)) ^ (seq[2:-1] * np.uint32(0x27D4EB2F)) ^ (seq[3:] * np.uint32(0x165667B1))
    inside = word[:-3] == word[3:]
    grams = (four[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    feature = np.concatenate([(words >> shift).astype(np.int64), (pairs[near] >> shift).astype(np.int64), grams.astype(np.int64)])
    return feature, np.concatenate([own, own[:-1][near], own[word[:-3][inside]]])


def _scale(n: np.ndarray) -> np.ndarray:
    """What the sum of the weights of `n` features is multiplied by."""
    return 1 / (np.sqrt(n + SMOOTH) * np.maximum(1.0, np.sqrt(n / LONG)))


class Linear:
    """One logistic model per class; weights [2^BITS, classes] of the texts' features and [columns, classes] of further ones."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, further: np.ndarray | None = None):
        self.weights, self.bias = np.ascontiguousarray(weights.T, dtype=np.float32), bias
        self.further = further

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-odds [texts, classes], by the texts' features alone."""
        k = len(self.bias)
        out = np.zeros((len(texts), k))
        for a, b in vec.slices(np.fromiter(map(len, texts), np.int64, len(texts))):
            f, own = features(texts[a:b])
            n = _scale(np.bincount(own, minlength=b - a))
            for j in range(k):
                out[a:b, j] = np.bincount(own, weights=self.weights[j][f], minlength=b - a) * n + self.bias[j]
        return out


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, further: np.ndarray | None = None, steps: int = 80, rate: float = 0.1, l2: float = 1e-6) -> Linear:
    """labels, hard or soft, and weights of the texts, both [texts, classes]; `further` features [texts, columns]; full-batch Adam on the weighted log-loss.

    Features of one text only are left out: what was seen once tells nothing about other texts."""
    f, own = features(texts)
    n, k = len(texts), labels.shape[1]
    x = np.zeros((n, 0)) if further is None else further
    table, bias, outer = np.zeros((1 << BITS, k)), np.full(k, -3.0), np.zeros((x.shape[1], k))
    if not n:
        return Linear(table, bias, outer)
    scale = _scale(np.bincount(own, minlength=n))
    once = np.unique(f * n + own)
    f, own = once // n, once % n
    often = np.bincount(f, minlength=1 << BITS)[f] > 1
    f, own = f[often], own[often]
    used, first = np.unique(f, return_index=True)
    f = np.repeat(np.arange(len(used)), np.diff(np.append(first, len(f))))
    # the same pairs once in the order of features, for the gradient, and once in that of texts, for the scores
    by_text = np.argsort(own, kind="stable")
    f_by_text, spoken = f[by_text], np.unique(own)
    starts = np.searchsorted(own[by_text], spoken)
    for j in range(k):
        y, c = labels[:, j], weights[:, j] / max(weights[:, j].sum(), 1e-9)
        p = [np.zeros(len(used)), np.zeros(x.shape[1]), np.full(1, -1.0)]
        m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, steps + 1):
            z = x @ p[1] + p[2]
            if len(used):
                z[spoken] += np.add.reduceat(p[0][f_by_text], starts) * scale[spoken]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * c
            grads = [(np.add.reduceat((error * scale)[own], first) if len(used) else p[0]) + l2 * p[0], x.T @ error + l2 * p[1], error.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-9)
        table[used, j], outer[:, j], bias[j] = p[0], p[1], p[2][0]
    return Linear(table, bias, outer)

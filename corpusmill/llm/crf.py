"""A linear-chain conditional random field in numpy: batched training and decoding.

Small on purpose: a few dozen features and a handful of tags, so that a model is a few kilobytes,
is trained on the driver in seconds from a bounded sample, and is sent with the task.
"""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class CRF:
    emit: np.ndarray  # [features, tags]
    trans: np.ndarray  # [tags, tags]
    start: np.ndarray
    end: np.ndarray

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of sequences that stand one behind the other in x [items, features]."""
        if not len(x):
            return np.empty(0, np.int64)
        score = x @ self.emit
        n, k = len(lengths), self.emit.shape[1]
        longest = int(lengths.max())
        first = np.cumsum(lengths) - lengths
        best = np.zeros((n, k))
        back = np.zeros((longest, n, k), dtype=np.int8)
        for t in range(longest):
            live = lengths > t
            now = score[first[live] + t]
            if t == 0:
                best[live] = now + self.start
            else:
                step = best[live][:, :, None] + self.trans[None]
                back[t][live] = step.argmax(axis=1)
                best[live] = step.max(axis=1) + now
        tags = np.zeros(len(x), dtype=np.int64)
        last = (best + self.end).argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = np.flatnonzero(lengths > t)
            tags[first[live] + t] = last[live]
            if t:
                last[live] = back[t][live, last[live]]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(x: np.ndarray, tags: np.ndarray, lengths: np.ndarray, k: int, l2: float = 1e-3, steps: int = 200, rate: float = 0.15) -> CRF:
    """Adam on the mean log-likelihood; sequences stand one behind the other, as in `decode`."""
    n, longest, f = len(lengths), int(lengths.max()), x.shape[1]
    first = np.cumsum(lengths) - lengths
    at = np.minimum(first[:, None] + np.arange(longest), len(x) - 1)
    mask = np.arange(longest) < lengths[:, None]
    X, Y = x[at], tags[at]
    hot = np.eye(k)[Y] * mask[:, :, None]
    pair = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    seen_emit = np.einsum("ntf,ntk->fk", X * mask[:, :, None], hot)
    ends = hot[np.arange(n), lengths - 1].sum(axis=0)
    p = [np.zeros((f, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        score = X @ p[0]
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = score[:, 0] + p[2]
        for t in range(1, longest):
            new = _logsum(alpha[:, t - 1][:, :, None] + p[1][None], 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t][:, None], new, alpha[:, t - 1])
        z = _logsum(alpha[:, -1] + p[3], 1)
        beta[:, -1] = p[3]
        for t in range(longest - 2, -1, -1):
            new = _logsum(p[1][None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1][:, None], new, beta[:, t + 1])
        post = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        two = np.exp(alpha[:, :-1, :, None] + p[1][None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grad = [np.einsum("ntf,ntk->fk", X, post) - seen_emit, two.sum(axis=(0, 1)) - pair, post[:, 0].sum(axis=0) - hot[:, 0].sum(axis=0), post[np.arange(n), lengths - 1].sum(axis=0) - ends]
        for i in range(4):
            g = grad[i] / n + l2 * p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return CRF(*p)

"""Curve statistics of many resamples at once: a row of multiplicities per resample, sums along sorted scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def multiplicities(b: np.ndarray, sample: np.ndarray, w: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(resamples, matrix resample x sample) of the draws of ``samples``, which are sorted; other samples' draws don't count."""
    numbers, row = np.unique(b, return_inverse=True)
    out = np.zeros((len(numbers), len(samples)))
    at = np.minimum(np.searchsorted(samples, sample), max(0, len(samples) - 1))
    known = samples[at] == sample if len(samples) else np.zeros(len(sample), dtype=bool)
    out[row[known], at[known]] = w[known]
    return numbers, out


class Prepared:
    """One group's samples in the orders that its statistics need, so that a resample costs gathers and sums and no sort."""

    def __init__(self, score: np.ndarray, y: np.ndarray, pred: np.ndarray):
        self.one, self.zero = (k[np.argsort(score[k], kind="stable")] for k in (np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]))
        s1, s0 = score[self.one], score[self.zero]
        self.low, self.high = np.searchsorted(s1, s0, "left"), np.searchsorted(s1, s0, "right")
        r1, r0 = 1 - s1, 1 - s0  # falling
        self.first = np.nonzero(np.concatenate([[True], r0[1:] != r0[:-1]]))[0] if len(r0) else np.empty(0, dtype=int)
        self.ahead = len(r1) - np.searchsorted(r1[::-1], r0[self.first], "left")
        self.hit1, self.hit0 = (pred[self.one] == 1).astype(float), (pred[self.zero] == 0).astype(float)

    def statistics(self, weights: np.ndarray, names: Sequence[str]) -> dict[str, np.ndarray]:
        """Of each row of multiplicities: what auc(), average_precision() of class 0 and balanced_accuracy() have."""
        w1, w0, out = weights[:, self.one], weights[:, self.zero], {}
        n1, n0 = w1.sum(1), w0.sum(1)
        through = np.zeros((len(weights), len(self.one) + 1))
        np.cumsum(w1, axis=1, out=through[:, 1:])
        if "roc_auc" in names:
            out["roc_auc"] = _ratio((w0 * (n1[:, None] - (through[:, self.low] + through[:, self.high]) / 2)).sum(1), n1 * n0)
        if "ap_normal" in names:
            p = np.add.reduceat(w0, self.first, axis=1) if len(self.first) else w0
            tp, fp = np.cumsum(p, axis=1), through[:, self.ahead]
            out["ap_normal"] = _ratio((p * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)).sum(1), n0)
        if "balanced_accuracy" in names:
            out["balanced_accuracy"] = (_ratio(w1 @ self.hit1, n1) + _ratio(w0 @ self.hit0, n0)) / 2
        return out


def _by_score(score: np.ndarray, weights: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of positives and of negatives at each distinct score, rising."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    first = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
    w, p = weights[:, order], positive[order]
    return np.add.reduceat(w * p, first, axis=1), np.add.reduceat(w * ~p, first, axis=1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast_shapes(a.shape, b.shape), np.nan), where=b > 0)


def auc(score: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each resample; NaN without both classes."""
    p, n = _by_score(score, weights, y == 1)
    below = np.cumsum(n, axis=1) - n
    return _ratio((p * (below + n / 2)).sum(1), p.sum(1) * n.sum(1))


def average_precision(score: np.ndarray, y: np.ndarray, weights: np.ndarray, positive: int = 1) -> np.ndarray:
    """Of each resample, with 1 - score for class 0; NaN without positives."""
    p, n = _by_score(score if positive == 1 else 1 - score, weights, y == positive)
    p, n = p[:, ::-1], n[:, ::-1]
    tp, fp = np.cumsum(p, axis=1), np.cumsum(n, axis=1)
    precision = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
    return _ratio((p * precision).sum(1), p.sum(1))


def balanced_accuracy(pred: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each resample; NaN without both classes."""
    share = lambda k: _ratio((weights * ((y == k) & (pred == k))).sum(1), (weights * (y == k)).sum(1))
    return (share(1) + share(0)) / 2


def nullable(x: np.ndarray) -> pa.Array:
    """Doubles, null where NaN."""
    return pa.array(x, pa.float64(), mask=np.isnan(x))

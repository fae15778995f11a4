"""What follows from a released dyadic tree of counts: consistent counts, distribution, mean, quantiles.

Nodes are numbered from 1 (the root) with children 2i and 2i + 1; arrays have node i at place i and nothing at 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def rounded(noisy: Sequence[float]) -> np.ndarray:
    """Whole counts, halves to even, none below zero."""
    return np.maximum(np.round(np.asarray(noisy, float)), 0.0)


def _weight(own: float, left: float, right: float) -> float:
    """Share of an estimate of variance ``own`` beside one of the variance left + right."""
    return (left + right) / (own + left + right) if own + left + right > 0 else 1.0


def consistent(noisy: Sequence[float], n: float, sigma: float) -> dict[str, np.ndarray]:
    """Estimates from below, from above and from both, with their weights and standard errors; the root is n, exactly.

    Upwards, a node's own count is weighed with the sum of its children; downwards, with its parent less its sibling; both
    by inverse variance. Counts below zero become zero after each sweep.
    """
    x = np.concatenate([[np.nan], np.asarray(noisy, float)])
    size = len(x)
    first = (size + 1) // 2 if size > 2 else 1
    below, se_below, w_below = x.copy(), np.full(size, float(sigma)), np.full(size, np.nan)
    for i in range(first - 1, 1, -1):
        w = w_below[i] = _weight(sigma**2, se_below[2 * i] ** 2, se_below[2 * i + 1] ** 2)
        below[i] = w * x[i] + (1 - w) * (below[2 * i] + below[2 * i + 1])
        se_below[i] = sigma * w**0.5
    below = np.maximum(below, 0.0)
    above, se_above, w_above = np.full(size, np.nan), np.full(size, np.nan), np.full(size, np.nan)
    both, w_both, se_both = np.full(size, np.nan), np.full(size, np.nan), np.full(size, np.nan)
    above[1], se_above[1], both[1], se_both[1] = n, 0.0, n, 0.0
    for i in range(2, size):
        p, s = i // 2, i ^ 1
        w = w_above[i] = _weight(sigma**2, se_above[p] ** 2, se_below[s] ** 2)
        above[i] = w * x[i] + (1 - w) * (above[p] - below[s])
        se_above[i] = sigma * w**0.5
    above = np.fmax(above, 0.0)
    for i in range(2, size):
        p, s = i // 2, i ^ 1
        w = w_both[i] = _weight(se_below[i] ** 2, se_above[p] ** 2, se_below[s] ** 2)
        both[i] = w * below[i] + (1 - w) * (above[p] - below[s])
        se_both[i] = sigma * w**0.5
    both = np.fmax(both, 0.0)
    return {"below": below, "above": above, "efficient": both, "se_below": se_below, "se_above": se_above, "se_efficient": se_both, "w_below": w_below, "w_above": w_above, "w_efficient": w_both}


def efficient(noisy: Sequence[float], n: float, sigma: float) -> np.ndarray:
    """Whole counts of all nodes from 1 on, after both sweeps."""
    return np.round(consistent(noisy, n, sigma)["efficient"][1:])


def cdf(terminal: Sequence[float], low: float, high: float, gran: float) -> list[tuple[float, float]]:
    """(value, share up to it) at the true upper edges of the terminal nodes, each two steps wide, cut off at the range's end."""
    total, run = float(sum(terminal)), 0.0
    out = [(float(low), 0.0)]
    for i, c in enumerate(terminal):
        run += c
        out.append((min(low + 2.0 * gran * (i + 1), float(high)), run / total if total > 0 else 0.0))
    return out


def mean(points: Sequence[tuple[float, float]]) -> float:
    return sum((b[1] - a[1]) * b[0] for a, b in zip(points, points[1:]))


def percentiles(points: Sequence[tuple[float, float]], ps: Sequence[float]) -> list[float]:
    """For each share the value whose share is nearest; of several the mean."""
    out = []
    for p in ps:
        gap = [abs(p - q) for _, q in points]
        near = [v for (v, _), g in zip(points, gap) if g == min(gap)]
        out.append(sum(near) / len(near))
    return out


def median(points: Sequence[tuple[float, float]]) -> float:
    return percentiles(points, [0.5])[0]

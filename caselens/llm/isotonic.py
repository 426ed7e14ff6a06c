"""Isotonic calibration from binned sums, so the fit's size does not depend on the rows."""

from __future__ import annotations

import numpy as np

BINS = 4096


def bin_of(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((raw - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)


def pool(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The monotone level of every bin: adjacent violators are pooled; empty bins take the mean of what is around them."""
    blocks: list[list[float]] = []  # positive, total, first bin, last bin
    for i in np.flatnonzero(total > 0):
        blocks.append([positive[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _, last = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += t
            blocks[-1][3] = last
    if not blocks:
        return np.full(len(total), 0.5)
    at = np.array([(b[2] + b[3]) / 2 for b in blocks])
    # One pseudo-count of either label keeps levels inside (0, 1).
    level = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])
    return np.interp(np.arange(len(total)), at, np.maximum.accumulate(level))

"""Level sets of triangular patterns, whole levels at a time."""

from __future__ import annotations

import numpy as np


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The indices of several ranges, one after another."""
    sizes = ends - starts
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def levels_of(rows: np.ndarray, needs: np.ndarray, n: int) -> np.ndarray:
    """Level of each of n rows, where rows[k] needs the result of needs[k]: one more than the highest level needed."""
    level, waits = np.zeros(n, np.int64), np.bincount(rows, minlength=n)
    order = np.argsort(needs, kind="stable")
    readers, ptr = rows[order], np.searchsorted(needs[order], np.arange(n + 1))
    front, k = np.flatnonzero(waits == 0), 0
    while len(front):
        level[front] = k
        ready, served = np.unique(readers[spans(ptr[front], ptr[front + 1])], return_counts=True)
        waits[ready] -= served
        front, k = ready[waits[ready] == 0], k + 1
    return level


def recommended(level: np.ndarray) -> bool:
    """Whether more than nine tenths of the rows are in levels of more than twelve rows."""
    sizes = np.bincount(level) if len(level) else np.zeros(1, np.int64)
    return bool(len(level)) and int(sizes[sizes > 12].sum()) > 0.9 * len(level)

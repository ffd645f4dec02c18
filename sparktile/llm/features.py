"""Vectorised text features over slices of Arrow batches."""

from __future__ import annotations

import numpy as np


def class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


def lengths_of(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


class Counted:
    """A slice of texts as one buffer; counts of byte classes by document."""

    def __init__(self, texts: list[bytes]):
        sizes = lengths_of(texts)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.sizes, self.buffer = sizes, np.frombuffer(b"".join(texts), np.uint8)

    def count(self, table: np.ndarray) -> np.ndarray:
        return sums_between(table[self.buffer], self.starts, self.ends)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))

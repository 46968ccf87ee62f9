"""Hashed character n-grams of a text as numpy arrays; used inside tasks by the two trained operators."""
from __future__ import annotations

import numpy as np

_STEP = np.uint32(2654435761)


def codes(text: str) -> np.ndarray:
    """Code points of a text, A-Z lower-cased, blanks made equal and one added at each end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    raw = np.concatenate(([32], raw, [32])).astype(np.uint32)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    return np.where((raw == 32) | ((raw >= 9) & (raw <= 13)), 32, raw).astype(np.uint32)


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """One slot of 2 ** bits for each n-gram, repeats included."""
    count = len(points) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(count, n, dtype=np.uint32)
    for i in range(n):
        h = (h ^ points[i:i + count]) * _STEP
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


class Distinct:
    """Distinct slots of an array in linear time: a slot counts where its last writer is itself."""

    def __init__(self, bits: int):
        self.mark = np.empty(1 << bits, dtype=np.int64)

    def __call__(self, slots: np.ndarray) -> np.ndarray:
        at = np.arange(len(slots))
        self.mark[slots] = at
        return slots[self.mark[slots] == at]

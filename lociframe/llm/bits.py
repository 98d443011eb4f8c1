"""Bits of SimHash words over 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Added to a hash before it is mixed for a further word; the first word is the hash itself.
_MIX = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def counted(h: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes set each of the 64 bits of each word."""
    total = np.zeros((words, 64), np.int64)
    for j in range(words):
        x = h
        if j:
            x = (h ^ np.uint64(_MIX[j])) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        total[j] = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def majority(total: np.ndarray, n: int) -> list:
    """The words of bits that over half of ``n`` hashes set, as signed integers."""
    bits = np.packbits((2 * total > n).astype(np.uint8), axis=1, bitorder="little")
    return [int(v) for v in bits.view("<i8").reshape(-1)]

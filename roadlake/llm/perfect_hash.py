"""Minimal perfect hash over 128-bit keys, as bits by level.

Each key of a level is dealt to one of twice as many places; keys alone in their
place set its bit, the rest go on to the next level. A key's slot is the number of
bits set before its own, so the slots are 0 to n - 1 without gaps.
"""

from __future__ import annotations

import numpy as np

from roadlake.llm.text import mix

MOST_LEVELS = 200


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1 ^ mix(h2, level), level) % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and their packed bits; the keys must be distinct."""
    sizes, bits = [], []
    while len(h1):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("the keys are not distinct")
        size = -(-2 * len(h1) // 8) * 8
        places = _places(h1, h2, len(sizes), size)
        alone = np.bincount(places, minlength=size) == 1
        rest = ~alone[places]
        sizes.append(size)
        bits.append(np.packbits(alone))
        h1, h2 = h1[rest], h2[rest]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8)


class Slots:
    """Finds slots; -1 for keys that reach no set bit (never a key of the build)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes = sizes
        self.bits = np.unpackbits(bits).astype(bool)
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found, left, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            places = start + _places(h1[left], h2[left], level, int(size))
            hit = self.bits[places]
            found[left[hit]] = self.before[places[hit]]
            left, start = left[~hit], start + int(size)
        return found

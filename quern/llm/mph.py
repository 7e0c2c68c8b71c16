"""A minimal perfect hash over 128-bit keys, built and probed with numpy.

Levels of bit arrays: a key takes the slot its level hash names if no other key wants it; keys that
clash go on to the next, smaller level. A key's index is the rank of its bit over all levels. About
four bits a key; a probe for a key that was not built in gives some index or -1, so what the index
points at must hold a fingerprint.
"""

from __future__ import annotations

import numpy as np

_LEVELS = 40


def _mix(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the key for one level."""
    with np.errstate(over="ignore"):
        x = lo ^ (hi * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * level + 1) * np.uint64(0xD6E8FEB86659FD93))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Index of each key in 0 .. n-1, without the keys."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """The hash over distinct keys ``(lo, hi)``, both uint64."""
        sizes, words = [], []
        for level in range(_LEVELS):
            if not len(lo):
                break
            size = max(64, -(-int(len(lo) * gamma) // 64) * 64)
            slot = (_mix(lo, hi, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            sizes.append(size)
            words.append(bits)
            stay = ~alone[slot]
            lo, hi = lo[stay], hi[stay]
        if len(lo):
            raise ValueError("the keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def lookup(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The index of each key, or -1 for some of the keys that are not in it."""
        out = np.full(len(lo), -1, np.int64)
        left = np.arange(len(lo))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            slot = (_mix(lo[left], hi[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + (slot >> 6), (slot & 63).astype(np.uint64)
            bits = self.words[word]
            hit = (bits >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[word[hit]] + below
            left = left[~hit]
        return out

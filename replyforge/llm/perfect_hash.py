"""Minimal perfect hash of a set of 128-bit keys, as cascaded bit arrays.

Level by level, a key whose place in the level's bit array is its own sets the
bit; keys that collide go on to the next, smaller level.  A key's number is the
count of set bits before its own.  About 3.7 bits per key, built and probed in
numpy.  A foreign key may get any number: callers compare fingerprints.
"""

from __future__ import annotations

import numpy as np

from replyforge.llm.words import mix, salt

SPREAD = 2  # places per key in a level
MAX_LEVELS = 64


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    both = mix(high ^ salt(2 * level + 11)) + mix(low ^ salt(2 * level + 12))
    return (both % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """sizes: bits of each level (multiples of 64); bits: all levels as uint64."""
        self.sizes = sizes
        self.bits = bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """For distinct keys (high, low), both uint64."""
        sizes, levels = [], []
        while len(high):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-SPREAD * len(high) // 64) * 64
            at = _places(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[at]
            high, low = high[rest], low[rest]
        bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        return cls(np.array(sizes, dtype=np.int64), bits)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each key, or -1 where no level has its bit."""
        out = np.full(len(high), -1, dtype=np.int64)
        open_ = np.arange(len(high))
        base = 0
        for level, size in enumerate(self.sizes):
            at = _places(high[open_], low[open_], level, int(size)) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.bits[word]
            own = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            found = self.before[word] + np.bitwise_count(below)
            out[open_[own]] = found[own]
            open_ = open_[~own]
            base += int(size)
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), self.bits.tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, "<u8"))

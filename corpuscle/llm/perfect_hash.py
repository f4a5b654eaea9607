"""A minimal perfect hash over 64-bit keys, built and probed as arrays.

Keys fall into a bit array; those alone in their place stay, the others go to a smaller array of the next level.
A key's number is the count of set bits before its own, so n keys get the numbers 0 to n - 1, in about three bits a
key and a constant expected number of probes.  A key outside the set gets some number or -1: callers compare.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_RATIO = 2


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: for each, one byte for eight places, as packbits gives them."""
        self.levels = levels
        bits = [np.unpackbits(x) for x in levels]
        self._bits = [b.astype(bool) for b in bits]
        before = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self._rank = [np.cumsum(b, dtype=np.int64) - 1 + at for b, at in zip(bits, before, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels, left = [], keys
        while len(left):
            size = max(8, -(-len(left) * _RATIO // 8) * 8)
            at = cls._place(left, len(levels), size)
            n = np.bincount(at, minlength=size)
            levels.append(np.packbits(n == 1))
            left = left[n[at] > 1]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self._bits, self._rank, strict=True)):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", n, 4), 4 + 4 * n, []
        for s in sizes.tolist():
            levels.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        return cls(levels)

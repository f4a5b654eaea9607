"""Encodings by unit - a word and the white space before it - as arrays, for pre-tokenizers that join across no word's end.

A text falls into units at the ends of its words (runs of bytes other than ASCII white space); white space that ends it
is one more.  Patterns whose pieces never hold white space after another character cut there as well, so a text's ids are
its units' ids in a row.  Units are told apart by 64-bit hashes of their bytes; a task looks all units of a slice up in
one table of bounded size, which is emptied when full, and encodes those it lacks together.

Texts where that doesn't hold are encoded whole: those with a word that ends in white space beyond ASCII, and those that
hold one of the `whole` strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import mix64
from .words import _BYTE, _DOWN, _SPACE, _UP, LONG, STEP, _offsets, _one, hash_long, ranges

#: Units whose ids a task keeps.
KEPT = 1 << 20
#: Last two bytes of white space beyond ASCII, and of some other characters.
_ODD = np.zeros(1 << 16, bool)
_ODD[[*((a << 8) | b for a in range(256) for b in range(0x1C, 0x20)), 0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]] = True


class Units:
    """The units of a column of texts: bounds in `data`, hashes, the first unit of each text, and texts to encode whole."""

    def __init__(self, column: pa.Array, whole: tuple[bytes, ...] = ()):
        offsets = _offsets(column)
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        self.offsets = offsets - base
        self.odd = np.zeros(len(column), bool)
        if not size:
            self.data, self.starts, self.ends, self.hashes, self.first = b"", *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
            return
        self.data = bytes(memoryview(column.buffers()[2])[base : base + size])
        b = np.frombuffer(self.data, np.uint8)
        space = _SPACE[b]
        after = np.ones(size, bool)
        after[:-1] = space[1:]
        last = after & ~space
        edge = self.offsets[1:][np.diff(self.offsets) > 0] - 1  # a text's last byte ends a unit
        last[edge] = True
        ends = np.flatnonzero(last) + 1
        starts = np.concatenate(([0], ends[:-1]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, self.offsets)
        pair = b[ends - 1].astype(np.int64)
        pair[ends > 1] |= b[ends[ends > 1] - 2].astype(np.int64) << 8
        self.odd[np.searchsorted(self.offsets, starts[_ODD[pair]], "right") - 1] = True
        for w in whole:
            at = self.data.find(w)
            while at >= 0:
                self.odd[np.searchsorted(self.offsets, at, "right") - 1] = True
                at = self.data.find(w, at + 1)
        if self.odd.any():
            n = np.where(self.odd, 0, np.diff(self.first))
            some = ranges(self.first[:-1], n)
            starts, ends = self.starts, self.ends = starts[some], ends[some]
            self.first = np.concatenate(([0], np.cumsum(n)))
        h, sums = np.empty(len(starts), np.uint64), np.zeros(STEP + 1, np.uint64)
        for at in range(0, size, STEP):
            part = b[at : at + STEP]
            np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1 : len(part) + 1])
            i, j = np.searchsorted(starts, (at, at + len(part)))
            s, e = starts[i:j] - at, ends[i:j] - at
            h[i:j] = (sums[np.minimum(e, len(part))] - sums[s]) * _DOWN[s]
            if j > i and e[-1] > len(part):
                h[j - 1] = _one(_BYTE[b[starts[j - 1] : min(ends[j - 1], starts[j - 1] + LONG)]])
        hash_long(h, b, starts, ends)
        self.hashes = mix64(h + (ends - starts).astype(np.uint64))
        self.hashes[self.hashes == 0] = 1


class UnitTable:
    """Ids by unit, found by open addressing over arrays."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], kept: int = KEPT, whole: tuple[bytes, ...] = ()):
        self.encode, self.kept, self.whole = encode, kept, whole
        self.clear(0)

    def clear(self, need: int):
        """Room for kept units, or for those of a very long text."""
        self.places = 1 << int(np.ceil(np.log2(2 * max(self.kept, need))))
        self.keys, self.number = np.zeros(self.places, np.uint64), np.zeros(self.places, np.int32)
        self.at, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.filled = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 where the table lacks one."""
        mask = np.uint64(self.places - 1)
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.number[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & (self.places - 1)
        return out

    def _add(self, keys: np.ndarray, ids: list[np.ndarray]):
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.n + len(keys)
        while len(self.at) < need:
            self.at, self.size = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.size, np.zeros_like(self.size)))
        while len(self.ids) < self.filled + int(sizes.sum()):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.at[self.n : need], self.size[self.n : need] = self.filled + np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.ids[self.filled : self.filled + len(flat)] = flat
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.places - 1)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            won = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[won]
            self.keys[slot[put]], self.number[slot[put]] = keys[left[put]], self.n + left[put]
            done = np.zeros(len(left), bool)
            done[put] = True
            left, slot = left[~done], (slot[~done] + 1) & (self.places - 1)
        self.n, self.filled = need, self.filled + len(flat)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin, with the end."""
        u = Units(column, self.whole)
        found = self._find(u.hashes)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            keys, first, back = np.unique(u.hashes[lacking], return_index=True, return_inverse=True)
            if self.n + len(keys) > self.kept:
                lacking = np.arange(len(u.hashes))
                keys, first, back = np.unique(u.hashes, return_index=True, return_inverse=True)
                self.clear(len(keys))
            at = lacking[first]
            texts = [u.data[a:b].decode("utf-8", "replace") for a, b in zip(u.starts[at].tolist(), u.ends[at].tolist(), strict=True)]
            self._add(keys, self.encode(texts))
            found[lacking] = self.n - len(keys) + back
        size = self.size[found] if len(found) else np.zeros(0, np.int64)
        ids = self.ids[ranges(self.at[found], size)] if len(found) else np.zeros(0, np.uint32)
        begin = np.concatenate(([0], np.cumsum(size)))[u.first]
        if u.odd.any():
            parts, at = [], 0
            sizes = np.diff(begin)
            for i in np.flatnonzero(u.odd).tolist():
                one = self.encode([u.data[u.offsets[i] : u.offsets[i + 1]].decode("utf-8", "replace")])[0]
                parts += [ids[at : begin[i]], one]
                at, sizes[i] = begin[i + 1], len(one)
            ids = np.concatenate([*parts, ids[at:]])
            begin = np.concatenate(([0], np.cumsum(sizes)))
        return ids, begin

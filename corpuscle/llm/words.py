"""Words of whole batches of texts as arrays: hashes, places and n-gram hashes, without a Python object for each word.

Words are runs of bytes other than ASCII white space.  A word's hash is a polynomial over a table of 64-bit numbers by
byte, modulo 2**64, taken from running sums over the batch and finished by mix64.  Such a polynomial tells words of up to
LONG bytes apart as 64 bits can; longer ones, among which there are pairs that agree for every base, are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix64

#: Bytes of text hashed at a time; bytes of the longest word that goes by its polynomial.
STEP, LONG = 1 << 18, 64
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        out[have : 2 * have] = out[: min(have, n - have)] * _U(pow(base, have, 1 << 64))
        have *= 2
    return out


_UP = _powers(_BASE, STEP + 1)
_INVERSE = pow(_BASE, -1, 1 << 64)
_DOWN = _powers(_INVERSE, STEP + 1)


@dataclass
class Words:
    hashes: np.ndarray  # uint64, of all words in a row
    first: np.ndarray  # by text: its first word; one more at the end


def slices(batch: pa.RecordBatch, column: int = 0, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text; a longer text is a slice of its own."""
    offsets = _offsets(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """column: text; a null has no words.  With lower, A-Z count as a-z."""
    offsets = _offsets(column)
    data = column.buffers()[2] if len(column) else None
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size or data is None:
        return Words(np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    b = np.frombuffer(data, np.uint8, size, base)
    if column.null_count:  # a null's bytes, if it has any, are no words
        gone = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False) & (np.diff(offsets) > 0))
        if len(gone):
            b = b.copy()
            for i in gone:
                b[offsets[i] - base : offsets[i + 1] - base] = 32
    edge = np.zeros(size + 1, bool)
    edge[offsets - base] = True
    space = _SPACE[b]
    before = np.empty(size, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero((before | edge[:-1]) & ~space)
    before[:-1], before[-1] = space[1:], True
    ends = np.flatnonzero((before | edge[1:]) & ~space) + 1
    table = _LOWER if lower else _BYTE
    sums = np.zeros(STEP + 1, np.uint64)
    h = np.empty(len(starts), np.uint64)
    for at in range(0, size, STEP):
        part = b[at : at + STEP]
        np.cumsum(table[part] * _UP[: len(part)], out=sums[1 : len(part) + 1])
        i, j = np.searchsorted(starts, (at, at + len(part)))
        s = starts[i:j] - at
        e = ends[i:j] - at
        inside = e <= len(part)
        h[i:j] = (sums[np.minimum(e, len(part))] - sums[s]) * _DOWN[s]
        if not inside.all():  # the last word goes on
            h[j - 1] = _one(table[b[starts[j - 1] : min(ends[j - 1], starts[j - 1] + LONG)]])
    hash_long(h, b, starts, ends, lower)
    return Words(mix64(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets - base))


def _one(values: np.ndarray) -> np.uint64:
    """The polynomial of at most STEP bytes."""
    return (values * _UP[: len(values)]).sum(dtype=np.uint64)


def hash_long(h: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> None:
    """Puts the hashes of words beyond LONG bytes in h."""
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        word = b[starts[i] : ends[i]].tobytes()
        h[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)


_MULT = _U(0x9E3779B97F4A7C15)


def grams(h: np.ndarray, k: int, mult=_MULT) -> np.ndarray:
    """A hash of each k consecutive words, by doubling: log(k) passes."""
    if len(h) < k:
        return h[:0]
    done, base = 1, mix64(h * mult)
    acc, have = None, 0
    while True:
        if k & done:
            acc = base if acc is None else mix64(acc[: len(h) - have - done + 1] * mult + base[have:])
            have += done
            if have == k:
                return acc[: len(h) - k + 1]
        base = mix64(base[: len(h) - 2 * done + 1] * mult + base[done:])
        done *= 2


def sliding_argmin(x: np.ndarray, n: int) -> np.ndarray:
    """The place of the first least of each n consecutive values, by doubling."""
    at = np.arange(len(x), dtype=np.int64)

    def join(x, at, d):
        less = x[d:] < x[:-d]
        return np.where(less, x[d:], x[:-d]), np.where(less, at[d:], at[:-d])

    if len(x) < n:
        return at[:0]
    done = 1
    while 2 * done <= n:
        x, at = join(x, at, done)
        done *= 2
    return join(x, at, n - done)[1] if n > done else at


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for size[i] numbers, one range after the other."""
    size = np.maximum(size, 0)
    total = int(size.sum())
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total) if total else np.zeros(0, np.int64)

"""Byte-level BPE encoding and decoding by a rank file, in two tiers.

A pre-token that is a vocabulary entry is resolved by a minimal perfect hash over the vocabulary (and a comparison of
the bytes); any other is merged by a heap of candidate pairs over a linked list of its bytes, lowest rank first,
leftmost among equals.  Tasks keep what they have resolved by unit (a word and the white space before it), in a table of
bounded size that is emptied when full, so that their memory doesn't grow with the corpus; texts are then looked up
in that table as arrays.

Nulls: a null text is an empty one.  Rows repeat freely.  Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, tidy
from .perfect_hash import PerfectHash
from .units import UnitTable
from .words import ranges, slices

#: Pre-tokens whose ids a task keeps.
KEPT = 1 << 18


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        words = list(self.ranks)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.hash = PerfectHash.build(keys)
        self.words: list[bytes] = [b""] * len(words)
        for at, w in zip(self.hash.number(keys).tolist(), words, strict=True):
            self.words[at] = w
        self.ids = [self.ranks[w] for w in self.words]
        self.bytes = _Table({i: w for w, i in self.ranks.items()})
        self.text = _Table({i: b"%d," % i for i in self.ranks.values()})
        self.units = UnitTable(self._units)
        self.merged: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Pairs by rank from a heap, as rank, begin, end; a pair whose ends have changed since is passed over."""
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # links; a part that is gone ends at 0
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            middle = end[i]
            if not 0 < middle < e or end[middle] != e:
                continue
            end[i], end[middle] = e, 0
            if e < n:
                before[e] = i
                far = end[e]
                if (r := get(piece[i:far])) is not None:
                    heappush(heap, (r, i, far))
            if (h := before[i]) >= 0 and (r := get(piece[h:e])) is not None:
                heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _units(self, units: list[str]) -> list[np.ndarray]:
        split = [[p.encode() for p in self.pattern.findall(u)] for u in units]
        if len(self.merged) > KEPT:
            self.merged.clear()
        new = [p for p in {p for pieces in split for p in pieces} if p not in self.merged]
        if new:
            numbers = self.hash.number(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
            for p, at in zip(new, numbers.tolist(), strict=True):
                self.merged[p] = [self.ids[at]] if at >= 0 and self.words[at] == p else self.merge(p)
        merged = self.merged
        return [np.array(merged[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in merged[p]], np.uint32) for pieces in split]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, begin = self.units(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)]


class _Table:
    """Strings by id, strung together for many ids at once."""

    def __init__(self, strings: dict[int, bytes]):
        size = np.zeros(max(strings) + 1, np.int64)
        for i, s in strings.items():
            size[i] = len(s)
        self.size, self.at = size, np.concatenate(([0], np.cumsum(size)[:-1]))
        self.data = np.frombuffer(b"".join(strings.get(i, b"") for i in range(len(size))), np.uint8)

    def __call__(self, ids: np.ndarray, begin: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of all ids in a row, and where those from each of `begin` start."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.data[ranges(self.at[ids], size)].tobytes(), ends[begin].tolist()


@kept_by_worker
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, place: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes); and place,
    a column of docs that goes with each document, if it is named."""
    extra = [F.col(place).cast("long").alias("place")] if place else []

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, begin = c.units(batch.column(1))
                text, ends = c.text(ids, begin)
                ids_sha = [hashlib.sha256(memoryview(text)[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                decoded, ends = c.bytes(ids, begin)
                bytes_sha = [hashlib.sha256(memoryview(decoded)[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begin)), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string()), *batch.columns[2:]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *batch.schema.names[2:]])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    return docs.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", place long" if place else ""))

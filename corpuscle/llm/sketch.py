"""A count-min sketch built by tasks and merged by Spark, answering one question: can this key occur twice or more?

Each task counts its keys in one or two rows of `width` counters and writes only the counters it touched, block by block;
blocks are merged in the shuffle, one at a time in a task, and the driver receives one bit a counter ("two or more"), at
most `2 * MAX_WIDTH` bits.  A sketch can only overestimate, so a key it calls single is single.

A corpus with more keys than such a sketch can tell apart (`fits`) has its counters as a table instead: rows of a
grouped count that no one task or driver holds, as wide as the corpus needs, which keys meet by a join (`shared_slots`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Counters to a block; offsets inside one fit in 16 bits.
BLOCK = 1 << 16
MIN_WIDTH, MAX_WIDTH = 1 << 18, 1 << 28
#: Keys a task gathers before it writes their counters.
FLUSH = 1 << 18
#: Parts in which the keys of one counter meet it.
SALT = 8


def width_for(keys: float, each: float = 8) -> int:
    """Counters a row for about this many keys, within MIN_WIDTH and MAX_WIDTH."""
    return int(min(MAX_WIDTH, max(MIN_WIDTH, 1 << int(np.ceil(np.log2(max(each * keys, 1)))))))


def fits(keys: float) -> bool:
    """Whether a sketch of at most MAX_WIDTH has two counters a key, which calls less than a sixth of single keys repeated."""
    return 2 * keys <= MAX_WIDTH


def slots(keys: np.ndarray, width: int, rows: int = 2) -> tuple[np.ndarray, ...]:
    mask = np.uint64(width - 1)
    return (keys & mask, ((keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask)[:rows]


def _blocks(keys: np.ndarray, width: int, rows: int) -> Iterator[tuple[int, bytes, bytes]]:
    for row, slot in enumerate(slots(keys, width, rows)):
        slot, n = np.unique(slot, return_counts=True)
        block = (slot >> np.uint64(16)).astype(np.int64)
        offset = (slot & np.uint64(BLOCK - 1)).astype(np.uint16)
        cut = np.flatnonzero(np.diff(block)) + 1
        for at, end in zip([0, *cut], [*cut, len(slot)], strict=True):
            if end > at:
                one = n[at:end] == 1
                yield row * (width // BLOCK) + int(block[at]), offset[at:end][one].tobytes(), offset[at:end][~one].tobytes()


def repeated_bits(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """Bits of both rows, set where the merged count is two or more.  keys_of gives uint64 keys, one for each occurrence."""

    def count(batches):
        held, n = [], 0

        def out():
            found = counted(held, width)
            for at in range(0, len(found), 512):
                b, one, more = zip(*found[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(one, pa.binary()), pa.array(more, pa.binary())], ["block", "one", "more"])

        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= FLUSH:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    return merged_bits(df.mapInArrow(tidy(count), "block int, one binary, more binary"), width)


def counted(held: list[np.ndarray], width: int, rows: int = 2) -> list[tuple[int, bytes, bytes]]:
    """A task's counters for some keys: block, offsets counted once, offsets counted more often."""
    return list(_blocks(np.concatenate(held), width, rows))


def merged_bits(blocks: DataFrame, width: int, rows: int = 2) -> np.ndarray:
    """blocks: block, one, more, as tasks count them."""

    def merge(batches):
        """Rows come sorted by block, so one block's counters are held at a time."""
        last, c = None, np.zeros(BLOCK, np.uint8)
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(c >= 2).tobytes()], pa.binary())], ["block", "bits"])
        for batch in batches:
            for b, one, more in zip(*(batch.column(i) for i in range(3)), strict=True):
                b, one, more = b.as_py(), np.frombuffer(one.as_buffer(), np.uint16), np.frombuffer(more.as_buffer(), np.uint16)
                if b != last:
                    if last is not None:
                        yield bits()
                    last = b
                    c[:] = 0
                c[one] = np.minimum(c[one] + 1, 2)
                c[more] = 2
        if last is not None:
            yield bits()

    bits = np.zeros((rows * width // BLOCK, BLOCK // 8), np.uint8)
    merged = blocks.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(tidy(merge), "block int, bits binary")
    found = merged.toArrow()  # one bit a counter: bounded by MAX_WIDTH
    for b, x in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
        bits[b] = np.frombuffer(x.as_buffer(), np.uint8)
    return bits.reshape(rows, width // 8)


def maybe_repeated(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that occur once."""
    found = np.ones(len(keys), np.uint8)
    for row, slot in zip(bits, slots(keys, bits.shape[1] * 8, len(bits)), strict=True):
        slot = slot.astype(np.int64)
        found &= row[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)
    return (found & 1).astype(bool)


def slot_of(key, keys: float):
    """A key's counter in one row of about eight counters a key, as a column."""
    return F.col(key).bitwiseAND(F.lit((1 << int(np.ceil(np.log2(max(8 * keys, 2))))) - 1))


def shared_slots(df: DataFrame, keys: float) -> DataFrame:
    """df: key, n.  slot, salt: the counters that reach two, once for each salt."""
    found = df.groupBy(slot_of("key", keys).alias("slot")).agg(F.sum("n").alias("n")).where("n > 1")
    return found.select("slot", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))

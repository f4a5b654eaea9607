"""Packing documents into training sequences of several lengths, without padding.

Sequences have one of the lengths of `sizes`, longest first, each half the one before.  A task encodes the documents of
its part of the table and packs as it reads, so texts and ids never cross a shuffle.  Of a long document, whole windows of the longest size go out at
once; what is left of it, and every shorter document, is routed to the smallest size that holds it.  When a task's pool
holds POOL ids, each size is packed, longest first: a window takes the longest piece routed to it, then its gap takes the
longest pieces that fit, which come from shorter sizes too; a gap that nothing fits into takes a cut piece.  So each
window is full, and at most one piece in it was cut to fill it.  What is left of the pool waits for the next documents;
at the end of the task it is laid out in lengths that are powers of two, so no sequence is padded.

Step groups: `step_groups` deals sequences of one length to steps of the same number of ids, and spreads the steps of
all lengths evenly over each other, by counts for each task and length.  Only a length's last step may hold fewer.

Nulls: a null text is empty and consists of its end id; a null doc_id stays null, and its pieces are told from others of
null id by sequence and offset alone.  Repeated rows are packed as often as they come.  Other columns of the input are
ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, kept_by_worker, saved, tidy
from .units import UnitTable
from .words import slices

SIZES = (2048, 1024, 512, 256)
#: Ids a task gathers before it packs them, ids in a batch of pieces, ids of a step.
POOL, BATCH, STEP_IDS = 1 << 19, 1 << 18, 1 << 17
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, context_size int, place long, ids binary"
#: Stands between units that are encoded as one text; a unit that holds it is encoded alone.
MARK = "\u0001"


class SpacedEncoder:
    """A tokenizers file whose pre-tokenizer drops white space, behind a table of units.

    Nothing joins across white space there, so new units are encoded as one text and told apart by a mark between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids
        added = self.tok.get_added_tokens_decoder().values()
        self.encode = UnitTable(self._units, whole=tuple(t.content.encode() for t in added))

    def _units(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        plain = [i for i, u in enumerate(units) if MARK not in u]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            (found,) = self.tok.encode_batch_fast([f" {MARK} ".join([*(units[i] for i in some), ""])], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            for i, a, b in zip(some, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                out[i] = ids[a:b]
        rest = [i for i, u in enumerate(units) if MARK in u]
        for i, e in zip(rest, self.tok.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out


@kept_by_worker
def encoder(path: str) -> SpacedEncoder:
    """One for each Python worker."""
    return SpacedEncoder(path)


class Pool:
    """Pieces shorter than a window, by length; a bit of `have` for each length there is."""

    def __init__(self):
        self.by: dict[int, list] = {}
        self.have = self.tokens = 0

    def add(self, piece) -> None:
        n = len(piece[2])
        self.by.setdefault(n, []).append(piece)
        self.have |= 1 << n
        self.tokens += n

    def take(self, n: int):
        held = self.by[n]
        piece = held.pop()
        if not held:
            self.have ^= 1 << n
        self.tokens -= n
        return piece

    def longest(self, most: int) -> int:
        """The longest length of at most so many ids, 0 if there is none."""
        return max(0, (self.have & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self, least: int) -> int:
        """The shortest length of at least so many ids; there must be one."""
        above = self.have >> least
        return least + (above & -above).bit_length() - 1


def cut(piece, n: int):
    """The first n ids of a piece, and the others."""
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def packed(pool: Pool, sizes: tuple[int, ...]) -> Iterator[tuple[int, list]]:
    """Full windows (size, pieces) of what the pool holds; pieces that fill no window stay in it."""
    for size in sizes:
        least = size // 2 if size > sizes[-1] else 0
        while pool.tokens >= size and (n := pool.longest(size)) > least:
            window, gap = [pool.take(n)], size - n
            while gap:
                if n := pool.longest(gap):
                    window.append(pool.take(n))
                    gap -= n
                else:
                    part, rest = cut(pool.take(pool.shortest(gap)), gap)
                    window.append(part)
                    pool.add(rest)
                    gap = 0
            yield size, window


def tail(pool: Pool, most: int) -> Iterator[tuple[int, list]]:
    """What is left, in lengths that are powers of two; only the first may be `most` more than once."""
    left = []
    while pool.have:
        left.append(pool.take(pool.longest(most)))
    total = sum(len(p[2]) for p in left)
    left.reverse()
    while total:
        size = min(most, 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            piece = left.pop()
            if len(piece[2]) > gap:
                piece, rest = cut(piece, gap)
                left.append(rest)
            window.append(piece)
            gap -= len(piece[2])
        total -= size
        yield size, window


class Writer:
    """Numbers the sequences of a task and hands out their pieces in batches."""

    def __init__(self, task: int):
        self.task, self.at, self.places, self.rows, self.held = task, 0, {}, [], 0

    def put(self, size: int, window: list) -> None:
        offset, place = 0, self.places.get(size, 0)
        self.places[size] = place + 1
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), total, (self.task << 33) + self.at, offset, size, place, ids.tobytes()))
            offset += len(ids)
        self.at += 1
        self.held += size

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= least:
            types = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
            self.rows, self.held = [], 0


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, context_size, place, ids (little-endian, 32 bits).

    place numbers the sequences of one size within a task, whose number is sequence_id >> 33.
    """
    if any(n & (n - 1) for n in sizes) or list(sizes) != sorted(set(sizes), reverse=True) or any(a != 2 * b for a, b in zip(sizes, sizes[1:], strict=False)):
        raise ValueError("sizes must be powers of two, each half the one before")
    most = sizes[0]

    @tidy
    def run(batches):
        e, end = encoder(tokenizer), np.array([end_id], "<u4")
        pool, out = Pool(), Writer(TaskContext.get().partitionId())
        for whole in batches:
            for batch in slices(whole, 1):
                found, begin = e.encode(batch.column(1))
                found = found.astype("<u4", copy=False)
                for doc, a, b in zip(batch.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    ids = np.concatenate((found[a:b], end))
                    n = len(ids)
                    for at in range(0, n - n % most, most):
                        out.put(most, [(doc, at, ids[at : at + most], n)])
                        yield from out.batches(BATCH)
                    if n % most:
                        pool.add((doc, n - n % most, ids[n - n % most :], n))
                    if pool.tokens >= POOL:
                        for size, window in packed(pool, sizes):
                            out.put(size, window)
                            yield from out.batches(BATCH)
        for size, window in (*packed(pool, sizes), *tail(pool, most)):
            out.put(size, window)
            yield from out.batches(BATCH)
        yield from out.batches(0)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECES)


def step_groups(pieces: DataFrame, step_ids: int = STEP_IDS) -> DataFrame:
    """A saved table of pieces with `step`: sequences of one size that together hold step_ids ids, steps of all sizes in turn.

    The i-th of a size's n steps belongs at (i + 1/2) / n of the way; a step's number is how many lie before it.
    """
    task = F.shiftright("sequence_id", 33)
    counts = saved(pieces.where("offset = 0").groupBy(task.alias("task"), "context_size").agg(F.count("*").alias("n")), "counts")
    # tasks are few beside their sequences; a size's sums run over them
    sums = saved(counts.selectExpr("task", "context_size", "sum(n) over (partition by context_size order by task) - n as before"), "sums")
    totals = {r.context_size: -(-r.n // max(1, step_ids // r.context_size)) for r in counts.groupBy("context_size").agg(F.sum("n").alias("n")).collect()}  # a few sizes
    rows = pieces.withColumn("task", task).join(if_small(sums), ["task", "context_size"])
    rows = rows.withColumn("i", F.expr(f"(before + place) div greatest(1, {step_ids} div context_size)"))
    own = F.element_at(F.create_map(*(F.lit(x) for kv in totals.items() for x in kv)), F.col("context_size")) if totals else F.lit(1)
    step = F.col("i")
    for size, n in sorted(totals.items(), reverse=True):
        # steps j of another size with (2 j + 1) / n below (2 i + 1) / own; where they are equal, the longer size's comes first
        strict = (F.col("context_size") > size).cast("int")
        ahead = F.floor((F.floor(((2 * F.col("i") + 1) * n - strict) / own) + 1) / 2)
        step = step + F.when(F.col("context_size") == size, 0).otherwise(ahead)
    return rows.withColumn("step", step.cast("long")).drop("task", "before", "i")

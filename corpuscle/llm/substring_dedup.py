"""Removal of long passages that occur more than once, found through a merged count-min prefilter.

A window is `window` consecutive words of one document.  Words are runs of bytes other than ASCII white space.
Of each window's `ANCHOR`-word sequences the first one with the least hash is its anchor; equal windows have equal
anchors, so a window whose anchor occurs once in the corpus occurs once.

1. Tasks count anchor occurrences (about one word in fourteen) in a count-min sketch; Spark merges the sketches.
2. Windows that share an anchor lie side by side: a span.  A second pass hashes each span whose anchor is estimated
   to be repeated.  Spans are grouped exactly on the smallest and largest place they start at, two numbers that combine
   before the shuffle, so a passage that a third of all documents share is a few rows.  All windows of a repeated span
   are repeated.
3. A third pass joins spans to the repeated ones.  Window by window, only the others are left, and one copy of each
   repeated span for them to meet; these windows are grouped in the same way.
4. Documents without an estimated repeat, and copies of very frequent texts, end in their scan.  The others, compressed,
   meet the list of their own repeated starts.

Documents of equal texts are one group: if it has several members, every window of theirs starts elsewhere too, so all
their words go.  Texts with `max(64, documents / 2**17)` copies or more are at most 2**17, and known to all tasks.

A corpus too large for a sketch in memory keeps its counters as a table, and spans meet them by a join.

Nulls: a null text has no words.  Documents of fewer words than a window lose nothing.  Rows repeat freely, also
with the same doc_id; each row has its own result.  Other columns of the input are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, saved, texts, tidy
from .sketch import SALT, fits, maybe_repeated, repeated_bits, shared_slots, slot_of, width_for
from .words import grams, ranges, slices, sliding_argmin, words_of

ANCHOR = 8
#: Different texts a task remembers.
SEEN = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _Windows:
    """The windows of some texts, and the spans they form."""

    def __init__(self, column: pa.Array, window: int, use: np.ndarray | None = None):
        self.words = words_of(column)
        h, first = self.words.hashes, self.words.first
        n = np.diff(first) - window + 1
        if use is not None:
            n[~use] = 0
        self.pos = ranges(first[:-1], n)
        self.owner = np.repeat(np.arange(len(n)), np.maximum(n, 0))
        k = min(ANCHOR, window)
        g = grams(h, k)
        at = sliding_argmin(g, window - k + 1)[self.pos] if len(self.pos) else self.pos
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(self.owner) != 0)
        self.cut = np.append(np.flatnonzero(new), len(at))
        self.anchor = g[at[self.cut[:-1]]]

    def keep(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the spans chosen: the number of the first window among all, size, text, place in the text."""
        first, size = self.cut[:-1][which], np.diff(self.cut)[which]
        owner = self.owner[first]
        return first, size, owner, self.pos[first] - self.words.first[owner]


def _spans(batches, window: int, bits: np.ndarray | None, with_windows: bool):
    """Spans of windows whose anchor may be repeated (all, without bits); for a task, a text's copies count once.

    Batches of text, d1, d2 -> s1, s2, d1, d2, at, size, anchor, and with_windows also windows.
    """
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for batch in slices(whole):
            d1, d2 = (batch.column(i).to_numpy() for i in (1, 2))
            use = np.zeros(len(d1), bool)
            for i, d in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                if d not in seen:
                    seen.add(d)
                    use[i] = True
            if len(seen) > SEEN:
                seen.clear()
            w = _Windows(batch.column(0), window, use)
            maybe = maybe_repeated(bits, w.anchor) if bits is not None else np.ones(len(w.anchor), bool)
            if not maybe.any():
                continue
            first, size, owner, at = w.keep(maybe)
            a, b = w.pos[first], w.pos[first + size - 1]
            # a span's words are those of its first and its last window, and both cover what lies between
            one, two = (grams(w.words.hashes, window, m) for m in (_MULT, _MULT2))
            s1, s2 = (mix64(g[a] * _MULT + mix64(g[b]) + size.astype(np.uint64)) for g in (one, two))
            arrays = [pa.array(x.view(np.int64)) for x in (s1, s2, d1[owner], d2[owner])] + [pa.array(x.astype(np.int32)) for x in (at, size)] + [pa.array(w.anchor[maybe].view(np.int64))]
            if with_windows:
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(one[ranges(a, size)].view(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, ["s1", "s2", "d1", "d2", "at", "size", "anchor", "windows"][: len(arrays)])


_SPAN = "s1 long, s2 long, d1 long, d2 long, at int, size int, anchor long"


class _Estimate:
    """Which anchors may be repeated: bits that all tasks have, or a table of counters."""

    def __init__(self, docs: DataFrame, window: int, anchors: float):
        def keys_of(batch):
            for part in slices(batch):
                yield _Windows(part.column(0), window).anchor

        self.bits = self.slots = None
        self.anchors = anchors
        if fits(anchors):
            self.bits = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs.select("text"), keys_of, width_for(anchors)))
        else:

            def run(batches):
                for batch in batches:
                    for keys in keys_of(batch):
                        k, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])

            self.slots = saved(shared_slots(docs.select("text").mapInArrow(tidy(run), "key long, n long"), anchors), "counters")

    def spans(self, docs: DataFrame, window: int, with_windows: bool) -> DataFrame:
        bits = self.bits
        found = docs.select("text", "d1", "d2").mapInArrow(tidy(lambda b: _spans(b, window, bits and bits.value, with_windows)), _SPAN + ", windows array<long>" * with_windows)
        if self.slots is None:
            return found
        met = found.withColumns({"slot": slot_of("anchor", self.anchors), "salt": F.pmod("d1", F.lit(SALT)).cast("int")})
        return met.join(self.slots, ["slot", "salt"], "left_semi").drop("slot", "salt")


def _starts(docs: DataFrame, window: int, estimate: _Estimate) -> DataFrame:
    """docs: text, d1, d2.  Per text: d1, d2, starts: ranges (at, size) of repeated windows."""
    spot = F.col("d1").bitwiseXOR(F.xxhash64("d2", "at"))
    # copies of a text in several tasks are several places, but have one name
    place = F.xxhash64("d1", "d2", "at", F.spark_partition_id())
    small = estimate.spans(docs, window, False).select("s1", "s2", spot.alias("spot"), place.alias("place"))
    multi = small.groupBy("s1", "s2").agg(F.min("spot").alias("lo"), F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y")
    multi = saved(multi.select("s1", "s2", "lo"), "spans")
    spans = estimate.spans(docs, window, True).join(multi, ["s1", "s2"], "left").withColumn("known", F.col("lo").isNotNull())
    spans = saved(spans.select("d1", "d2", "at", "size", "known", "anchor", F.when(~F.col("known") | (F.col("lo") == spot), F.col("windows")).alias("windows")), "windows")
    # a repeated span's windows matter where another span has its anchor
    open_anchors = spans.where(~F.col("known")).select("anchor").distinct()
    met = spans.where("known AND windows IS NOT NULL").join(open_anchors, "anchor", "left_semi")
    each = spans.where(~F.col("known")).unionByName(met).select("d1", "d2", "known", "anchor", "at", F.posexplode("windows").alias("i", "w"))
    each = each.select("d1", "d2", "known", "anchor", (F.col("at") + F.col("i")).alias("at"), "w")
    repeated = each.select("anchor", "w", spot.alias("spot")).groupBy("anchor", "w").agg(F.min("spot").alias("lo"), F.max("spot").alias("hi")).where("lo <> hi").select("anchor", "w")
    single = each.where(~F.col("known")).drop("known").join(repeated, ["anchor", "w"]).select("d1", "d2", "at", F.lit(1).alias("size"))
    starts = spans.where("known").select("d1", "d2", "at", "size").union(single)
    return starts.groupBy("d1", "d2").agg(F.collect_list(F.struct("at", "size")).alias("starts"))


def _covered(n: int, starts: list[dict], window: int) -> np.ndarray:
    """Words covered by windows that start in the ranges."""
    edge = np.zeros(n + 1, np.int32)
    at = np.array([s["at"] for s in starts])
    end = at + np.array([s["size"] for s in starts]) + window - 1
    np.add.at(edge, at, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


#: White space as the one space that joins words.
_SPACES = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def _joined(text: bytes | None) -> bytes:
    """The words of a text joined by one space, without a list of them."""
    t = (text or b"").translate(_SPACES).strip(b" ")
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t


class _Results:
    """Rows of results, in one batch."""

    def __init__(self, keep_text: bool):
        self.keep_text, self.at, self.cols = keep_text, [], ([], [], [], [])

    def add(self, at: int, text: bytes | None, gone: Callable[[int], np.ndarray | bool]):
        """gone tells from the number of words which ones go, or whether all do."""
        kept = _joined(text)
        n = kept.count(b" ") + 1 if kept else 0
        lost = gone(n)
        if lost is True:
            kept, removed = b"", n
        elif lost is False:
            removed = 0
        else:
            kept, removed = b" ".join(itertools.compress(kept.split(b" "), (~lost).tolist())) if n else kept, int(lost.sum())
        self.at.append(at)
        for c, v in zip(self.cols, (n, removed, hashlib.sha256(kept).hexdigest(), (kept if removed else text) if self.keep_text else None), strict=True):
            c.append(v)

    def batch(self, rows: pa.Array) -> pa.RecordBatch:
        n, removed, sha, kept = self.cols
        columns = [rows.take(pa.array(self.at, pa.int32())), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _cut(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """row (the document as it came, without its text), n_words, n_removed, kept_sha256, and with keep_text kept_text."""
    text = F.col("text").cast("string")
    docs = docs.select(text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    estimate = _Estimate(docs, window, (size or 0) / 80)  # about one anchor in 80 bytes
    copies = saved(docs.groupBy("d1", "d2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    hot = copies.where(F.col("copies") >= max(64, total >> 17)).select("d1", "d2", F.lit(True).alias("hot"))
    info = _starts(docs, window, estimate).join(copies, ["d1", "d2"], "full")
    docs = docs.join(F.broadcast(hot), ["d1", "d2"], "left").select("text", "row", F.coalesce("hot", F.lit(False)).alias("hot"), "d1", "d2")  # at most 2**17 rows
    bits = estimate.bits

    def waits(batch: pa.RecordBatch) -> np.ndarray:
        """Rows whose result depends on more than their text."""
        hot = batch.column(2).to_numpy(zero_copy_only=False)
        if bits is None:
            return ~hot
        w = _Windows(batch.column(0), window, ~hot)
        wait = np.zeros(len(hot), bool)
        wait[w.keep(maybe_repeated(bits.value, w.anchor))[2]] = True
        return wait

    def done(batches):
        for whole in batches:
            for batch in slices(whole):
                out, hot = _Results(keep_text), batch.column(2).to_pylist()
                alone = np.flatnonzero(~waits(batch))
                for i, b in zip(alone.tolist(), texts(batch.column(0).take(pa.array(alone))), strict=True):
                    out.add(i, b, lambda n, hot=hot[i]: hot and n >= window)
                yield out.batch(batch.column(1))

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in slices(whole):
                wait = pa.array(waits(batch))
                packed = pa.array([None if b is None else z.compress(b) for b in texts(batch.column(0).filter(wait))], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, *(batch.column(i).filter(wait) for i in (1, 3, 4))], ["packed", "row", "d1", "d2"])

    row = docs.schema["row"]
    packed = docs.mapInArrow(tidy(pack), T.StructType([T.StructField("packed", T.BinaryType()), row, *(T.StructField(n, T.LongType()) for n in ("d1", "d2"))]))
    joined = packed.join(info, ["d1", "d2"], "left").select("row", "packed", "copies", "starts")

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = _Results(keep_text)
                for i, (packed, copies, starts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    b = z.decompress(packed) if packed is not None else None
                    out.add(i, b, lambda n, copies=copies, starts=starts: n >= window if copies is not None else _covered(n, starts, window) if starts else False)
                yield out.batch(batch.column(0))

    kinds = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]
    schema = T.StructType([row, *(T.StructField(n, k) for n, k in kinds)])
    found = joined.mapInArrow(tidy(cut), schema)
    return found.union(docs.mapInArrow(tidy(done), schema))


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space, in UTF-8) for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(docs, window, False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents with their own columns; text without repeated passages, its words joined by one space where any are removed.

    A document of nothing else stays, with an empty text.  A column n_chars follows the new text.
    """
    cut = _cut(docs, window, True)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))

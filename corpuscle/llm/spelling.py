"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point.

Words are counted in the tasks that read the texts and summed by Spark.  Two words differ by one edit if the lengths of
their common prefix and common suffix together reach the longer one's length less one.  So one of the two is at least
half of the longer word: words meet only where they share that half, as rows (longer length m, side, half).  Sorted by
it, they fall into blocks of padded code-point matrices, and pairs of blocks that share a half are compared densely.  A
pair counts on the side of the prefix if that is long enough, else on the side of the suffix, and only for the m that
is the longer of its lengths: once in all.  A half with more than CELL words is cut into parts by a hash of the words,
and each pair of parts is a cell of its own, so a cell is bounded and no word misses another.

What a block finds for a word leaves it as one row - how many, and the largest - so near words aren't listed as pairs
unless asked for (`near_pairs`).

Nulls: a null text has no words; a null doc_id counts as an empty one in the hash that picks runs to be shortened.
Repeated rows count again.  Ties go to the smallest word in code-point order.  Empty tables give no rows; other columns
are ignored.  Words of any length take part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, texts, tidy

#: Runs of letters of lower-cased texts; characters read at a time; words a task keeps before it gives their counts on.
RUN = re.compile("[a-zÀ-ÿ]+")
_END = re.compile("[^a-zÀ-ÿ]")
PIECE, KEPT = 1 << 20, 1 << 18
#: Words of a half that meet in one cell, rows of a block, and bytes of a block's matrix.
CELL, ROWS, BYTES = 2048, 256, 1 << 21


def runs(text: bytes) -> Iterator[list[str]]:
    """Runs of a text with A-Z lower-cased, some at a time; none is cut."""
    t = text.lower().decode("utf-8", "replace")
    at = 0
    while at < len(t):
        end = m.start() if (m := _END.search(t, at + PIECE)) else len(t)
        yield RUN.findall(t[at:end] if at or end < len(t) else t)
        at = end


def shortened(prefix: int, run: str, every: int) -> str:
    """The run, without one code point if `every` divides its hash; prefix: crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, every: int = 199, least_chars: int = 6, least: int = 5) -> DataFrame:
    """word, n: words of at least least_chars code points found at least `least` times."""

    @tidy
    def run(batches):
        found: Counter[str] = Counter()
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                for some in runs(b or b""):
                    for word, n in Counter(some).items():
                        if len(word) >= least_chars:
                            found[shortened(prefix, word, every)] += n
                    if len(found) > KEPT:
                        yield tallies(found)
                        found.clear()
        yield tallies(found)

    def tallies(found):
        long = [(w, n) for w, n in found.items() if len(w) >= least_chars]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cells(words: DataFrame) -> DataFrame:
    """m, tile, part, half, prefix, word, n: a row for each cell in which a word may meet a near one; part is 0 unless the cell joins two parts."""
    size = F.length("word")
    half = lambda m: F.expr(f"cast({m} div 2 as int)")
    both = F.explode(F.array(size, size + 1)).alias("m")
    rows = words.select("word", "n", both).select("*", half("m").alias("half")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("prefix"))
    rows = rows.withColumn("key", F.concat_ws(" ", F.col("m").cast("string"), F.when(F.col("prefix"), "p").otherwise("s"), F.when(F.col("prefix"), F.expr("left(word, half)")).otherwise(F.expr("right(word, half)"))))
    crowded = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CELL).select("key", F.ceil(F.col("size") / CELL).cast("int").alias("parts"))
    rows = rows.join(crowded, "key", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.when(F.col("part").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    tile = F.when(F.col("part").isNull(), F.col("key")).otherwise(F.concat_ws(" ", "key", low.cast("string"), high.cast("string")))
    side = F.when(F.col("part").isNull() | (F.col("part") == F.col("other")), 0).when(F.col("part") == low, 1).otherwise(2)
    return rows.select("m", tile.alias("tile"), side.cast("int").alias("part"), "half", "prefix", "word", "n")


class Block:
    """Up to ROWS words of one longer length m, as matrices padded at the end and, mirrored, for suffixes."""

    def __init__(self, m: int, half: int, words: list[str], n: np.ndarray, key: np.ndarray, part: np.ndarray, prefix: np.ndarray):
        self.m, self.half, self.words, self.n, self.key, self.part, self.prefix = m, half, words, n, key, part, prefix
        coded = [w.encode("latin-1") for w in words]
        left, right = np.array(coded, f"S{m}"), np.array([c[::-1] for c in coded], f"S{m}")
        # a column of a matrix is a row here, so that comparing it reads one piece of memory
        self.left, self.right = (np.ascontiguousarray(x.view(np.uint8).reshape(len(words), m).T) for x in (left, right))
        self.size = np.array([len(c) for c in coded])
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.lexsort((left, -n))] = np.arange(len(words))  # largest n first, then the smallest word


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of a with each of b."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.int32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        alive &= x[:, None] == y
        if i % 8 == 0 and not alive.any():
            break
        total += alive
    return total


def single_edits(a: Block, b: Block) -> np.ndarray:
    """Which pairs of the two blocks are one edit apart and belong to this m, side and cell."""
    start, end = _common(a.left, b.left), _common(a.right, b.right)
    longer = np.maximum(a.size[:, None], b.size) == a.m
    # zeros that pad the shorter one are equal to nothing in the longer; two shorter ones are another m's
    near = longer & (start < a.m) & (start + end >= a.m - 1)
    own = np.where(a.prefix[:, None], start >= a.half, (start < a.half) & (end >= a.half))
    apart = (a.part[:, None] == 0) | (a.part[:, None] != b.part)
    return near & own & apart & (a.key[:, None] == b.key)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[Block]]]:
    """Blocks of sorted rows, each with the earlier ones that share its first tile."""
    last, number, held, rest = None, -1, [], None
    for batch in (*batches, None):
        rows = pa.Table.from_batches([batch]) if batch is not None else None
        table = rows if rest is None else rest if rows is None else pa.concat_tables([rest, rows]).combine_chunks()
        if table is None or not table.num_rows:
            continue
        m = table["m"].to_numpy()
        at = 0
        while at < table.num_rows:
            most = max(2, min(ROWS, BYTES // int(m[at])))
            end = min(at + most, int(np.searchsorted(m, m[at], "right")))
            if end == table.num_rows and end - at < most and batch is not None:
                break  # more rows may follow
            part = table.slice(at, end - at).combine_chunks()
            tile = part["tile"].combine_chunks() if isinstance(part["tile"], pa.ChunkedArray) else part["tile"]
            new = np.ones(len(tile), np.int64)
            new[0] = tile[0].as_py() != last
            new[1:] = pc.not_equal(tile[1:], tile[:-1]).to_numpy(zero_copy_only=False)
            key = number + np.cumsum(new)
            number, last = int(key[-1]), tile[-1].as_py()
            block = Block(int(m[at]), int(part["half"][0].as_py()), part["word"].to_pylist(), part["n"].to_numpy(), key, part["part"].to_numpy(), part["prefix"].to_numpy())
            held = [h for h in held if h.key[-1] == key[0] and h.m == block.m]
            yield block, held
            held.append(block)
            at = end
        rest = table.slice(at) if at < table.num_rows else None


def _dealt(words: DataFrame) -> DataFrame:
    return cells(words).repartition("m", "tile").sortWithinPartitions("m", "tile", "word")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: how many words are one edit away, and the largest of them (ties: the smallest word)."""

    @tidy
    def run(batches):
        for block, earlier in blocks(batches):
            for other in (*earlier, block):
                hit = single_edits(block, other)
                for rows, a, b in ((hit, block, other), (hit.T, other, block))[: 1 if other is block else 2]:
                    some = np.flatnonzero(rows.any(axis=1))
                    if len(some):
                        order = np.argsort(b.rank)
                        best = order[np.argmax(rows[some][:, order], axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array([a.words[i] for i in some]), pa.array(rows[some].sum(axis=1).astype(np.int64)), pa.array(b.n[best]), pa.array([b.words[i] for i in best])], ["word", "n_near", "near_n", "near"])

    found = _dealt(words).mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.minus")).alias("near_n"), "best.near")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (a < b): every pair of words that are one edit apart, once."""

    @tidy
    def run(batches):
        for block, earlier in blocks(batches):
            for other in (*earlier, block):
                i, j = np.nonzero(single_edits(block, other))
                pairs = sorted({(min(a, b), max(a, b)) for a, b in ((block.words[x], other.words[y]) for x, y in zip(i, j, strict=True))})
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["a", "b"])

    return _dealt(words).mapInArrow(run, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a saved table (word, form): forms followed to the last, by doubling the steps.

    A form's n is `times` its word's, so chains are at most some 27 long (n is below 2**63), and five rounds are enough.
    """
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        grown = saved(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = grown.select("word", "root")
        if not grown.where("moved").take(1):
            return up


def spelling_variants(docs: DataFrame, every: int = 199, least_chars: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words.

    form: the near word of largest n, if that is at least `times` the word's own; root: forms followed to the last.
    """
    words = saved(word_counts(docs, every, least_chars, least), "words")
    fits = F.col("near_n") >= times * F.col("n")
    found = words.join(near_words(words), "word", "left")
    found = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Splitting texts under a budget of word pieces by a falling list of separators.

A text is cut at the first separator it holds; parts below the budget are joined again, as many as fit, and a new chunk
takes over the last parts of the one before, up to the overlap; a part at or above the budget is cut by the next
separator, and at last into characters, so a text without blanks is split as well.  All of it is column work: arrays of
parts and one fold over their sizes, whose state is a few numbers and the bounds found so far.

Sizes follow the reference's: a part counts its word pieces, one at least, and so does each join of two parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import let, strip, word_pieces

from .chunking import BUDGET, OVERLAP

SEPARATORS = ("\n\n", "\n", " ", "")


def bounds(sizes: Column, budget: int, overlap: int) -> Column:
    """First part and number of parts of each chunk, for the sizes of parts in order."""
    none = F.array().cast("array<struct<first:int,n:int>>")
    start = F.struct(none.alias("out"), F.lit(1).alias("first"), F.lit(1).alias("at"), F.lit(0).cast("long").alias("total"))
    joint = lambda some: F.when(some, 1).otherwise(0)

    def drop(size: Column):
        """Parts leave a chunk's front until what stays is within the overlap and leaves room for the next."""

        def one(a: Column, s: Column) -> Column:
            many = a["n"] > 0
            go = (a["total"] > overlap) | ((a["total"] + size + joint(many) > budget) & (a["total"] > 0))
            return F.when(go & many & ~a["done"], F.struct((a["first"] + 1).alias("first"), (a["n"] - 1).alias("n"), (a["total"] - s - joint(a["n"] > 1)).alias("total"), F.lit(False).alias("done"))).otherwise(F.struct(a["first"].alias("first"), a["n"].alias("n"), a["total"].alias("total"), F.lit(True).alias("done")))

        return one

    def fold(all_sizes: Column) -> Column:
        def step(a: Column, size: Column) -> Column:
            n = a["at"] - a["first"]
            full = (n > 0) & (a["total"] + size + joint(n > 0) > budget)
            held = F.struct(a["first"].alias("first"), n.alias("n"), a["total"].alias("total"), F.lit(False).alias("done"))
            left = F.when(full, F.aggregate(F.slice(all_sizes, a["first"], n), held, drop(size))).otherwise(held)
            out = F.when(full, F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), n.alias("n"))))).otherwise(a["out"])
            return let(left, lambda h: F.struct(out.alias("out"), h["first"].alias("first"), (a["at"] + 1).alias("at"), (h["total"] + size + joint(h["n"] > 0)).cast("long").alias("total")))

        last = lambda a: F.when(a["at"] > a["first"], F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), (a["at"] - a["first"]).alias("n"))))).otherwise(a["out"])
        return F.aggregate(all_sizes, start, step, last)

    return let(sizes, fold)


def _joined(parts: Column, budget: int, overlap: int) -> Column:
    """Chunks of parts that are each below the budget."""

    def cut(p: Column) -> Column:
        texts = F.transform(bounds(F.transform(p, word_pieces), budget, overlap), lambda b: strip(F.array_join(F.slice(p, b["first"], b["n"]), "")))
        return F.filter(texts, lambda x: x != "")

    return let(parts, cut)


def _parts(text: Column, separator: str) -> Column:
    if not separator:
        return F.filter(F.split(text, ""), lambda x: x != "")
    return F.filter(F.transform(F.split(text, separator), lambda p, i: F.when(i > 0, F.concat(F.lit(separator), p)).otherwise(p)), lambda x: x != "")


def recursive_split(text, budget: int = BUDGET, overlap: int | None = None, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks of a text beyond the budget; none is larger.  A text within it should be kept whole by the caller."""
    over = min(OVERLAP, budget // 4) if overlap is None else overlap
    text = F.col(text) if isinstance(text, str) else text
    if len(separators) == 1:
        return _joined(_parts(text, separators[0]), budget, over)

    def cut(parts: Column) -> Column:
        # parts at or above the budget end a run of those that are joined, and are split further themselves
        large = F.filter(F.transform(parts, lambda p, i: F.when(word_pieces(p) >= budget, i)), lambda i: i.isNotNull())
        ends = F.concat(large, F.array(F.size(parts)))

        def around(all_ends: Column) -> Column:
            before = lambda k: F.when(k == 0, -1).otherwise(F.get(all_ends, k - 1))
            run = lambda e, k: _joined(F.slice(parts, before(k) + 2, e - before(k) - 1), budget, over)
            further = lambda e: F.when(e < F.size(parts), recursive_split(F.get(parts, e), budget, over, separators[1:])).otherwise(F.array().cast("array<string>"))
            return F.flatten(F.transform(all_ends, lambda e, k: F.concat(run(e, k), further(e))))

        return let(ends, around)

    return let(_parts(text, separators[0]), cut)


def recursive_chunks(docs: DataFrame, budget: int = BUDGET, overlap: int | None = None) -> DataFrame:
    """doc_id, chunk_index, chunk_count, text; a text within the budget is one chunk, a blank or null one none."""
    whole = F.filter(F.array(strip(F.col("text"))), lambda x: x != "")
    rows = docs.select("doc_id", F.when(word_pieces("text") <= budget, whole).otherwise(recursive_split("text", budget, overlap)).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("chunk_index", "text"), F.size("c").alias("chunk_count"))

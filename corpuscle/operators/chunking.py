"""Blocks into chunks under a budget of word pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import WORD_PIECE, let, word_pieces

BUDGET, OVERLAP = 220, 40


def word_windows(docs: DataFrame, budget: int = BUDGET, overlap: int | None = None) -> DataFrame:
    """doc_id, chunk_index, chunk_count, text: windows of words that overlap; a text within the budget is one chunk."""
    over = min(OVERLAP, budget // 4) if overlap is None else overlap
    step = budget - over
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - over) / step)).cast("int")
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0).withColumn("n", n)
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_join(F.slice("w", i * step + 1, F.lit(budget)), " "))
    return rows.select("doc_id", F.posexplode(parts).alias("chunk_index", "text"), F.col("n").alias("chunk_count"))


def windows(text, budget: int = BUDGET, overlap: int | None = None) -> Column:
    """The windows of `word_windows` as an array, for one text."""
    over = min(OVERLAP, budget // 4) if overlap is None else overlap
    step = budget - over
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.lit(1), F.ceil((F.size(words) - over) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(budget)), " "))


def pack(lines: Column, budget: int, header: Column | None = None) -> Column:
    """Greedy packing: lines joined in order while the header and they keep to the budget; structs of first, last, text.

    A line that alone is over the budget makes the result null: the caller splits the block otherwise.
    """
    head = F.coalesce(header, F.lit("")) if header is not None else F.lit("")
    whole = lambda ls: F.concat(F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), F.array_join(ls, "\n"))
    # no word goes over a line's end, so the words of lines and header add up
    words = lambda x: F.regexp_count(x, F.lit(WORD_PIECE))
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<first:int,last:int,text:string>>")
    start = F.struct(none.alias("out"), F.lit(1).alias("first"), F.lit(1).alias("at"), empty.alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("over"))
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), words(x).alias("n")))

    def step(a, x, top):
        line, n = F.array(x["line"]), x["n"]
        fits = F.greatest(F.lit(1), top + a["n"] + n) <= budget
        done = F.struct(a["first"].alias("first"), (a["at"] - 1).alias("last"), whole(a["cur"]).alias("text"))
        flush = ~fits & (F.size(a["cur"]) > 0)
        return F.struct(F.when(flush, F.concat(a["out"], F.array(done))).otherwise(a["out"]).alias("out"), F.when(flush, a["at"]).otherwise(a["first"]).alias("first"), (a["at"] + 1).alias("at"), F.when(flush, line).otherwise(F.concat(a["cur"], line)).alias("cur"), F.when(flush, n).otherwise(a["n"] + n).alias("n"), (a["over"] | (F.greatest(F.lit(1), top + n) > budget)).alias("over"))

    finish = lambda a: F.when(~a["over"], F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), (a["at"] - 1).alias("last"), whole(a["cur"]).alias("text"))))).otherwise(a["out"]))
    return let(words(head), lambda top: F.aggregate(counted, start, lambda a, x: step(a, x, top), finish))


def table_chunks(text, budget: int = BUDGET) -> Column:
    """Rows of a linearized table, its columns line on top of each chunk."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    header = F.try_element_at(F.filter(lines, lambda s: F.lower(s).startswith("table columns:")), F.lit(1))
    return pack(F.filter(lines, lambda s: s.rlike(r"(?i)^Row\s+\d+\s*:")), budget, header)


def code_units(text) -> Column:
    """Paragraphs between blank lines, or else the definitions."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")
    marked = F.regexp_replace(text, r"(?m)^(?=(?:\s*)(?:async\s+def|def|class|function|const|let|var|public|private)\b)", "\u0001")
    units = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 1, parts).otherwise(units)


def bounded_text(parts: Column, child: Column, budget: int = BUDGET) -> Column:
    """Lines of context before a chunk, each taken if it still fits; one that doesn't is passed over."""
    useful = F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "") & (F.trim(p) != F.trim(child)))
    kept = F.aggregate(useful, F.array().cast("array<string>"), lambda a, p: F.when(word_pieces(F.array_join(F.concat(a, F.array(p, child)), "\n")) <= budget, F.concat(a, F.array(p))).otherwise(a))
    return F.array_join(F.concat(kept, F.array(child)), "\n")


def hydrate(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent content for each hit: its own, else by parent id, else the child's text."""
    stored = parents.select("parent_id", F.col("content").alias("stored"))
    return children.join(stored, "parent_id", "left").withColumn("content", F.coalesce(F.nullif("inline_content", F.lit("")), "stored", "child_text")).drop("stored")

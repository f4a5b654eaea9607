"""Text into typed blocks, without a line-by-line parser: lines get a type, neighbours of one type become a block.

Fences are told by the parity of those before a line, continued list items by the last type since a blank line, and the
blocks themselves are the islands between lines that begin one.  Section paths are one fold over a document's headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import normalize

# What a line looks like.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+\S+"
FENCE = r"^(?:```|~~~)"
TABLE_ROW = r"^\|.*\|$"
IMAGE = r"^!\[[^\]]*\]\([^)]*\)$|(?i)^<img\s[^>]*>$"
CAPTION = r"(?i)^(?:caption:\s*)?(?:figure|fig\.?|table|image|equation|formula|eq\.|图片|图|表|公式)\s*[0-9.]*\s*[:.-]\s*\S"
FORMULA = r"^(?:\$\$|\\\[|\\\()"
SYMBOL = r"\\sum|\\int|\\frac|\\sqrt|<=|>=|==|!=|=|\^|_|\+|-"
ALIGNMENT = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?$"
SINGLE = ("section_header", "caption", "image", "formula")


def _looks_like_formula(s: Column) -> Column:
    symbols = F.regexp_count(s, F.lit(SYMBOL))
    words = F.regexp_count(s, F.lit(r"[A-Za-z一-鿿]+"))
    return (symbols >= 2) & (words <= F.greatest(F.lit(2), F.floor(symbols / 2)))


def typed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, i, line, type; a blank line outside code has type null."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("i", "line")).withColumn("s", F.trim("line"))
    ordered = Window.partitionBy("doc_id").orderBy("i")
    fence = F.col("s").rlike(FENCE).cast("int")
    rows = rows.withColumn("before", F.coalesce(F.sum(fence).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = F.col("s")
    kind = (
        F.when((F.col("before") % 2 == 1) | s.rlike(FENCE), "code").when(s == "", None).when(s.rlike(HEADING), "section_header").when(s.rlike(FORMULA), "formula")
        .when(s.rlike(CAPTION), "caption").when(s.rlike(IMAGE), "image").when(s.rlike(TABLE_ROW), "table").when(s.rlike(LIST_ITEM), "list")
        .when(_looks_like_formula(s), "formula").otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    # a line set in goes on with the list above it, if no blank line stands between
    run = F.sum((s == "").cast("int")).over(ordered)
    rows = rows.withColumn("run", run)
    plain = (F.col("kind") == "paragraph") & F.col("line").rlike(r"^[ \t]")
    above = F.last(F.when(~plain, F.col("kind")), ignorenulls=True).over(Window.partitionBy("doc_id", "run").orderBy("i"))
    return rows.select("doc_id", "i", "line", F.when(plain & (above == "list"), "list").otherwise(F.col("kind")).alias("type"), (F.col("before") % 2 == 1).alias("open"))


def islands(docs: DataFrame) -> DataFrame:
    """doc_id, block_order, block_type, text, heading_level: lines that belong together."""
    ordered = Window.partitionBy("doc_id").orderBy("i")
    rows = typed_lines(docs)
    before = F.lag("type").over(ordered)
    begins = F.col("type").isNotNull() & (before.isNull() | (before != F.col("type")) | F.col("type").isin(*SINGLE) | ((F.col("type") == "code") & ~F.col("open") & ~F.coalesce(F.lag("open").over(ordered), F.lit(False)) & (F.lag("type").over(ordered) != "code")))
    rows = rows.withColumn("block", F.sum(begins.cast("int")).over(ordered)).where(F.col("type").isNotNull())
    found = rows.groupBy("doc_id", (F.col("block") - 1).cast("int").alias("block_order")).agg(F.first("type").alias("block_type"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    text = F.trim(F.array_join(F.transform("l", lambda x: x.line), "\n"))
    heading = F.col("block_type") == "section_header"
    return found.select("doc_id", "block_order", "block_type", F.when(heading, F.regexp_extract(text, HEADING, 2)).otherwise(text).alias("text"), F.when(heading, F.length(F.regexp_extract(text, HEADING, 1))).alias("heading_level"))


def with_paths(found: DataFrame) -> DataFrame:
    """Blocks with section_path, the headings in force at each; a document's `title`, where it has one, stands on top until a first-level heading."""
    number = F.sum((F.col("block_type") == "section_header").cast("int")).over(Window.partitionBy("doc_id").orderBy("block_order"))
    path = F.coalesce("section_path", root(found), F.array().cast("array<string>"))
    names = [c for c in found.columns if c != "section_path"]
    return found.withColumn("n", number).join(section_paths(found), ["doc_id", "n"], "left").select(*names, path.alias("section_path"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_order, block_type, text, heading_level, section_path."""
    return with_paths(islands(docs))


def root(found: DataFrame) -> Column:
    return F.array_compact(F.array(F.nullif("title", F.lit("")))) if "title" in found.columns else F.array().cast("array<string>")


def section_paths(found: DataFrame) -> DataFrame:
    """doc_id, n, section_path after the n-th heading: level 1 starts anew, others keep the first level - 1 titles."""
    found = found.select("doc_id", "block_order", "block_type", "heading_level", "text", root(found).alias("root"))
    heads = found.where("block_type = 'section_header'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_order", "heading_level", "text"))).alias("h"), F.min("root").alias("root"))
    start = F.array().cast("array<array<string>>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.col("root"))
    fold = F.aggregate("h", start, lambda a, x: F.concat(a, F.array(F.when(x.heading_level <= 1, F.array(x.text)).otherwise(F.concat(F.slice(last(a), 1, F.least(x.heading_level - 1, F.size(last(a)))), F.array(x.text))))))
    return heads.select("doc_id", F.posexplode(fold).alias("n", "section_path")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "section_path")


def linearize_table(text) -> Column:
    """Table columns: a, b / Row i: a=x; b=y; - blank cells go, short rows are padded."""
    cells = lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda s: F.trim(s))
    rows = F.filter(F.split(text, "\n"), lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(ALIGNMENT))
    head, body = cells(F.try_element_at(rows, F.lit(1))), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    line = lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.filter(F.zip_with(head, cells(r), lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.coalesce(h, F.lit("")), F.lit("="), v))), lambda x: x.isNotNull()), "; "))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Table columns: "), F.array_join(head, ", "))), F.transform(body, line)), "\n")


def clean(c) -> Column:
    """Line ends made one kind, words joined over a hyphen and line end, tabs and hard blanks plain, at most one blank line."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]", " "), r"\n{3,}", "\n\n")
    return F.trim(t)


def repeated_lines(docs: DataFrame, most: int = 80) -> DataFrame:
    """Short lines that a document repeats: what running headers and footers look like."""
    rows = docs.select("doc_id", F.explode(F.split("text", r"\n")).alias("line")).select("doc_id", F.lower(normalize("line")).alias("line"))
    return rows.where((F.length("line") > 0) & (F.length("line") <= most)).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1")

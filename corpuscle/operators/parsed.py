"""What page parsers return, as tables: texts with page separators into pages, boxes, tables and images into layout items.

Entries are JSON (parsed as VARIANT): texts, or objects that name their text, type and box in one of several ways.  The
items go into `layout.layout_blocks`, the pages into `layout.page_documents`.  A page's entries are numbered within the
page only.  Null or broken JSON is an empty list, and an entry that is neither a text nor an object, or says nothing, is no
item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import strip

# The separator after a page, and the names that entries give to their parts, the first one present counting.
PAGE_END = r"(?i)\n+--- end of page=(\d+) ---\n+"
TEXT_KEYS, LINE_KEYS = ("text", "content", "markdown", "value"), ("text", "content", "value")
TYPE_KEYS, ID_KEYS, BOX_KEYS = ("type", "kind", "block_type", "label"), ("id", "block_id", "number"), ("bbox", "box", "rect")
CORNERS = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"))
NAMES = ("x0", "y0", "x1", "y1")


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page_number, page_label, text: pages of texts with separators.

    A separator stands on a line of its own and names the page that ends there; the next one's number is one more.  What stands
    before the first is page 1 if it isn't blank.  A text without separators is page 1; a null text has no page.
    """
    said = F.col(text).cast("string")
    parts = F.split(said, PAGE_END)
    ends = F.regexp_extract_all(said, F.lit(PAGE_END), F.lit(1))
    paired = F.zip_with(parts, F.concat(F.array(F.lit("0")), ends), lambda p, n: F.struct(strip(p).alias("text"), n.alias("n")))
    rows = docs.where(said.isNotNull()).select("doc_id", (~said.rlike(PAGE_END)).alias("alone"), F.posexplode(paired).alias("i", "x"))
    rows = rows.where((F.col("i") > 0) | (F.col("x.text") != "") | F.col("alone"))
    number = F.when(F.col("i") == 0, 1).otherwise(F.col("x.n").try_cast("int") + 1)
    return rows.select("doc_id", number.alias("page_number"), number.cast("string").alias("page_label"), "x.text")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _at(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _words(value: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys whose value is a text that isn't blank, stripped."""
    return F.coalesce(*(F.when(_is(_at(value, k), "STRING"), F.nullif(strip(F.try_variant_get(value, f"$.{k}", "string")), F.lit(""))) for k in keys))


def _named(value: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys whose value isn't null, empty or 0, as text."""
    told = [F.try_variant_get(value, f"$.{k}", "string") for k in keys]
    return F.coalesce(*(F.when(~x.isin("", "0", "false"), x) for x in told))


def entry_text(value: Column) -> Column:
    """Text of an object: by its keys, else its lines that aren't blank; null if there is none."""
    one = lambda x: F.when(_is(x, "STRING"), F.nullif(strip(F.try_variant_get(x, "$", "string")), F.lit(""))).when(_is(x, "OBJECT"), _words(x, LINE_KEYS))
    rows = F.filter(F.transform(F.try_variant_get(value, "$.lines", "array<variant>"), one), lambda x: x.isNotNull())
    return F.coalesce(_words(value, TEXT_KEYS), F.nullif(F.array_join(rows, "\n"), F.lit("")))


def bbox(value: Column) -> Column:
    """x0, y0, x1, y1 of a box given by those names, by left, top, right and bottom, or by a list of four; else null."""

    def read(box: Column) -> Column:
        shapes = [[F.try_variant_get(box, f"$.{n}", "double") for n in names] for names in CORNERS] + [[F.try_variant_get(box, f"$[{i}]", "double") for i in range(4)]]
        whole = [F.when(F.forall(F.array(*c), lambda x: x.isNotNull()), F.struct(*(x.alias(n) for x, n in zip(c, NAMES, strict=True)))) for c in shapes]
        return F.coalesce(*whole)

    # the first key that is there decides, whether its box can be read or not
    first = F.lit(None).cast("variant")
    for key in reversed(BOX_KEYS):
        first = F.when(_at(value, key).isNotNull() & ~_is(_at(value, key), "VOID"), _at(value, key)).otherwise(first)
    return read(first)


def _entries(pages: DataFrame, column: str) -> DataFrame:
    listed = F.try_variant_get(F.try_parse_json(F.col(column).cast("string")), "$", "array<variant>")
    return pages.select("doc_id", "page", F.posexplode(listed).alias("i", "v"))


def _number(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("i")) - 1)


def layout_items(pages: DataFrame) -> DataFrame:
    """doc_id, page, item_order, item_type, text, x0, y0, x1, y1, parser_block_id.

    pages: doc_id, page, boxes, tables, images (JSON arrays), a row a page.  Tables are added to a page only if none of its
    boxes is a table, images only if none is an image or a figure; they follow the boxes.
    """
    pages = pages.select("doc_id", "page", "boxes", "tables", "images")
    v = F.col("v")
    boxes = _entries(pages, "boxes").where(_is(v, "STRING") | _is(v, "OBJECT"))
    text = F.when(_is(v, "STRING"), F.nullif(strip(F.try_variant_get(v, "$", "string")), F.lit(""))).otherwise(entry_text(v))
    own = F.when(_is(v, "OBJECT"), F.coalesce(_named(v, ID_KEYS), F.concat(F.lit("box-"), F.col("i").cast("string"))))
    boxes = boxes.select("doc_id", "page", F.col("i").alias("item_order"), F.when(_is(v, "OBJECT"), _named(v, TYPE_KEYS)).alias("item_type"), text.alias("text"), bbox(v).alias("b"), own.alias("parser_block_id")).where("text is not null")

    rows = F.coalesce(*(F.when(F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")) > 0, F.to_json(_at(v, k))) for k in ("rows", "data")))
    tables = _entries(pages, "tables").where(_is(v, "OBJECT")).withColumn("text", F.coalesce(entry_text(v), rows)).where("text is not null")
    alt, src, caption = _named(v, ("alt", "caption", "title", "text")), _named(v, ("src", "path", "image_path")), F.nullif(strip(F.try_variant_get(v, "$.caption", "string")), F.lit(""))
    shown = F.when(alt.isNotNull() | src.isNotNull(), F.concat(F.lit("!["), F.coalesce(alt, F.lit("")), F.lit("]("), F.coalesce(src, F.lit("")), F.lit(")")))
    images = _entries(pages, "images").where(_is(v, "OBJECT")).withColumn("text", F.nullif(F.concat_ws("\n", shown, caption), F.lit(""))).where("text is not null")

    page = ["doc_id", "page"]
    held = boxes.groupBy(*page).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("item_type") == "table", F.lit(False))).alias("tabled"), F.max(F.coalesce(F.col("item_type").isin("image", "figure"), F.lit(False))).alias("pictured"))
    added = _number(tables.withColumn("kind", F.lit("table"))).unionByName(_number(images.withColumn("kind", F.lit("image"))))
    added = added.join(held, page, "left").where(F.when(F.col("kind") == "table", ~F.coalesce("tabled", F.lit(False))).otherwise(~F.coalesce("pictured", F.lit(False))))
    before = F.coalesce(F.count(F.when(F.col("kind") == "table", 1)).over(Window.partitionBy(*page)), F.lit(0))  # images follow the tables
    order = (F.coalesce("n", F.lit(0)) + F.col("k") + F.when(F.col("kind") == "image", before).otherwise(0)).cast("int")
    added = added.withColumn("item_order", order).select(*page, "item_order", F.col("kind").alias("item_type"), "text", bbox(v).alias("b"), F.coalesce(_named(v, ("id",)), F.concat_ws("-", "kind", F.col("item_order").cast("string"))).alias("parser_block_id"))
    return boxes.unionByName(added).select(*page, "item_order", "item_type", "text", *(F.col(f"b.{n}").alias(n) for n in NAMES), "parser_block_id")


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages: different page numbers of each document, or its rows where none has a number."""
    n = F.count_distinct("page_number")
    return pages.groupBy("doc_id").agg(F.when(n > 0, n).otherwise(F.count("*")).alias("n_pages"))

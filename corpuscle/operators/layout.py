"""Pages into documents: reading order of layout items, their types, page markers, and blocks across pages.

Items: doc_id, page, item_order, item_type, text, x0, y0, and where they have them page_height, heading_level, title.
Pages: doc_id, page_number, page_label, text, and title where there is one.  A page's items, which end up in one array,
are as many as a page has; documents and their pages are spread over tasks freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import clean_ingest, let, strip

from . import blocks as lines
from .markup import CAPTION_LINE, image_text, linearize_rows, looks_like_formula

# What a page marker and an image line look like, and the types that layout items go by.
PAGE_MARKER = r"(?iU)^(?:\d+|page\s+\d+|\d+\s*/\s*\d+)$"
MARKDOWN_IMAGE = r"^!\[([^\]]*)\]\(([^)\s]+)(?:\s+[\"'](.*?)[\"'])?\)$"
HTML_IMAGE = r"(?i)^<img\s+([^>]+?)\s*/?>$"
TABLE_ROW, ALIGNMENT = r"^\|.*\|$", r"^:?-{3,}:?$"
ITEM_TYPES = {
    "title": "section_header", "heading": "section_header", "header": "section_header", "text": "paragraph", "para": "paragraph", "paragraph": "paragraph", "table": "table", "image": "image",
    "figure": "image", "caption": "caption", "code": "code", "formula": "formula", "equation": "formula", "list": "list", "bullet": "list",
}


def tolerance(height: Column) -> Column:
    """How far apart tops of one band may be: a share of the page's height within bounds."""
    return F.when(F.coalesce(height, F.lit(0.0)) > 0, F.least(F.lit(18.0), F.greatest(F.lit(6.0), height * 0.008))).otherwise(10.0)


def reading_order(items: DataFrame) -> DataFrame:
    """Items with band and position: bands from the top of the page, each from left to right.

    Sorted by their tops, items join the last band while they are within the tolerance of its first item's; one without
    a box stands at the height of its order, in a band of its own, and doesn't end the one before.
    """
    boxed = F.col("y0").isNotNull()
    height = F.col("page_height").cast("double") if "page_height" in items.columns else F.lit(None).cast("double")
    at = F.struct(F.coalesce(F.col("y0").cast("double"), F.col("item_order").cast("double")).alias("y"), F.coalesce(F.col("x0").cast("double"), F.lit(0.0)).alias("x"), F.col("item_order").alias("o"), boxed.alias("boxed"), F.struct(*(c for c in items.columns if c not in ("doc_id", "page"))).alias("item"))
    pages = items.withColumn("_at", at).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("_at")).alias("items"), tolerance(F.max(height)).alias("tolerance"))
    start = F.struct(F.array().cast("array<int>").alias("bands"), F.lit(0).alias("next"), F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("of"))

    def place(a: Column, x: Column) -> Column:
        joins = x["boxed"] & a["anchor"].isNotNull() & (x["y"] - a["anchor"] <= F.col("tolerance"))
        fresh = F.coalesce(~joins, F.lit(True))
        band = F.when(fresh, a["next"]).otherwise(a["of"])
        opens = fresh & x["boxed"]
        return F.struct(F.concat(a["bands"], F.array(band)).alias("bands"), (a["next"] + fresh.cast("int")).alias("next"), F.when(opens, x["y"]).otherwise(a["anchor"]).alias("anchor"), F.when(opens, band).otherwise(a["of"]).alias("of"))

    bands = F.aggregate("items", start, place, lambda a: a["bands"])
    told = F.zip_with("items", bands, lambda x, b: F.struct(b.alias("band"), x["x"].alias("x"), x["o"].alias("o"), x["item"].alias("item")))
    rows = pages.select("doc_id", "page", F.posexplode(F.array_sort(told)).alias("position", "x"))
    return rows.select("doc_id", "page", "position", F.col("x.band").alias("band"), "x.item.*")


def image_fields(line: Column) -> Column:
    """alt, source and title of a Markdown image or an HTML img; null for any other line."""
    filled = lambda c: F.nullif(strip(c), F.lit(""))
    told = lambda i: filled(F.regexp_extract(line, MARKDOWN_IMAGE, i))
    inner = F.regexp_extract(line, HTML_IMAGE, 1)
    attr = lambda name: filled(F.regexp_extract(inner, rf"(?i)(?<![\w:.-]){name}\s*=\s*[\"'](.*?)[\"']", 1))
    html = F.struct(attr("alt").alias("alt"), attr("src").alias("source"), attr("title").alias("title"))
    some = F.coalesce(html["alt"], html["source"], html["title"]).isNotNull()
    return F.when(line.rlike(MARKDOWN_IMAGE), F.struct(told(1).alias("alt"), told(2).alias("source"), told(3).alias("title"))).when(line.rlike(HTML_IMAGE) & some, html)


def markdown_table(text: Column) -> Column:
    """headers and rows of lines between bars: the first line holds the headers if a line of dashes follows, else columns are numbered."""
    cells = lambda s: F.transform(F.split(F.regexp_replace(strip(s), r"^\|+|\|+$", ""), r"\|"), lambda c: strip(c))
    rows = F.transform(F.filter(F.split(text, "\n"), lambda s: strip(s).rlike(TABLE_ROW)), cells)

    def shape(r: Column) -> Column:
        ruled = (F.size(r) > 1) & F.forall(F.coalesce(F.get(r, F.lit(1)), F.array().cast("array<string>")), lambda c: c.rlike(ALIGNMENT))
        named = F.transform(r[0], lambda _, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
        return F.struct(F.when(ruled, r[0]).otherwise(named).alias("headers"), F.when(ruled, F.slice(r, 3, F.greatest(F.size(r) - 2, F.lit(0)))).otherwise(r).alias("rows"))

    return let(rows, shape)


def item_type(kind: Column, text: Column) -> Column:
    """The block type of a layout item: its own name's, or for a missing one what its text looks like."""
    name = F.regexp_replace(strip(F.lower(kind)), "[- ]", "_")
    known = F.create_map(*(F.lit(x) for kv in ITEM_TYPES.items() for x in kv))
    guess = F.when(text.rlike(CAPTION_LINE), "caption").when(image_fields(strip(text)).isNotNull(), "image").when(strip(text).rlike(TABLE_ROW), "table").when(looks_like_formula(strip(text)), "formula").otherwise("paragraph")
    return F.when(F.coalesce(kind, F.lit("")) == "", guess).otherwise(F.coalesce(F.try_element_at(known, name), name))


def layout_blocks(items: DataFrame) -> DataFrame:
    """doc_id, block_order, page, block_type, text, heading_level, section_path, layout_role, caption_text, image fields, table fields; items without text go."""
    rows = reading_order(items).withColumn("text", clean_ingest("text")).where("text <> ''")
    said, kind = F.col("text"), item_type(F.col("item_type"), F.col("text"))
    formula = (kind == "formula") | (looks_like_formula(strip(said)) & ~kind.isin("section_header", "caption", "image", "table"))
    typed = F.when(formula, "formula").when(kind.isin("section_header", "caption", "image", "table", "list", "code"), kind).otherwise("paragraph")
    own = F.col("heading_level").cast("int") if "heading_level" in rows.columns else F.lit(None).cast("int")
    marks = F.length(F.regexp_extract(said, lines.HEADING, 1))
    rows = rows.withColumns({"block_type": typed, "image": image_fields(said)})
    header = F.col("block_type") == "section_header"
    tabular = (F.col("block_type") == "table") & strip(F.get(F.split(said, "\n"), F.lit(0))).rlike(TABLE_ROW)
    rows = rows.withColumns({"cells": F.when(tabular, markdown_table(said)), "heading_level": F.when(header, F.coalesce(F.nullif(own, F.lit(0)), F.nullif(marks, F.lit(0)), F.lit(1)))})
    title = F.regexp_extract(said, lines.HEADING, 2)
    shown = F.when(header & (title != ""), title).when(tabular, linearize_rows(F.col("cells.headers"), F.col("cells.rows"))).when((F.col("block_type") == "image") & F.col("image").isNotNull(), image_text(F.col("image.alt"), F.col("image.source"), F.col("image.title"))).otherwise(said)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "position")) - 1
    rows = rows.select(
        "doc_id", order.alias("block_order"), "page", "block_type", shown.alias("text"), "heading_level", *(["title"] if "title" in rows.columns else []), F.when(F.col("block_type") == "caption", "caption").otherwise("body").alias("layout_role"),
        F.when((F.col("block_type") == "caption") & said.rlike(CAPTION_LINE), said).alias("caption_text"), *(F.col(f"image.{n}").alias(c) for n, c in (("alt", "image_alt_text"), ("source", "image_source"), ("title", "image_title"))),
        F.array_join("cells.headers", ", ").alias("table_headers"), F.size("cells.rows").alias("table_row_count"),
    )
    return lines.with_paths(rows)


def page_documents(pages: DataFrame, markers: bool = True) -> DataFrame:
    """doc_id, block_order, page, block_type, text, heading_level, section_path, layout_role, marker_detected.

    A page's marker is its first line if that is one, which then leaves the text, else its label, else its number.  Blocks
    end with their page; headings hold on over the pages of a document.
    """
    title = F.col("title").cast("string") if "title" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("doc_id", title.alias("title"), F.col("page_number").alias("page"), F.col("page_label").cast("string").alias("label"), clean_ingest(F.coalesce("text", F.lit(""))).alias("text"))
    first = strip(F.substring_index("text", "\n", 1))
    rows = rows.withColumn("found", first.rlike(PAGE_MARKER))
    rows = rows.select("doc_id", "title", "page", "found", F.when(F.col("found"), first).otherwise(F.coalesce(F.nullif("label", F.lit("")), F.col("page").cast("string"))).alias("marker"), "text")
    kept = F.when(F.col("found") & F.lit(markers), F.when(F.contains("text", F.lit("\n")), F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise("")).otherwise(F.col("text"))
    told = lines.islands(rows.select(F.struct("doc_id", "page", "title").alias("doc_id"), kept.alias("text")))
    found = told.select("doc_id.*", "block_order", "block_type", "text", "heading_level", F.lit(None).cast("boolean").alias("marker_detected"))
    if markers:
        marks = rows.where("marker is not null").select("doc_id", "page", "title", F.lit(-1).alias("block_order"), F.lit("page_marker").alias("block_type"), F.col("marker").alias("text"), F.lit(None).cast("int").alias("heading_level"), F.col("found").alias("marker_detected"))
        found = found.unionByName(marks)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_order")) - 1
    role = F.when(F.col("block_type").isin("page_marker", "caption"), F.col("block_type")).otherwise("body")
    return lines.with_paths(found.withColumns({"block_order": order, "layout_role": role})).drop("title")

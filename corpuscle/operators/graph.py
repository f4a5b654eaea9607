"""Blocks of documents and the edges between them.

Blocks: doc_id, page, block_order (in the order of the document), block_type, text, section_path.  A document's blocks
meet by windows and equi-joins on its id; nothing pairs all blocks of a page or a section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import normalize

# Weights of the edge types, what a reference and a caption look like, which reference names which block.
WEIGHTS = {"caption_of": 0.98, "has_caption": 0.98, "section_parent": 0.95, "section_child": 0.95, "references": 0.90, "referenced_by": 0.90, "formula_explains": 0.88, "table_row_context": 0.86, "continued_from": 0.80, "next_block": 0.72, "prev_block": 0.72}
REFERENCE = r"(?i)(figure|fig\.?|table|equation|formula|eq\.?|图|表|公式)\s*([0-9]+(?:\.[0-9]+)*)"
CAPTION_KIND = r"(?i)^(?:caption:\s*)?(figure|fig\.?|table|image|equation|formula|eq\.?|图片|图|表|公式)"
KINDS = {"image": "figure", "table": "table", "formula": "formula"}
#: Parts of a page near its edges, and the size of a short text there.
TOP, BOTTOM, NOTE, SHORT = 0.12, 0.88, 0.9, 80


def lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines as blocks: doc_id, block_order (from 0), text."""
    split = docs.select("doc_id", F.posexplode(F.split("text", r"\R")).alias("i", "text"))
    kept = split.where(F.trim("text") != "")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return kept.select("doc_id", order.alias("block_order"), "text")


def _kind(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.startswith("fig") | low.isin("image", "图", "图片"), "figure").when(low.startswith("table") | (low == "表"), "table").when(low != "", "formula")


def _edge(kind: str, source, target) -> Column:
    return F.struct(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("edge_type"), F.lit(WEIGHTS[kind]).alias("weight"))


def _edges(rows: DataFrame, *edges: Column) -> DataFrame:
    """doc_id, source, target, edge_type, weight; edges without a target go."""
    return rows.select("doc_id", F.explode(F.array(*edges)).alias("e")).select("doc_id", "e.*").where("source IS NOT NULL AND target IS NOT NULL")


def neighbors(blocks: DataFrame) -> DataFrame:
    """next_block and prev_block edges in the order of a page, or of the document where blocks have no page."""
    order = Window.partitionBy("doc_id", *(["page"] if "page" in blocks.columns else [])).orderBy("block_order")
    both = blocks.select("doc_id", "block_order", F.lead("block_order").over(order).alias("next"), F.lag("block_order").over(order).alias("prev"))
    return _edges(both, _edge("next_block", "block_order", "next"), _edge("prev_block", "block_order", "prev"))


def references(blocks: DataFrame) -> DataFrame:
    """doc_id, block_order, kind, number: what a block's text refers to."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(2)).alias("number"))
    return blocks.select("doc_id", "block_order", F.explode(pairs).alias("r")).select("doc_id", "block_order", _kind(F.col("r.kind")).alias("kind"), F.col("r.number").alias("number")).distinct()


def identified(blocks: DataFrame) -> DataFrame:
    """Blocks with the kind and number of the first reference in their text, null without one."""
    number = F.nullif(F.regexp_extract("text", REFERENCE, 2), F.lit(""))
    return blocks.withColumns({"kind": _kind(F.regexp_extract("text", REFERENCE, 1)), "number": number})


def _last(rows: DataFrame, *more: str) -> DataFrame:
    """The last target of each kind and number of a document."""
    return rows.groupBy("doc_id", "kind", "number").agg(F.max_by(F.struct("target", *more), "at").alias("t")).select("doc_id", "kind", "number", "t.*")


def numbered(blocks: DataFrame) -> DataFrame:
    """doc_id, kind, number, target, target_type: images, tables and formulas that name themselves."""
    named = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    typed = identified(blocks).where(F.col("block_type").isin(*KINDS) & (F.col("kind") == named[F.col("block_type")]))
    return _last(typed.select("doc_id", "kind", "number", F.col("block_order").alias("target"), F.col("block_type").alias("target_type"), F.col("block_order").alias("at")), "target_type")


def caption_targets(blocks: DataFrame) -> DataFrame:
    """doc_id, block_order, kind, number, target, target_type: each caption's block.

    The one of its kind and number, or else the nearest of its page that fits its kind, the earlier of two as near.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("block_order")
    here = lambda t: F.when(F.col("block_type") == t, F.col("block_order"))
    before, after = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(1, Window.unboundedFollowing)
    sides = {f"{side}_{t}": f(here(t), ignorenulls=True).over(w) for t in KINDS for side, f, w in (("b", F.last, before), ("a", F.first, after))}
    caption = blocks.withColumns(sides).where("block_type = 'caption'").withColumn("expected", _kind(F.regexp_extract("text", CAPTION_KIND, 1)))
    found = [F.when((F.col("expected").isNull() | (F.col("expected") == k)) & F.col(f"{s}_{t}").isNotNull(), F.struct(F.abs(F.col(f"{s}_{t}") - F.col("block_order")).alias("d"), F.col(f"{s}_{t}").alias("target"), F.lit(t).alias("target_type"))) for t, k in KINDS.items() for s in "ba"]
    caption = identified(caption.withColumn("near", F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull())))).select("doc_id", "block_order", "kind", "number", "near")
    exact = numbered(blocks).withColumnsRenamed({"target": "t", "target_type": "tt"})
    met = caption.join(exact, ["doc_id", "kind", "number"], "left")
    return met.select("doc_id", "block_order", "kind", "number", F.coalesce("t", "near.target").alias("target"), F.coalesce("tt", "near.target_type").alias("target_type")).where("target IS NOT NULL")


def caption_edges(blocks: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """caption_of and has_caption, and table_row_context from a caption to its table."""
    t = targets if targets is not None else caption_targets(blocks)
    t = t.withColumn("table", F.when(F.col("target_type") == "table", F.col("target")))
    return _edges(t, _edge("caption_of", "block_order", "target"), _edge("has_caption", "target", "block_order"), _edge("table_row_context", "block_order", "table"))


def captions(blocks: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """doc_id, block_order, caption_text: the text of the last caption of each block that has one."""
    t = targets if targets is not None else caption_targets(blocks)
    texts = blocks.where("block_type = 'caption'").select("doc_id", "block_order", "text")
    return t.join(texts, ["doc_id", "block_order"]).groupBy("doc_id", F.col("target").alias("block_order")).agg(F.max_by("text", "block_order").alias("caption_text"))


def captioned(blocks: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Blocks with caption_text: that of the last caption of each."""
    return blocks.join(captions(blocks, targets), ["doc_id", "block_order"], "left")


def reference_edges(blocks: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """references and referenced_by for what a text refers to, and formula_explains; a captioned block counts under its caption's number."""
    captions = targets if targets is not None else caption_targets(blocks)
    known = numbered(blocks).select("doc_id", "kind", "number", "target", F.struct(F.lit(0).alias("rank"), F.col("target").alias("o")).alias("at"))
    known = _last(known.union(captions.where("number IS NOT NULL").select("doc_id", "kind", "number", "target", F.struct(F.lit(1).alias("rank"), F.col("block_order").alias("o")).alias("at"))))
    met = references(blocks.where(F.col("block_type").isin("paragraph", "list", "code", "caption"))).join(known, ["doc_id", "kind", "number"])
    met = met.withColumn("formula", F.when(F.col("kind") == "formula", F.col("target")))
    return _edges(met, _edge("references", "block_order", "target"), _edge("referenced_by", "target", "block_order"), _edge("formula_explains", "block_order", "formula"))


def section_edges(blocks: DataFrame) -> DataFrame:
    """section_parent and section_child: a block and the last header before it of its section path, a header and that of the path above."""
    header, path = F.col("block_type") == "section_header", F.col("section_path")
    look = F.when(header, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    keys = F.array(F.struct(look.alias("path"), F.lit(True).alias("asks")), F.when(header, F.struct(path.alias("path"), F.lit(False).alias("asks"))))
    rows = blocks.select("doc_id", "block_order", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("doc_id", "block_order", "k.*").where(F.size("path") > 0)
    above = Window.partitionBy("doc_id", "path").orderBy("block_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("parent", F.last(F.when(~F.col("asks"), F.col("block_order")), ignorenulls=True).over(above)).where("asks")
    return _edges(rows, _edge("section_parent", "block_order", "parent"), _edge("section_child", "parent", "block_order"))


def continued_edges(blocks: DataFrame) -> DataFrame:
    """continued_from: of two text blocks in a row, on pages in a row, of one type and path, the second goes on with the first."""
    rows = blocks.where(F.col("block_type").isin("paragraph", "list", "table", "formula"))
    order = Window.partitionBy("doc_id").orderBy("page", "block_order")
    rows = rows.select("doc_id", "block_order", "page", "block_type", "section_path", F.trim("text").alias("s")).withColumn("p", F.lag(F.struct("block_order", "page", "block_type", "section_path", "s")).over(order))
    goes_on = (F.col("p.s") != "") & (F.col("s") != "") & (F.col("p.s").rlike(r"[:,(\[]$") | F.col("s").rlike(r"^\p{Ll}"))
    rows = rows.where((F.col("page") == F.col("p.page") + 1) & (F.col("block_type") == F.col("p.block_type")) & (F.col("section_path") == F.col("p.section_path")) & goes_on)
    return _edges(rows.withColumn("before", F.col("p.block_order")), _edge("continued_from", "block_order", "before"))


def near(blocks: DataFrame, share: float = 0.18, keep: int = 4) -> DataFrame:
    """blocks: page, block_id, cx, cy, diagonal -> the nearest blocks of the page within a share of its diagonal.

    Blocks meet only in cells as wide as that distance: each looks into its own and the eight around it.  cx and cy are a
    block's centre; diagonal is one for a page.
    """
    width = F.greatest(F.col("diagonal") * share, F.lit(1e-9))
    rows = blocks.select("page", "block_id", "cx", "cy", "diagonal", F.floor(F.col("cx") / width).alias("ix"), F.floor(F.col("cy") / width).alias("iy"))
    around = F.explode(F.array(*(F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    asks = rows.select("page", F.col("block_id").alias("source"), F.col("cx").alias("x"), F.col("cy").alias("y"), "diagonal", around.alias("c")).select("page", "source", "x", "y", "diagonal", "c.*")
    pairs = asks.join(rows.select("page", F.col("block_id").alias("target"), "cx", "cy", "ix", "iy"), ["page", "ix", "iy"]).where("source <> target")
    pairs = pairs.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))).where(F.col("d") <= share * F.col("diagonal"))
    order = Window.partitionBy("page", "source").orderBy("d", "target")
    found = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return found.select("page", "source", "target", F.bround(F.greatest(F.lit(0.3), 1 - F.col("d") / F.greatest("diagonal", F.lit(1.0))), 4).alias("weight"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair and type, of the largest weight."""
    return edges.groupBy("doc_id", "source", "target", "edge_type").agg(F.max("weight").alias("weight"))


def relations(blocks: DataFrame) -> DataFrame:
    """All edges that need no places on a page, one for each pair and type."""
    targets = caption_targets(blocks)
    found = [neighbors(blocks.where("block_type <> 'page_marker'")), section_edges(blocks), caption_edges(blocks, targets), reference_edges(blocks, targets), continued_edges(blocks)]
    return distinct_edges(reduce(DataFrame.unionByName, found))


def outgoing(edges: DataFrame) -> DataFrame:
    """Edges of each block by falling weight, and its neighbours in that order."""
    rows = edges.withColumn("o", F.struct((-F.col("weight")).alias("w"), "edge_type", "target"))
    sorted_ = F.array_sort(F.collect_list("o"))
    return rows.groupBy("doc_id", "source").agg(F.transform(sorted_, lambda x: F.concat_ws(":", x.edge_type, x.target)).alias("edges"), F.array_distinct(F.transform(sorted_, lambda x: x.target)).alias("neighbors"))


def layout_roles(blocks: DataFrame) -> DataFrame:
    """blocks with y0, y1, page_height -> layout_role, excluded_from_body.

    A short text that a document repeats is a header at the top of a page and a footer at its end, unless it refers to
    something; another short text at the very end is a footnote.
    """
    text = F.lower(normalize("text"))
    short = F.length(text).between(1, SHORT)
    rows = blocks.withColumns({"_short": short, "_text": F.when(short, text)})
    again = F.coalesce(F.count("_text").over(Window.partitionBy("doc_id", "_text")) > 1, F.lit(False))
    height = F.greatest("page_height", F.lit(1.0))
    placed = F.col("y0").isNotNull() & F.col("y1").isNotNull() & (F.coalesce("page_height", F.lit(0.0)) > 0)
    runs = placed & F.col("_again") & F.col("_short") & ~F.col("text").rlike(REFERENCE)
    role = (
        F.when(F.col("block_type").isin("page_marker", "caption"), F.col("block_type"))
        .when(runs & (F.col("y0") / height <= TOP), "header").when(runs & (F.col("y1") / height >= BOTTOM), "footer")
        .when(placed & F.col("_short") & (F.col("y1") / height >= NOTE), "footnote").otherwise("body")
    )
    return rows.withColumn("_again", again).withColumn("layout_role", role).withColumn("excluded_from_body", F.col("layout_role").isin("header", "footer")).drop("_short", "_text", "_again")

"""Blocks and their edges into child chunks with assembled parents.

Blocks: doc_id, block_order, text, and where they have them block_type, layout_role, excluded_from_body, page, title,
section_path, block_id, caption_text, image_title, image_alt_text, table_headers, table_row_count.
Edges: doc_id, source, target (block orders), edge_type, weight.
A document's blocks meet only along its edges: sizes travel to pick what a parent holds, texts only to those picked.
Both inputs are read several times: write them as tables first where they are costly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import anchors, child_key, let, normalize, snippet, word_pieces

from .chunking import BUDGET, bounded_text, code_units, pack, table_chunks
from .splitter import recursive_split

# Edges along which a parent grows, how many blocks and word pieces it may take, what counts as a symbol.
PARENT_EDGES = ("has_caption", "caption_of", "references", "referenced_by", "formula_explains", "table_row_context", "continued_from")
MOST_BLOCKS, PARENT_SIZE, INLINE_SIZE = 3, 4, 2
SYMBOL = r"\\sum|\\int|\\frac|\\sqrt|<=|>=|==|!=|=|\^|_|\+|-"
WORD = r"(?U)[\w一-鿿]+"
PARENT = ("content", "related", "block_ids", "relation_types", "strategy", "parent_id", "words", "content_hash", "preview", "available")


def source_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their defaults; blank ones, page markers and what was left out of the body go."""
    text = F.lit(None).cast("string")
    has = lambda c, default=text: F.coalesce(F.col(c), default) if c in blocks.columns else default
    page = F.nullif(F.trim(has("page").cast("string")), F.lit(""))
    empty = F.array().cast("array<string>")
    path = F.filter(has("section_path", empty), lambda x: F.trim(x) != "")
    rows = blocks.select(
        "doc_id", "block_order", has("block_type", F.lit("paragraph")).alias("block_type"), has("layout_role", F.lit("body")).alias("layout_role"), has("excluded_from_body", F.lit(False)).alias("excluded_from_body"),
        F.trim("text").alias("text"), page.alias("page"), has("title").alias("title"), F.when(F.size(path) > 0, path).otherwise(F.array_compact(F.array(F.coalesce(has("title"), has("source_name"))))).alias("section_path"),
        F.coalesce(has("block_id").cast("string"), F.concat_ws(":", "doc_id", F.coalesce(page, F.lit("none")), "block_order")).alias("block_id"),
        *(has(c).cast("string").alias(c) for c in ("caption_text", "image_title", "image_alt_text", "table_headers", "table_row_count")),
    )
    return rows.where((F.col("text") != "") & (F.col("block_type") != "page_marker") & ~F.col("layout_role").isin("header", "footer") & ~F.col("excluded_from_body"))


def _label() -> Column:
    return F.replace("block_type", F.lit("_"), F.lit(" "))


def picked(source: DataFrame, edges: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, block_order, picks (target, edge_type): the blocks a parent adds, by falling weight of their edges.

    At most three, none twice; one that would take the parent beyond four budgets is passed over.
    """
    size = F.regexp_count("text", F.lit(WORD)) + F.regexp_count(_label(), F.lit(WORD))
    sizes = source.select("doc_id", "block_order", size.alias("size"))
    near = edges.where(F.col("edge_type").isin(*PARENT_EDGES) & (F.col("source") != F.col("target"))).withColumnRenamed("target", "block_order")
    near = near.join(sizes, ["doc_id", "block_order"]).withColumnRenamed("block_order", "target")
    best = near.groupBy("doc_id", F.col("source").alias("block_order")).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "edge_type", "target", "size"))).alias("near"))
    start = F.struct(F.col("size").cast("long").alias("size"), F.array().cast("array<struct<target:int,edge_type:string>>").alias("picks"))

    def step(a, x):
        fits = (F.size(a["picks"]) < MOST_BLOCKS) & ~F.exists(a["picks"], lambda p: p["target"] == x["target"]) & (a["size"] + x["size"] <= PARENT_SIZE * budget)
        more = F.concat(a["picks"], F.array(F.struct(x["target"].cast("int").alias("target"), x["edge_type"].alias("edge_type"))))
        return F.struct((a["size"] + F.when(fits, x["size"]).otherwise(0)).cast("long").alias("size"), F.when(fits, more).otherwise(a["picks"]).alias("picks"))

    found = best.join(sizes, ["doc_id", "block_order"]).select("doc_id", "block_order", F.aggregate("near", start, step)["picks"].alias("picks"))
    return found.where(F.size("picks") > 0)


def parents(source: DataFrame, edges: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One parent a block: doc_id, block_order, parent_id, content, related, block_ids, relation_types, strategy, words, content_hash, preview, available.

    Its blocks stand in the order of pages and blocks, each under its type; a block alone is its own content.  A content
    beyond two budgets isn't carried by its chunks but read from the store.
    """
    return with_parents(source, edges, budget).select("doc_id", "block_order", *PARENT)


def with_parents(source: DataFrame, edges: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The source blocks with the fields of their parents."""
    picks = picked(source, edges, budget)
    members = picks.select("doc_id", "block_order", F.explode(F.concat(F.transform("picks", lambda p: p["target"]), F.array(F.col("block_order").cast("int")))).alias("member"))
    place = F.coalesce(F.expr("try_cast(page as int)"), F.lit(1000000000))
    held = source.select("doc_id", F.col("block_order").cast("int").alias("member"), F.struct(place.alias("at"), "block_order", "block_id", _label().alias("label"), "text").alias("b"))
    rows = members.join(held, ["doc_id", "member"]).groupBy("doc_id", "block_order").agg(F.array_sort(F.collect_list("b")).alias("b"))
    content = F.array_join(F.transform("b", lambda x: F.concat(F.lit("["), x["label"], F.lit("]\n"), x["text"])), "\n\n")
    related = F.array_join(F.transform(F.filter("b", lambda x: x["block_order"] != F.col("block_order")), lambda x: x["text"]), " ")
    grown = rows.select("doc_id", "block_order", content.alias("grown"), related.alias("related"), F.transform("b", lambda x: x["block_id"]).alias("ids"))
    found = source.join(picks, ["doc_id", "block_order"], "left").join(grown, ["doc_id", "block_order"], "left")
    found = found.select(*source.columns, F.coalesce("grown", "text").alias("content"), F.coalesce("related", F.lit("")).alias("related"), F.coalesce("ids", F.array("block_id")).alias("block_ids"), F.coalesce(F.transform("picks", lambda p: p["edge_type"]), F.array().cast("array<string>")).alias("relation_types"), F.when(F.col("grown").isNull(), "single_block").otherwise("relation_limited").alias("strategy"))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join("block_ids", ":"), F.lit("parent"))
    found = found.withColumns({"parent_id": F.concat(F.lit("parent-"), F.left(F.sha1(name.cast("binary")), F.lit(16))), "words": word_pieces("content"), "content_hash": F.sha2(F.col("content").cast("binary"), 256), "preview": snippet("content", 240)})
    return found.withColumn("available", F.when(F.col("words") <= INLINE_SIZE * budget, "metadata").otherwise("store"))


def list_groups(text) -> Column:
    """Items of a list: lines, or from one "Level 1:" line to the next where lines have levels."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    joined = F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) == 0) | x.rlike(r"(?i)^Level\s+1:"), F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit("\n"), x)))))
    return F.when(F.exists(lines, lambda x: x.rlike(r"(?i)^Level\s+\d+:")), joined).otherwise(lines)


def splits(budget: int = BUDGET) -> Column:
    """A block's children: structs of text and strategy.  Tables, lists and code by their parts, else whole or by falling separators."""
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit("single_block").alias("strategy")))
    named = lambda texts, name: F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(name).alias("strategy")))
    parts = lambda packed: F.transform(packed, lambda x: x["text"])
    rest = F.when(word_pieces("text") <= budget, whole).otherwise(named(recursive_split("text", budget), "fallback"))
    some = lambda texts, name, fits=lambda x: F.size(x) > 0: let(texts, lambda x: F.when(fits(x), named(x, name)))
    kind = F.col("block_type")
    return F.coalesce(
        F.when(kind == "table", some(parts(table_chunks("text", budget)), "table_rows")), F.when(kind == "list", some(parts(pack(list_groups("text"), budget)), "list_items")),
        F.when(kind == "code", some(code_units("text"), "code_units", lambda x: (F.size(x) > 0) & F.forall(x, lambda u: word_pieces(u) <= budget))), rest,
    )


def _line(label: str, value: Column) -> Column:
    """"Label: value" on one line, null where the value is blank."""
    v = snippet(value)
    return F.when(v != "", F.concat(F.lit(f"{label}: "), v))


def inherited_anchors(child: Column, block: Column, parent: Column) -> Column:
    """A child's anchors, of its own and those of its block and parent; what it lacks comes from its block, then from its parent, unless it names both a clause and a table."""

    def resolved(a: Column) -> Column:
        own = a["clause_id"].isNotNull() & a["table_id"].isNotNull()
        first = lambda f: F.coalesce(a[f], F.when(~own, F.coalesce(block[f], parent[f])))
        terms = F.when(a["has_numeric"] | own, a["numeric_terms"]).when(block["has_numeric"], block["numeric_terms"]).otherwise(parent["numeric_terms"])
        either = lambda f: a[f] | (~own & (block[f] | parent[f]))
        return F.struct(*(first(f).alias(f) for f in ("clause_id", "table_id", "english_alias")), terms.alias("numeric_terms"), (F.size(terms) > 0).alias("has_numeric"), either("is_normative").alias("is_normative"), either("is_anchor").alias("is_anchor"))

    return let(child, resolved)


def context_lines() -> tuple[Column, Column]:
    """Lines on what a block's chunks belong to: those of any block, and all of a table, an image or a formula, null for other types."""
    kind = F.col("block_type")
    top = [_line("Title", F.col("title")), _line("Section", F.array_join("section_path", " > "))]
    caption, context = _line("Caption", F.col("caption_text")), _line("Context", snippet("related", 160))
    symbols = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(SYMBOL), F.lit(0)))), ", ")
    table = [*top, caption, _line("Headers", F.col("table_headers")), _line("Rows", F.col("table_row_count"))]
    image = [*top, _line("Image title", F.col("image_title")), _line("Alt", F.col("image_alt_text")), caption, context]
    formula = [*top, caption, _line("Formula", normalize("text")), _line("Symbols", symbols), context]
    known = F.coalesce("caption_text", "table_headers", "table_row_count").isNotNull()
    none = F.array().cast("array<string>")
    return F.array(*top), F.when(kind == "table", F.when(known, F.array(*table)).otherwise(none)).when(kind == "image", F.array(*image)).when(kind == "formula", F.array(*formula))


def retrieval_text(budget: int = BUDGET) -> Column:
    """The text a chunk is found by: lines on what it belongs to, as many as fit, above a table's, image's, formula's or regulation's own text."""
    a = F.col("anchors")
    law = [_line("Clause", a["clause_id"]), _line("Table", a["table_id"]), _line("English alias", a["english_alias"]), _line("Numeric anchors", F.array_join(a["numeric_terms"], ", "))]
    lines = F.coalesce("typed_lines", F.when(a["is_anchor"], F.concat("top_lines", F.array(*law))), F.array().cast("array<string>"))
    return bounded_text(lines, F.col("child_text"), budget)


def chunks(blocks: DataFrame, edges: DataFrame, budget: int = BUDGET, captions: DataFrame | None = None) -> DataFrame:
    """Child chunks: ids, child_index and child_count, child_text, retrieval_text with its strategy, anchors, and the parent's fields.

    parent_content is null where it is too long to be carried; `parents` is the store that hydration reads.  captions
    (doc_id, block_order, caption_text) take the place of the blocks' own caption_text; they meet each block's row once.
    """
    source = source_blocks(blocks)
    top, typed = context_lines()
    # whatever a block's children share is worked out before they are rows, and its texts go no further
    held = with_parents(source, edges, budget)
    if captions is not None:
        held = held.drop("caption_text").join(captions, ["doc_id", "block_order"], "left")
    # a parent or a child that is the block itself has the block's anchors
    rows = held.withColumn("block_anchors", let(anchors("text"), lambda a: a)).withColumns({
        "children": splits(budget), "parent_anchors": F.when(F.col("strategy") == "single_block", F.col("block_anchors")).otherwise(let(anchors("content"), lambda a: a)), "top_lines": top, "typed_lines": typed, "parent_content": F.when(F.col("available") == "metadata", F.col("content")),
    })
    rows = rows.drop("content", "text").withColumn("child_count", F.size("children"))
    rows = rows.select("*", F.posexplode("children").alias("child_index", "child")).select("*", F.col("child.text").alias("child_text"), F.col("child.strategy").alias("split_strategy")).drop("children", "child")
    rows = rows.withColumn("anchors", inherited_anchors(F.when(F.col("split_strategy") == "single_block", F.col("block_anchors")).otherwise(anchors("child_text")), F.col("block_anchors"), F.col("parent_anchors"))).withColumn("retrieval_text", retrieval_text(budget))
    kind = F.when(F.col("block_type").isin("table", "image", "formula"), F.col("block_type")).otherwise("regulation")
    key = child_key(F.col("doc_id").cast("string"), "block_id", "parent_id", F.col("child_index").cast("string"), "child_text")
    return rows.withColumns({
        "chunk_id": key, "retrieval_strategy": F.when(F.col("retrieval_text") == F.col("child_text"), "original").otherwise(F.concat(kind, F.lit("_enhanced"))), "section_depth": F.size("section_path"),
        "chunk_words": word_pieces("child_text"), "retrieval_words": word_pieces("retrieval_text"),
    }).drop("block_anchors", "parent_anchors", "top_lines", "typed_lines")

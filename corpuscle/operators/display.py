"""What is shown of blocks, chunks and hits: titles, pages, places, ids, output rows, context and traces of answers.

Empty means null, an empty text or an empty list, unless said otherwise.  Items of a section path that are null or blank count as
absent.  All are column expressions; joins are by key, and nothing is gathered beyond one document's or one turn's parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from corpuscle.functions.text import col, let, strip

from .turns import source_key

# Names of loaders and of cleaning rules, what stands for an unknown part, characters that names of files don't have.
LOADERS = {
    "word": "unstructured_word_document_loader",
    "markdown": "unstructured_markdown_loader",
    "csv": "csv_loader",
    "json": "json_loader",
    "txt": "text_loader",
    "web": "web_base_loader",
    "pdf": "pymupdf4llm",
}
TEXT_RULES = ["normalize_newlines", "trim_line_whitespace", "collapse_multi_spaces", "preserve_structure"]
JSON_RULE, HYPHEN_RULE = "json_key_value_normalization", "repair_hyphenated_linebreaks"
PDF_RULES = [*TEXT_RULES, "preserve_page_markers", "reading_order_from_parser", "layout_role_classification", "graph_relationship_projection"]
OCR_RULE = "ocr_fallback"
UNKNOWN = "unknown"
RESERVED = r'[\x00-\x1f<>:"/\\|?*]+'
PARSE_FAILED, INDEX_FAILED, OTHER_FAILED = "parse_failed", "index_failed", "upload_processing_failed"
PARSE_WORDS, INDEX_WORDS = "mineru|loader|parse|decode", "index|faiss|embedding"

_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_INNER = r" \t\x1F\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
HEADING = rf"(?:\A|[{_ENDS}])[{_INNER}]*+(#[^{_ENDS}]*)"


def filled(c) -> Column:
    """The value as text, null if it is empty."""
    return F.nullif(col(c).cast("string"), F.lit(""))


# --- places


def path_items(c) -> Column:
    """Items of a section path."""
    return F.coalesce(F.filter(col(c), lambda x: strip(x) != ""), F.array().cast("array<string>"))


def split_path(c) -> Column:
    """Items of a section path written with slashes."""
    return path_items(F.transform(F.split(col(c), "/"), strip))


def location(path, page, page_or_section) -> Column:
    """Where something stands: its path and page, one of them, or null."""
    told, named = F.coalesce(filled(page), filled(page_or_section)), F.nullif(F.array_join(path_items(path), " > "), F.lit(""))
    return F.when(named.isNull(), told).when(told.isNull(), named).otherwise(F.concat(named, F.lit(" | p"), told))


def chunk_key(chunk_id, own_id, doc_id, path, page, page_or_section, prefix: str) -> Column:
    """The id a hit is known by: its chunk_id, or else its own id; if that is blank, one made of prefix, document, page and path."""
    known = F.coalesce(filled(chunk_id), col(own_id).cast("string"))
    page_name = F.coalesce(filled(page), filled(page_or_section), F.lit("na"))
    made = F.concat_ws("-", F.lit(prefix), F.coalesce(filled(doc_id), F.lit(prefix)), page_name, F.coalesce(F.nullif(F.array_join(path_items(path), "-"), F.lit("")), F.lit("section")))
    return F.when(strip(known) != "", known).otherwise(made)


# --- blocks as documents


def stem(name) -> Column:
    """A name of a file without folders and suffix; a name without suffix stays whole."""
    return F.coalesce(F.nullif(F.regexp_extract(col(name), r"^(?:.*/)?([^/]+)\.[^./]+$", 1), F.lit("")), col(name))


def document_title(given, text, name) -> Column:
    """The title that is given; else the text's first line that begins with #, without those; else the stem of the name."""
    t = F.coalesce(col(text), F.lit(""))
    mark = F.when(F.contains(t, F.lit("#")), F.nullif(F.regexp_extract(t, HEADING, 1), F.lit("")))
    return F.coalesce(strip(filled(given)), strip(F.ltrim(strip(mark), F.lit("#"))), stem(name))


def whole(c, default) -> Column:
    """The value as an int; the default for anything that isn't one."""
    return F.coalesce(strip(col(c).cast("string")).try_cast("int"), col(default).cast("int"))


def moment(c) -> Column:
    """ISO dates and times; null for anything else."""
    return F.try_to_timestamp(strip(col(c)))


def page_fields(page, page_number, section, seq_num, index) -> Column:
    """page_or_section, page and block_page of a loaded part: the first that isn't null, its number among the parts as the last resort."""
    said = [col(c).cast("string") for c in (page, page_number, section, seq_num)]
    place = F.coalesce(*said, col(index).cast("string"))
    own = F.coalesce(*said[:2], place)
    return F.struct(place.alias("page_or_section"), own.alias("page"), whole(own, index).alias("block_page"))


def loader_name(kind) -> Column:
    """Name of the loader of a source type; null for an unknown one."""
    return F.create_map(*(F.lit(x) for pair in LOADERS.items() for x in pair))[col(kind)]


def cleaning_rules(kind, text, ocr=None) -> Column:
    """Names of the rules that cleaning a text of that source type applied, in order; `ocr` marks PDF pages that were read as images."""
    t, kind = F.coalesce(col(text), F.lit("")), col(kind)
    names = lambda xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    parsed = F.when(kind == "json", F.try_parse_json(t).isNotNull()).otherwise(False)
    hyphen = F.contains(t, F.lit("-")) & t.rlike(r"(?U)\w-(?:\r\n?|\n)\w")
    plain = F.concat(names(TEXT_RULES), F.when(parsed, names([JSON_RULE])).otherwise(none), F.when(hyphen, names([HYPHEN_RULE])).otherwise(none))
    pdf = F.concat(names(PDF_RULES), F.when(F.coalesce(col(ocr), F.lit(False)), names([OCR_RULE])).otherwise(none)) if ocr is not None else names(PDF_RULES)
    return F.when(kind == "pdf", pdf).otherwise(plain)


def normalized_documents(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a block, as a document to be split: doc_id, block_id, block_type, block_order, source_type, source_name, source_uri, title, section_path, page, page_or_section, doc_type, content, loader, cleaning_rules.

    blocks: doc_id, block_id, block_type, block_order, section_path, page_number, page_label, text.  sources, a row a
    document: doc_id, source_type, source_name, source_uri, title (may be null), text.  A block of a document that isn't in
    sources is left out.  Titles and rules are worked out before the join, so texts of sources aren't shuffled.
    """
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    base = sources.select("doc_id", "source_type", "source_name", "source_uri", document_title("title", "text", "source_name").alias("base_title"), loader_name("source_type").alias("loader"), cleaning_rules("source_type", "text").alias("cleaning_rules"))
    rows = blocks.select("doc_id", "block_id", "block_type", "block_order", path.alias("section_path"), "page_number", "page_label", F.col("text").alias("content")).join(base, "doc_id")
    page = F.col("page_number").cast("string")
    return rows.select(
        "doc_id", "block_id", "block_type", "block_order", "source_type", "source_name", "source_uri", F.when(F.size("section_path") > 0, F.get("section_path", F.lit(0))).otherwise(F.col("base_title")).alias("title"), "section_path", page.alias("page"),
        F.coalesce(filled("page_label"), page, F.try_element_at("section_path", F.lit(-1))).alias("page_or_section"), F.col("source_type").alias("doc_type"), "content", "loader", "cleaning_rules",
    )


def removed_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, block_ids: blocks left out of a document's body (those of `excluded`), in order; documents without any have no row."""
    rows = blocks.where("excluded").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_order", "block_id"))).alias("b"))
    return rows.select("doc_id", F.transform("b", lambda x: x["block_id"]).alias("block_ids"))


def index_documents(chunks: DataFrame) -> DataFrame:
    """id, content, metadata of chunks (chunk_id, retrieval_text and others): what an index holds; metadata is the JSON of the other columns."""
    others = [c for c in chunks.columns if c not in ("chunk_id", "retrieval_text")]
    return chunks.select(F.col("chunk_id").alias("id"), F.col("retrieval_text").alias("content"), F.to_json(F.struct(*others)).alias("metadata"))


# --- hits


def _empty(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if isinstance(kind, ArrayType) else c.isNull()


def merge_filled(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """primary's rows, where a column that is empty, or that it hasn't got, is the secondary's; secondary: a row a key.

    Nulls of `key` meet nothing.  Columns of both sides must have one type.
    """
    kinds = {f.name: f.dataType for f in primary.schema.fields}
    rows = primary.alias("p").join(secondary.alias("s"), F.col(f"p.`{key}`") == F.col(f"s.`{key}`"), "left")
    p, s = lambda c: F.col(f"p.`{c}`"), lambda c: F.col(f"s.`{c}`")
    both = lambda c: F.when(_empty(p(c), kinds[c]) & s(key).isNotNull(), s(c)).otherwise(p(c))
    own = [both(c) if c != key and c in secondary.columns else p(c) for c in primary.columns]
    return rows.select(*(x.alias(c) for x, c in zip(own, primary.columns, strict=True)), *(s(c).alias(c) for c in secondary.columns if c not in kinds))


def best_by_source(hits: DataFrame) -> DataFrame:
    """The hit of the largest score of each question's source (the first by rank on ties), combined before the shuffle.

    hits: query_id, rank, score and what `source_key` reads; a null score is the smallest.
    """
    best = F.max_by(F.struct(*hits.columns), F.struct(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))), -F.col("rank")))
    return hits.groupBy("query_id", source_key().alias("_key")).agg(best.alias("_b")).select("_b.*")


def output_rows(candidates: DataFrame, route: Column | str) -> DataFrame:
    """candidates with query_fusion_score and rerank_score filled from fusion_score, retrieval_sources, matched_query_count and route_name.

    candidates: dense_rank, lexical_rank, fusion_score, query_fusion_score, rerank_score, query_variant_ids and others.
    """
    variants = F.coalesce("query_variant_ids", F.array().cast(candidates.schema["query_variant_ids"].dataType))
    sources = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("lexical_rank").isNotNull(), "lexical")))
    return candidates.withColumns({
        "query_fusion_score": F.coalesce("query_fusion_score", "fusion_score"), "rerank_score": F.coalesce("rerank_score", "fusion_score"), "retrieval_sources": sources,
        "query_variant_ids": variants, "matched_query_count": F.size(variants), "route_name": F.lit(route) if isinstance(route, str) else route,
    })


def context_rows(hits: DataFrame) -> DataFrame:
    """query_id, index, source_name, title, section, page, doc_type, content of each hit, numbered from 1 by rank: what `turns.context_blocks` writes out.

    hits: query_id, rank, source_name, title, section_path, page, page_or_section, doc_type, source_type, content.
    """
    name = F.coalesce("source_name", F.lit(UNKNOWN))
    index = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.select(
        "query_id", index.alias("index"), name.alias("source_name"), F.coalesce(filled("title"), name).alias("title"), F.coalesce(F.nullif(F.array_join(path_items("section_path"), " > "), F.lit("")), F.lit(UNKNOWN)).alias("section"),
        F.coalesce(filled("page"), filled("page_or_section"), F.lit(UNKNOWN)).alias("page"), F.coalesce(filled("doc_type"), filled("source_type"), F.lit(UNKNOWN)).alias("doc_type"), "content",
    )


# --- traces


def route_names(documents) -> Column:
    """Names of the routes that found the documents, each once, as they come first."""
    return F.array_distinct(F.filter(F.transform(col(documents), lambda d: d["route_name"]), lambda r: r != ""))


def debug_trace(preview: int = 240) -> Column:
    """What is kept of how an answer came about: request, retrieval, generation.

    Reads session_id, retrieval_query, route_name, retry_reason, result_count (each null where retrieval didn't say), documents
    (structs with doc_id, route_name, retrieval_sources), citations (structs with index, doc_id, source_name), answer, status,
    reason, and is_valid, invalid_indices, n_uncited (null where nothing was judged).
    """
    docs, answer, n = F.col("documents"), F.coalesce("answer", F.lit("")), F.size("documents")
    request = F.struct("session_id", "retrieval_query", F.coalesce("route_name", F.get(route_names(docs), F.lit(0))).alias("route_name"), F.coalesce("retry_reason", F.lit("none")).alias("retry_reason"))
    found = F.struct(
        F.coalesce("result_count", n).alias("result_count"), F.transform(docs, lambda d: F.coalesce(d["doc_id"].cast("string"), F.lit(""))).alias("source_doc_ids"),
        F.transform(docs, lambda d: F.coalesce(d["retrieval_sources"], F.array().cast("array<string>"))).alias("retrieval_sources"),
    )
    judged = F.struct(F.col("is_valid"), F.coalesce("invalid_indices", F.array().cast("array<bigint>")).alias("invalid_citation_indices"), F.coalesce("n_uncited", F.lit(0)).alias("missing_citation_sentence_count"))
    written = F.struct(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("citation_indices_used"),
        F.transform("citations", lambda c: F.struct(c["index"].alias("index"), c["doc_id"].alias("doc_id"), c["source_name"].alias("source_name"))).alias("final_citations"),
        F.col("status").alias("answer_status"), F.col("reason").alias("answer_reason"), F.length(answer).alias("answer_text_len"), F.sha2(answer.cast("binary"), 256).alias("answer_text_hash"), F.left(answer, F.lit(preview)).alias("answer_preview"), judged.alias("validation"),
    )
    return F.struct(request.alias("request"), found.alias("retrieval"), written.alias("generation"))


# --- uploads


def upload_name(c) -> Column:
    """A name fit for a file: the last part of a path, reserved characters as _, no dots or blanks at its end; `upload` if nothing is left."""
    last = F.element_at(F.split(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    fit = F.rtrim(F.regexp_replace(strip(last), RESERVED, "_"), F.lit(". "))
    return let(fit, lambda x: F.when(x == "", "upload").otherwise(x))


def upload_error(c) -> Column:
    """Kind of a failed upload by its message."""
    m = F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(m.rlike(PARSE_WORDS), PARSE_FAILED).when(m.rlike(INDEX_WORDS), INDEX_FAILED).otherwise(OTHER_FAILED)

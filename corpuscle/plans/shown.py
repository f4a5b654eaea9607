"""Queries over what is shown and exported: normalized documents, places and ids, merged metadata, traces, names of uploads, the rebuilt index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import display, graph, index, turns
from corpuscle.sources import sinks

from .registry import Tables, query
from .state import LINES
from .talk import GIVEN, _turns

_STEM = "coalesce(nullif(regexp_extract({0}, '^(?:.*/)?([^/]+)\\.[^./]+$', 1), ''), {0})"
_KIND = "CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'txt' ELSE 'pdf' END"
_HEAD = "trim(ltrim(trim(regexp_extract(text, '(?:^|\\n)[ \\t]*(#[^\\n]*)', 1)), '#'))"


@query(
    f"""WITH {LINES}, so AS (SELECT doc_id, {_KIND} AS kind, 'in/' || source || '.v' || (doc_id % 4) || '.md' AS name, CASE WHEN doc_id % 5 = 0 THEN ' Title ' || doc_id ELSE NULL END AS given, text FROM documents),
    ba AS (SELECT doc_id, kind, name, CASE WHEN given IS NOT NULL THEN trim(given) WHEN regexp_matches(text, '(?:^|\\n)[ \\t]*#') THEN {_HEAD} ELSE {_STEM.format('name')} END AS base, CASE WHEN kind = 'pdf' THEN 8 ELSE 4 + regexp_matches(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]-\\n[\\p{{L}}\\p{{M}}\\p{{N}}_]')::INT END AS n_rules FROM so)
    SELECT ln.doc_id, block_order, CASE WHEN block_order % 3 = 0 THEN kind ELSE base END AS title, CASE WHEN block_order % 4 = 3 THEN '' ELSE CAST(block_order // 40 AS VARCHAR) END AS page, CASE WHEN block_order % 7 = 0 THEN 'L' || block_order WHEN block_order % 4 < 3 THEN CAST(block_order // 40 AS VARCHAR) WHEN block_order % 3 = 0 THEN 'part' ELSE '' END AS page_or_section,
    CASE kind WHEN 'markdown' THEN 'unstructured_markdown_loader' WHEN 'txt' THEN 'text_loader' ELSE 'pymupdf4llm' END AS loader, CAST(n_rules AS INT) AS n_rules, ln.text AS content FROM ln JOIN ba ON ba.doc_id = ln.doc_id"""
)
def normalized_documents(t: Tables) -> DataFrame:
    """Every line of every document as a block with title, page and loader; paths, pages and labels come from the numbers of lines."""
    i, d = F.col("block_order"), F.col("doc_id")
    kind = F.when(d % 3 == 0, "markdown").when(d % 3 == 1, "txt").otherwise("pdf")
    own = F.when(i % 3 == 0, F.array(kind, F.lit("part"))).otherwise(F.array().cast("array<string>"))
    blocks = graph.lines(t.documents).select("doc_id", F.concat_ws("-", d.cast("string"), i.cast("string")).alias("block_id"), F.lit("paragraph").alias("block_type"), "block_order", own.alias("section_path"), F.when(i % 4 < 3, F.floor(i / 40).cast("int")).alias("page_number"), F.when(i % 7 == 0, F.concat(F.lit("L"), i.cast("string"))).alias("page_label"), "text")
    name = F.concat(F.lit("in/"), "source", F.lit(".v"), (d % 4).cast("string"), F.lit(".md"))
    sources = t.documents.select("doc_id", kind.alias("source_type"), name.alias("source_name"), F.lit("").alias("source_uri"), F.when(d % 5 == 0, F.concat(F.lit(" Title "), d.cast("string"))).alias("title"), "text")
    found = display.normalized_documents(blocks, sources)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select("doc_id", "block_order", "title", none("page"), none("page_or_section"), "loader", F.size("cleaning_rules").alias("n_rules"), "content")


@query(
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_filter(list_transform(string_split(coalesce(source, '') || '/ ' || coalesce(lang, '') || ' //' || (doc_id % 5), '/'), lambda s: trim(s)), lambda s: s <> '') ELSE [] END AS p, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'p' || doc_id ELSE CAST(n_chars AS VARCHAR) END AS g, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'c' || doc_id END AS c, CASE WHEN doc_id % 8 = 0 THEN 'own' || doc_id ELSE '' END AS o, sha256(text) AS h FROM documents)
    SELECT doc_id, CASE WHEN len(p) = 0 THEN g WHEN g = '' THEN array_to_string(p, ' > ') ELSE array_to_string(p, ' > ') || ' | p' || g END AS location, CASE WHEN trim(coalesce(nullif(c, ''), o)) <> '' THEN coalesce(nullif(c, ''), o) ELSE 'hit-' || doc_id || '-' || CASE WHEN g = '' THEN 'na' ELSE g END || '-' || CASE WHEN len(p) = 0 THEN 'section' ELSE array_to_string(p, '-') END END AS chunk_id, h AS text_sha FROM x"""
)
def hit_places(t: Tables) -> DataFrame:
    """The place and the id that every document is shown with as a hit."""
    d = F.col("doc_id")
    path = F.when(d % 2 == 0, display.split_path(F.concat(F.coalesce("source", F.lit("")), F.lit("/ "), F.coalesce("lang", F.lit("")), F.lit(" //"), (d % 5).cast("string"))))
    rows = t.documents.select("doc_id", path.alias("section_path"), F.when(d % 3 == 1, F.concat(F.lit("p"), d.cast("string"))).otherwise("").alias("page"), F.when(d % 3 == 2, F.col("n_chars").cast("string")).alias("page_or_section"), F.when(d % 4 == 0, "").when(d % 4 == 1, "  ").otherwise(F.concat(F.lit("c"), d.cast("string"))).alias("chunk_id"), F.when(d % 8 == 0, F.concat(F.lit("own"), d.cast("string"))).otherwise("").alias("own_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))
    return rows.select("doc_id", F.coalesce(display.location("section_path", "page", "page_or_section"), F.lit("")).alias("location"), display.chunk_key("chunk_id", "own_id", "doc_id", "section_path", "page", "page_or_section", "hit").alias("chunk_id"), "text_sha")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL AND (d.doc_id % 2 = 0 OR coalesce(d.lang, '') = '') THEN 'labelled' WHEN d.doc_id % 2 = 0 THEN '' ELSE d.lang END, '-') AS lang, coalesce(CASE WHEN d.doc_id % 3 > 0 THEN d.n_chars END, l.quality, -1)::BIGINT AS n_chars, coalesce(l.toxic, -1)::BIGINT AS toxic, sha256(coalesce(d.text, '')) AS text_sha FROM documents d LEFT JOIN labels l USING (doc_id)")
def merged_metadata(t: Tables) -> DataFrame:
    """What is empty of a document is filled from its label's row."""
    d = F.col("doc_id")
    left = t.documents.select("doc_id", F.when(d % 2 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(d % 3 > 0, F.col("n_chars").cast("long")).alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha"))
    right = t.labels.select("doc_id", F.lit("labelled").alias("lang"), F.col("quality").cast("long").alias("n_chars"), F.col("toxic").cast("long").alias("toxic"))
    return display.merge_filled(left, right, "doc_id").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "text_sha")


@query("SELECT user_id, event_type AS source, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) = 1")
def best_hits(t: Tables) -> DataFrame:
    """The event of the largest value of every user and type, as the best hit of a question's source."""
    none = F.lit(None).cast("string")
    hits = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("rank"), F.col("value").alias("score"), F.lit("").alias("source_uri"), F.col("event_type").alias("source_name"), none.alias("doc_id"), none.alias("page"), none.alias("page_or_section"), F.lit(None).cast("array<string>").alias("section_path"))
    return display.best_by_source(hits).select(F.col("query_id").alias("user_id"), F.col("source_name").alias("source"), F.col("rank").alias("event_id"), F.col("score").alias("value"))


@query(
    f"""WITH {GIVEN} SELECT conv_id AS session_id, turn, CASE WHEN turn % 3 = 0 THEN 'said' WHEN conv_id % 5 = 0 THEN '' ELSE 'r' || (conv_id % 2) END AS route_name, CAST(CASE WHEN turn % 4 = 0 THEN 9 WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END AS INT) AS result_count, CASE WHEN conv_id % 5 = 0 THEN '' ELSE '1' END AS indices_used, CAST(n_citations AS INT) AS n_citations, status AS answer_status, reason AS answer_reason, CAST(length(answer) AS INT) AS answer_text_len, sha256(answer) AS answer_text_hash, left(answer, 240) AS answer_preview FROM gi"""
)
def answer_traces(t: Tables) -> DataFrame:
    """What is kept of how every answer came about."""
    d = F.col("session_id")
    given = turns.answer_turns(_turns(t)).select("session_id", "turn", "answer", "status", "reason", F.col("question").alias("retrieval_query"), F.col("used_citations").alias("citations"), F.transform("documents", lambda x: F.struct(x["doc_id"].alias("doc_id"), F.concat(F.lit("r"), (d % 2).cast("string")).alias("route_name"), F.array(F.lit("lexical")).alias("retrieval_sources"))).alias("documents"))
    rows = given.withColumns({"citations": F.transform("citations", lambda c: F.struct(c["index"].alias("index"), c["doc_id"].alias("doc_id"), c["source_name"].alias("source_name"))), "route_name": F.when(F.col("turn") % 3 == 0, "said"), "retry_reason": F.lit(None).cast("string"), "result_count": F.when(F.col("turn") % 4 == 0, 9)})
    rows = rows.withColumns({"is_valid": F.lit(None).cast("boolean"), "invalid_indices": F.lit(None).cast("array<bigint>"), "n_uncited": F.lit(None).cast("int")}).withColumn("trace", display.debug_trace())
    g = "trace.generation."
    return rows.select(
        "session_id", "turn", F.coalesce("trace.request.route_name", F.lit("")).alias("route_name"), "trace.retrieval.result_count", F.array_join(F.transform(g + "citation_indices_used", lambda i: i.cast("string")), ",").alias("indices_used"), F.size(g + "final_citations").alias("n_citations"),
        g + "answer_status", g + "answer_reason", g + "answer_text_len", g + "answer_text_hash", g + "answer_preview",
    )


@query("WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '{\"turn\": ' || turn || '}' END AS trace FROM conversations WHERE role = 'assistant'), k AS (SELECT * FROM m WHERE trace IS NOT NULL) SELECT conv_id AS session_id, count(*) OVER (PARTITION BY conv_id) AS count, turn AS message_id, trace FROM k")
def exported_traces(t: Tables) -> DataFrame:
    """Rows of the export of every session's traces."""
    turn = F.col("turn")
    rows = t.conversations.where((F.col("role") == "assistant") & (turn % 4 == 1))
    return sinks.trace_rows(rows.select(F.col("conv_id").alias("session_id"), turn.alias("message_id"), F.concat(F.lit('{"turn": '), turn.cast("string"), F.lit("}")).alias("trace")))


@query(
    """WITH x AS (SELECT page_id, string_split(replace(CASE page_id % 4 WHEN 0 THEN url || '. .' WHEN 1 THEN 'C:\\' || url || '\\' || page_id || ' ?*.html ' WHEN 2 THEN url || '/' ELSE coalesce(url, '') || chr(7) || '<a>' END, '\\', '/'), '/')[-1] AS p FROM pages), y AS (SELECT page_id, rtrim(regexp_replace(trim(p), '[\\x00-\\x1f<>:"/\\\\|?*]+', '_', 'g'), '. ') AS n FROM x)
    SELECT page_id, CASE WHEN n IS NULL OR n = '' THEN 'upload' ELSE n END AS file_name FROM y"""
)
def upload_names(t: Tables) -> DataFrame:
    """Names of files that pages are uploaded under, out of awkward forms of their addresses."""
    i = F.col("page_id")
    given = F.when(i % 4 == 0, F.concat("url", F.lit(". ."))).when(i % 4 == 1, F.concat(F.lit("C:\\"), "url", F.lit("\\"), i.cast("string"), F.lit(" ?*.html "))).when(i % 4 == 2, F.concat("url", F.lit("/"))).otherwise(F.concat(F.coalesce("url", F.lit("")), F.lit("\x07<a>")))
    return t.pages.select("page_id", display.upload_name(given).alias("file_name"))


@query(
    """WITH x AS (SELECT doc_id, doc_id % 10 AS parent, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'active' END AS status, doc_id % 4 = 1 AS moved, source, text FROM documents)
    SELECT 'c' || doc_id AS id, sha256(coalesce(text, '')) AS content_sha, CASE WHEN moved THEN '/new/' || doc_id ELSE '/old/' || coalesce(source, '') END AS uri, CAST(doc_id AS BIGINT) AS n FROM x WHERE status = 'active' AND doc_id % 11 <> 3"""
)
def index_rebuild(t: Tables) -> DataFrame:
    """What an index holds after every fourth document has moved and it is rebuilt from the active chunks of active documents."""
    d = F.col("doc_id")
    docs = t.documents.select("doc_id", F.when(d % 7 == 0, "deleted").otherwise("active").alias("status"), F.concat(F.lit("/old/"), F.coalesce("source", F.lit(""))).alias("source_uri"), F.lit(0).alias("updated_at"))
    meta = F.to_json(F.struct(d.alias("n"), F.concat(F.lit("/old/"), F.coalesce("source", F.lit(""))).alias("source_uri_or_path")))
    chunks = t.documents.select("doc_id", F.concat(F.lit("c"), d.cast("string")).alias("chunk_id"), F.when(d % 11 == 3, "deleted").otherwise("active").alias("status"), F.col("text").alias("retrieval_text"), meta.alias("metadata"), F.lit(0).alias("updated_at"))
    moved = t.documents.where("doc_id % 4 = 1").select("doc_id", F.concat(F.lit("/new/"), d.cast("string")).alias("new_uri"), F.lit(1).alias("at"))
    docs, chunks = index.rewrite_uris(docs, chunks, moved)
    held = F.get_json_object(F.get_json_object("metadata", "$.metadata"), "$.source_uri_or_path")
    n = F.get_json_object(F.get_json_object("metadata", "$.metadata"), "$.n").cast("bigint")
    return index.rebuilt(docs, chunks).select("id", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("content_sha"), held.alias("uri"), n.alias("n"))

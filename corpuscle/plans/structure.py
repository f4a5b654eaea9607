"""Queries over cleaning, blocks, chunks and hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import blocks, chunking

from .registry import Tables, query
from .retrieval import ASKED, LEXICAL, NORM, POST, SCORED, _asked, bm25

WORDS = "(SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '([A-Za-z0-9_])-\\n([A-Za-z0-9_])', '\\1\\2', 'g'), '[\\x{00a0}\\t]', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM documents")
def clean_text_rules(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", blocks.clean("text").alias("cleaned"))


@query(f"WITH r AS (SELECT doc_id, lower({NORM.format('line')}) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT doc_id, line, count(*) AS n FROM r WHERE length(line) BETWEEN 1 AND 80 GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_lines(t: Tables) -> DataFrame:
    return blocks.repeated_lines(t.documents)


@query(
    f"""SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(n AS INT) AS chunk_count, array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ') AS text FROM
    (SELECT doc_id, w, n, unnest(range(n)) AS i FROM (SELECT doc_id, w, greatest(1, CAST(ceil((len(w) - 40) / 180.0) AS BIGINT)) AS n FROM {WORDS} WHERE len(w) > 0))"""
)
def chunk_fallback(t: Tables) -> DataFrame:
    return chunking.word_windows(t.documents)


@query()
def list_split(t: Tables) -> DataFrame:
    """Lines packed under a budget; texts with a longer line fall back to windows."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = t.documents.select("doc_id", "text", chunking.pack(lines, chunking.BUDGET).alias("p"))
    packed = rows.where("p IS NOT NULL").select("doc_id", F.posexplode("p").alias("chunk_index", "x")).select("doc_id", "chunk_index", "x.text")
    return packed.union(chunking.word_windows(rows.where("p IS NULL")).select("doc_id", "chunk_index", "text"))


@query("SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def json_flatten(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS n_paragraphs FROM pages")
def html_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<p[ >]")).alias("n_paragraphs"))


@query(f"WITH {POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(4)}, par AS (SELECT source, max(text) AS stored FROM documents WHERE source <> 'src5' GROUP BY 1) SELECT l.query_id, l.chunk_id, CASE WHEN l.chunk_id % 2 = 0 THEN 'inline' ELSE coalesce(par.stored, d.text) END AS content FROM l JOIN documents d ON d.doc_id = l.chunk_id LEFT JOIN par ON par.source = d.source")
def hydrate(t: Tables) -> DataFrame:
    hits = bm25(t.documents, _asked(t), 4).join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id"), F.col("text").alias("child_text")), "chunk_id")
    hits = hits.withColumn("inline_content", F.when(F.col("chunk_id") % 2 == 0, "inline").otherwise(""))
    parents = t.documents.where("source <> 'src5'").groupBy(F.col("source").alias("parent_id")).agg(F.max("text").alias("content"))
    return chunking.hydrate(hits, parents).select("query_id", "chunk_id", "content")

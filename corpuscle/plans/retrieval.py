"""Queries over text functions, recall, fusion and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators.dense import dense_topk
from corpuscle.operators.filters import MetadataFilter, hard_target
from corpuscle.operators.fusion import rrf, weighted_rrf
from corpuscle.operators.lexical import bm25, corpus_stats, token_df
from corpuscle.sources.tables import web_pages

from .registry import Tables, query

# DuckDB counterparts of the text functions, for texts without ideographs.
NORM = r"trim(regexp_replace({0}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}\x{{0085}}\x{{2028}}\x{{2029}}\x{{1680}}\x{{205f}}]+', ' ', 'g'))"
TOKENS = r"list_distinct(list_concat(CASE WHEN regexp_extract({0}, '([0-9]+(?:\.[0-9]+){{1,3}})', 1) <> '' THEN [regexp_extract({0}, '([0-9]+(?:\.[0-9]+){{1,3}})', 1)] ELSE [] END, list_transform(regexp_extract_all({0}, '[A-Za-z0-9_.%/-]+'), lambda x: lower(x))))"
POST = f"d AS (SELECT doc_id, text, lang, source, {TOKENS.format('text')} AS toks FROM documents), p AS (SELECT doc_id, unnest(toks) AS token FROM d), st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d), df AS (SELECT token, count(*) AS df FROM p GROUP BY token)"
SCORED = "s AS (SELECT q.query_id, p.doc_id AS chunk_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * len(d.toks) / st.a))), 9) AS score FROM q JOIN p USING (token) JOIN df USING (token) JOIN d ON d.doc_id = p.doc_id, st WHERE {0} GROUP BY 1, 2)"
LEXICAL = "l AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS lexical_rank FROM s WHERE score > 0 QUALIFY lexical_rank <= {0})"
ASKED = f"q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS token FROM benchmark)"
DIST = "round(list_sum(list_transform(list_zip({0}, {1}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 9)"
#: Query vectors: every fiftieth; for questions, the vector of the question's number.
NEAR = f"dd AS (SELECT query_id, vec_id AS chunk_id, label, {DIST.format('embedding', 'qe')} AS dist FROM embeddings, qv)"
DENSE = f"qv AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), {NEAR}"
ASKED_DENSE = f"qv AS (SELECT item_id AS query_id, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id), {NEAR}"


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"SELECT doc_id, {NORM.format('text')} AS norm, CASE WHEN length({NORM.format('text')}) <= 180 THEN {NORM.format('text')} ELSE rtrim(left({NORM.format('text')}, 177)) || '...' END AS snippet FROM documents")
def normalize_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalize("text").alias("norm"), tx.snippet("text").alias("snippet"))


@query(
    f"""WITH n AS (SELECT doc_id, text, {NORM.format('text')} AS s FROM documents),
    o AS (SELECT doc_id, text, s, CASE WHEN s = '' THEN 1.0 ELSE length(regexp_replace(s, '[\\p{{L}}\\p{{M}}\\p{{N}}_\\s.,:;!?/#()\\[\\]{{}}<>@''"-]', '', 'g')) / CAST(length(s) AS DOUBLE) END AS odd FROM n)
    SELECT doc_id, CAST(round(odd, 6) AS DOUBLE) AS odd_share, odd >= 0.35 AS garbled, (length(s) < 120 OR odd >= 0.35 OR len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) < 3) AS needs_ocr FROM o"""
)
def garbled_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.odd_share("text"), 6).alias("odd_share"), tx.garbled("text").alias("garbled"), tx.needs_ocr("text").alias("needs_ocr"))


@query(f"WITH {POST} SELECT token, df FROM df")
def token_df_all(t: Tables) -> DataFrame:
    return token_df(t.documents)


@query(f"WITH {POST} SELECT n AS n_docs, round(a, 6) AS avg_dl FROM st")
def corpus_statistics(t: Tables) -> DataFrame:
    return corpus_stats(t.documents).select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query(
    r"""SELECT doc_id, nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+){1,3})', 1), '') AS clause_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)[0-9]+(?:\.[0-9]+)?(?:%|MPa)'))), '|') AS numeric_terms,
    len(regexp_extract_all(text, '(?i)[0-9]+(?:\.[0-9]+)?(?:%|MPa)')) > 0 AS has_numeric, regexp_extract(text, '([0-9]+(?:\.[0-9]+){1,3})', 1) <> '' AS is_anchor FROM documents"""
)
def regulation_anchors(t: Tables) -> DataFrame:
    a = tx.anchors("text")
    return t.documents.select("doc_id", a.alias("a")).select("doc_id", "a.clause_id", F.array_join(F.array_sort("a.numeric_terms"), "|").alias("numeric_terms"), "a.has_numeric", "a.is_anchor")


@query("SELECT doc_id, 'doc-' || left(sha1('txt:' || CAST(doc_id AS VARCHAR)), 16) AS key, sha256(text) AS content_hash FROM documents")
def doc_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.doc_key("txt", F.col("doc_id").cast("string")).alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(t: Tables) -> DataFrame:
    """The content-addressed store: one object for each different payload."""
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: sha256(x)), chr(10))) AS fingerprint, CAST(len(string_split(text, chr(10))) AS INT) AS n_chunks FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    """A digest of a document's chunks (its lines) in their order; it changes when any of them does."""
    lines = F.split("text", "\n", -1)
    return t.documents.select("doc_id", F.sha2(F.array_join(F.transform(lines, lambda x: F.sha2(x.cast("binary"), 256)), "\n").cast("binary"), 256).alias("fingerprint"), F.size(lines).alias("n_chunks"))


@query(
    r"""SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+://[^/?]*)', 1)) || regexp_replace(regexp_replace(u, '^[a-zA-Z]+://[^/?]*', ''), '/+$', '') AS clean_url,
    lower(regexp_extract(u, '^[a-zA-Z]+://([^/?:]*)', 1)) AS host FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)"""
)
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.clean_url("url").alias("clean_url"), F.lower(F.expr("parse_url(url, 'HOST')")).alias("host"))


@query(r"SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?:#]*)', 1) AS source_name, 'web' AS source_type, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def web_source_host(t: Tables) -> DataFrame:
    return web_pages(t.pages).groupBy("source_name", "source_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {POST}, q AS (SELECT 1 AS query_id, unnest(['the', 'tion', 'version', '3.']) AS token), {SCORED.format('true')}, {LEXICAL.format(30)} SELECT * FROM l")
def bm25_topk(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(1, "the tion version 3.")], "query_id int, query string")
    return bm25(t.documents, asked, 30)


@query(f"WITH {POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(30)} SELECT * FROM l")
def bm25_batch(t: Tables) -> DataFrame:
    return bm25(t.documents, _asked(t), 30)


@query(f"WITH {POST}, {ASKED}, {SCORED.format(chr(39).join(['d.lang = ', 'en', '']))}, {LEXICAL.format(10)} SELECT * FROM l")
def bm25_filtered(t: Tables) -> DataFrame:
    return bm25(t.documents, _asked(t), 10, where=F.col("lang") == "en")


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS r FROM dd QUALIFY r <= 30) SELECT query_id, chunk_id, round(1 / (1 + greatest(dist, 0.0)), 6) AS score, CAST(r AS INT) AS dense_rank FROM r")
def dense_batch(t: Tables) -> DataFrame:
    return dense_topk(t.embeddings, _vectors(t), 30)


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS r FROM dd QUALIFY r <= 30) SELECT query_id, chunk_id, round(1 / (1 + greatest(dist, 0.0)), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS INT) AS dense_rank FROM r WHERE label <= 4")
def dense_postfilter(t: Tables) -> DataFrame:
    """The filter applies to the k nearest, so fewer may remain."""
    return dense_topk(t.embeddings, _vectors(t), 30, where=F.col("label") <= 4)


HYBRID = f"""{POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(30)}, {ASKED_DENSE},
dn AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS INT) AS dense_rank FROM dd QUALIFY dense_rank <= 30),
b AS (SELECT coalesce(dn.query_id, l.query_id) AS query_id, coalesce(dn.chunk_id, l.chunk_id) AS chunk_id, dense_rank, lexical_rank FROM dn FULL JOIN l ON dn.query_id = l.query_id AND dn.chunk_id = l.chunk_id),
f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS fusion_score, coalesce(least(dense_rank, lexical_rank), 10000) AS best_rank FROM b)"""


def hybrid(t: Tables, k: int = 20) -> DataFrame:
    """Every question, by its words and by the vector of its number."""
    vectors = _asked(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id").select("query_id", "query_vector")
    return rrf(dense_topk(t.embeddings, vectors, 30), bm25(t.documents, _asked(t), 30), k)


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(lexical_rank, 0) AS lexical_rank, fusion_score, best_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, best_rank, chunk_id) AS INT) AS fusion_rank FROM f QUALIFY fusion_rank <= 20")
def hybrid_rrf(t: Tables) -> DataFrame:
    """Ranks are 0 where a list hasn't got the document."""
    return hybrid(t).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dense_rank", "lexical_rank")})


VARIANTS = f"""{POST}, qq AS (SELECT item_id AS query_id, 'original' AS variant_id, 1.0 AS weight, text AS v FROM benchmark UNION ALL SELECT item_id, 'keyword_focused', 0.92, regexp_replace(text, '\\b(the|of|and|in|to|is|for|or)\\b', ' ', 'gi') FROM benchmark),
q AS (SELECT query_id, variant_id, weight, unnest({TOKENS.format('v')}) AS token FROM qq),
s AS (SELECT q.query_id, q.variant_id, q.weight, p.doc_id AS chunk_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * len(d.toks) / st.a))), 9) AS score FROM q JOIN p USING (token) JOIN df USING (token) JOIN d ON d.doc_id = p.doc_id, st GROUP BY 1, 2, 3, 4),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 30)"""


def _variant_lists(t: Tables) -> DataFrame:
    asked = _asked(t)
    variants = asked.select(F.col("query_id").alias("item"), F.explode(F.array(F.struct(F.lit("original").alias("variant_id"), F.lit(1.0).alias("weight"), F.col("query")), F.struct(F.lit("keyword_focused").alias("variant_id"), F.lit(0.92).alias("weight"), F.regexp_replace("query", r"(?i)\b(the|of|and|in|to|is|for|or)\b", " ").alias("query")))).alias("v")).select(F.struct("item", "v.variant_id", "v.weight").alias("query_id"), "v.query")
    return bm25(t.documents, variants, 30).select("query_id.item", "query_id.variant_id", "query_id.weight", "chunk_id", F.col("lexical_rank").alias("rank")).withColumnRenamed("item", "query_id")


@query(
    f"""WITH {VARIANTS}, f AS (SELECT query_id, chunk_id, round(sum(weight::DOUBLE / (60 + rank)), 9) AS fusion_score, CAST(min(rank) AS INT) AS best_rank, string_agg(variant_id, ',' ORDER BY variant_id) AS sources, max((variant_id = 'original')::INT) AS o FROM l GROUP BY 1, 2)
    SELECT query_id, chunk_id, fusion_score, best_rank, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, o DESC, best_rank, chunk_id) AS INT) AS fusion_rank FROM f QUALIFY fusion_rank <= 20"""
)
def variant_rrf(t: Tables) -> DataFrame:
    return weighted_rrf(_variant_lists(t), 20)


@query(
    f"""WITH {VARIANTS}, r AS (SELECT query_id, CASE WHEN variant_id = 'original' THEN 'initial' ELSE 'retry' END AS round, CASE WHEN variant_id = 'original' THEN 1.0 ELSE 0.95 END AS w, chunk_id, rank FROM l),
    f AS (SELECT query_id, chunk_id, round(sum(w::DOUBLE / (60 + rank)), 9) AS fusion_score, CAST(min(rank) AS INT) AS best_rank, string_agg(round, ',' ORDER BY round) AS sources FROM r GROUP BY 1, 2)
    SELECT query_id, chunk_id, fusion_score, best_rank, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, best_rank, chunk_id) AS INT) AS fusion_rank FROM f QUALIFY fusion_rank <= 20"""
)
def retry_rrf(t: Tables) -> DataFrame:
    first = F.col("variant_id") == "original"
    lists = _variant_lists(t).select("query_id", F.when(first, "initial").otherwise("retry").alias("round"), F.when(first, 1.0).otherwise(0.95).alias("weight"), "chunk_id", "rank")
    return weighted_rrf(lists, 20, by="round")


@query("SELECT doc_id, source AS source_name, lang AS doc_type FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'de') AND contains(lower(source), 'src')")
def metadata_filter(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("doc_type"))
    return rows.where(MetadataFilter(source_names=["src1", "src2"], doc_types=["en", "de"], title_contains="SRC").predicate(rows.columns))


@query("SELECT conv_id AS doc_id, turn, role FROM conversations WHERE (turn % 2 = 0 OR conv_id IN (1, 2, 3)) AND conv_id IN (1, 2, 3, 4, 5) AND (turn % 2 = 0 OR conv_id <= 3)")
def session_scope_filter(t: Tables) -> DataFrame:
    """Rows scoped to a session pass only if their document is listed."""
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "role", F.when((F.col("turn") % 2 == 1) & (F.col("conv_id") > 3), "global").when(F.col("turn") % 2 == 1, "session").otherwise("global").alias("scope"))
    rows = rows.where((F.col("turn") % 2 == 0) | (F.col("doc_id") <= 3))
    return rows.where(MetadataFilter(doc_ids=[1, 2, 3, 4, 5]).predicate(rows.columns)).drop("scope")


@query(f"""WITH {HYBRID}, k AS (SELECT f.*, d.source IN ('src1', 'src2', 'src3') AS hit FROM f JOIN documents d ON d.doc_id = f.chunk_id), n AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id) AS nt FROM k)
SELECT query_id, chunk_id, hit AS is_target, CASE WHEN nt >= 2 THEN 'hard' ELSE 'soft_fallback' END AS targeting FROM n WHERE nt < 2 OR hit""")
def hard_targeting(t: Tables) -> DataFrame:
    found = hybrid(t, 1 << 20).join(t.documents.select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    return hard_target(found, F.col("source").isin("src1", "src2", "src3")).select("query_id", "chunk_id", "is_target", "targeting")

"""Queries over planning, reranking, sufficiency and retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import planner
from corpuscle.operators.rerank import rerank

from .registry import Tables, query
from .retrieval import HYBRID, NORM, TOKENS, hybrid

ASKED_SQL = f"""asked AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES (-1, 'StreamingResponse class path backend/src/api/main.py'), (-2, 'Figure 2 on page 12'), (-3, 'Explain Figure 2 latency tradeoff'), (-4, 'How does FastAPI stream answers'), (-5, 'clause 3.2.1 limits')) v(a, b)),
n AS (SELECT query_id, {NORM.format('query')} AS normalized FROM asked),
w AS (SELECT *, {TOKENS.format('normalized')} AS toks, regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS words FROM n),
c AS (SELECT *, len(list_filter(words, lambda x: regexp_matches(x, '^.+\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}'))) AS camel FROM w),
a AS (SELECT query_id, normalized, toks, words, CAST(len(toks) AS INT) AS token_count,
  CASE WHEN len(toks) > 0 THEN len(list_filter(words, lambda x: regexp_matches(x, '[/\\\\._]|\\p{{Nd}}') OR (regexp_matches(x, '^.+\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}')))) / CAST(len(toks) AS DOUBLE) ELSE 0.0 END AS literal_ratio,
  regexp_matches(normalized, '(?i)\\b(?:figure|fig\\.?|table|section|page|equation|formula)\\b') AS has_structure,
  regexp_matches(normalized, '(?i)\\b(?:explain|meaning|tradeoff|result|results|interpret|interpretation)\\b') AS has_explain,
  regexp_matches(normalized, '(?i)\\b(?:error|exception|traceback|stack trace|failed|failure|timeout|404|500|importerror|keyerror|valueerror)\\b') AS has_error,
  regexp_matches(normalized, '[/\\\\]|::|->|[A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z0-9_.]+|[A-Za-z_][A-Za-z0-9_]*\\(|[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+') OR camel >= 2 AS has_code,
  regexp_matches(normalized, '(?:[0-9]+\\.){{1,3}}[0-9]+') AS has_regulation FROM c),
r AS (SELECT *, CASE WHEN has_regulation THEN 'regulation' WHEN has_structure AND has_explain THEN 'explained_structure' WHEN has_structure THEN 'structure' WHEN has_error OR has_code OR literal_ratio >= 0.34 THEN 'precision' ELSE 'general' END AS route FROM a)"""
_STOP = ", ".join(f"'{w}'" for w in planner.SECTION_STOP_WORDS)
_KSTOP = ", ".join(f"'{w}'" for w in planner.KEYWORD_STOP_WORDS)
KEYWORDS_SQL = f"""k AS (SELECT r.*, CASE WHEN token_count = 0 THEN '' WHEN has_regulation THEN array_to_string(t, ' ') WHEN len(f) > 0 THEN array_to_string(f, ' ') ELSE array_to_string(words, ' ') END AS kw FROM
  (SELECT r.*, list_filter(words, lambda x: NOT list_contains([{_KSTOP}], lower(x))) AS f, list_filter(l0, lambda x, i: x <> '' AND list_position(l0, x) = i) AS t FROM
    (SELECT r.*, list_concat([regexp_extract(normalized, '([0-9]+(?:\\.[0-9]+){{1,3}})', 1)], regexp_extract_all(normalized, '(?i)(?:[0-9]+\\.){{1,3}}[0-9]+|MPa')) AS l0 FROM r) r) r)"""


def _queries(t: Tables) -> DataFrame:
    fixed = [(-1, "StreamingResponse class path backend/src/api/main.py"), (-2, "Figure 2 on page 12"), (-3, "Explain Figure 2 latency tradeoff"), (-4, "How does FastAPI stream answers"), (-5, "clause 3.2.1 limits")]
    turns = t.conversations.where("role = 'user'").select((1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).union(turns).union(t.spark.createDataFrame(fixed, "query_id long, query string"))


def _planned(t: Tables) -> DataFrame:
    return planner.plan(planner.route(planner.analyze(_queries(t))))


@query(f"""WITH {ASKED_SQL} SELECT query_id, normalized, token_count, round(literal_ratio, 6) AS literal_ratio, has_structure, has_explain, has_error, has_code, has_regulation,
    regexp_matches(normalized, '(?i)overview|compare|difference|design|architecture|workflow|summary') AS has_broad, token_count <= 5 AS is_short, token_count <= 6 AND regexp_matches(normalized, '(?i)\\b(?:it|this|that|these|those|they|them|he|she|there)\\b') AS is_follow_up FROM r""")
def query_analyze(t: Tables) -> DataFrame:
    return planner.analyze(_queries(t)).select("query_id", "normalized", "token_count", F.round("literal_ratio", 6).alias("literal_ratio"), "has_structure", "has_explain", "has_error", "has_code", "has_regulation", "has_broad", "is_short", "is_follow_up")


@query(f"WITH {ASKED_SQL} SELECT query_id, route FROM r")
def query_route(t: Tables) -> DataFrame:
    return planner.route(planner.analyze(_queries(t))).select("query_id", "route")


@query(f"WITH {ASKED_SQL} SELECT route AS route_name, count(*) AS n FROM r GROUP BY 1")
def route_distribution(t: Tables) -> DataFrame:
    return planner.route(planner.analyze(_queries(t))).groupBy(F.col("route").alias("route_name")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {ASKED_SQL} SELECT query_id, route, CAST(CASE WHEN route = 'general' THEN 30 ELSE 8 END AS INT) AS dense_k, CAST(CASE route WHEN 'general' THEN 30 WHEN 'precision' THEN 12 ELSE 16 END AS INT) AS lexical_k,
    CAST(CASE WHEN route = 'general' THEN 20 ELSE 8 END AS INT) AS fusion_k, CAST(CASE WHEN route = 'general' THEN 20 ELSE 16 END AS INT) AS rerank_k, CAST(CASE route WHEN 'explained_structure' THEN 3 WHEN 'structure' THEN 2 WHEN 'regulation' THEN 2 ELSE 1 END AS INT) AS max_variants,
    CASE route WHEN 'explained_structure' THEN 'table,image,formula,caption,paragraph' WHEN 'structure' THEN 'table,image,formula,caption,section_header' ELSE '' END AS targets, CASE route WHEN 'precision' THEN 'none' ELSE 'widen_then_keyword' END AS retry FROM r"""
)
def query_plan(t: Tables) -> DataFrame:
    return _planned(t).select("query_id", "route", "dense_k", "lexical_k", "fusion_k", "rerank_k", "max_variants", F.array_join("targets", ",").alias("targets"), "retry")


@query(f"WITH {ASKED_SQL}, o AS (SELECT query_id, list_filter(list_transform(list_concat(CASE WHEN regexp_extract(normalized, '([0-9]+(?:\\.[0-9]+){{1,3}})', 1) <> '' THEN [regexp_extract(normalized, '([0-9]+(?:\\.[0-9]+){{1,3}})', 1)] ELSE [] END, regexp_extract_all(normalized, '[A-Za-z0-9_.%/-]+')), lambda x: lower(x)), lambda x: NOT list_contains([{_STOP}], x) AND length(x) > 1) AS l FROM r) SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ' ') AS section_terms FROM o")
def section_terms(t: Tables) -> DataFrame:
    return _planned(t).select("query_id", F.array_join("section_terms", " ").alias("section_terms"))


@query(
    f"""WITH {ASKED_SQL}, {KEYWORDS_SQL}, v AS (SELECT query_id, 'original' AS variant_id, normalized AS variant, 1.0::DOUBLE AS weight FROM k
    UNION ALL SELECT query_id, 'keyword_focused', kw, 0.92 FROM k WHERE route IN ('explained_structure', 'structure', 'regulation') AND kw <> '' AND lower(kw) <> lower(normalized)
    UNION ALL SELECT query_id, 'clarified', normalized || ' ' || kw, 0.85 FROM k WHERE route = 'explained_structure' AND kw <> '' AND lower(kw) <> lower(normalized)) SELECT * FROM v"""
)
def query_variants(t: Tables) -> DataFrame:
    return planner.expand(_planned(t))


@query(f"WITH {ASKED_SQL}, {KEYWORDS_SQL} SELECT query_id, 'retry_keyword' AS variant_id, kw AS variant, 0.84::DOUBLE AS weight FROM k WHERE kw <> '' AND lower(kw) <> lower(normalized)")
def query_retry_variants(t: Tables) -> DataFrame:
    return planner.retry_variant(_planned(t))


@query(f"WITH {ASKED_SQL}, p AS (SELECT query_id, CASE WHEN route = 'general' THEN 30 ELSE 8 END AS d, CASE route WHEN 'general' THEN 30 WHEN 'precision' THEN 12 ELSE 16 END AS l, CASE WHEN route = 'general' THEN 20 ELSE 8 END AS f FROM r) SELECT query_id, CAST(greatest(d + 1, ceil(d * 1.5)) AS INT) AS retry_dense_k, CAST(greatest(l + 1, ceil(l * 1.5)) AS INT) AS retry_lexical_k, CAST(greatest(f, d + 1, ceil(d * 1.5), l + 1, ceil(l * 1.5)) AS INT) AS retry_fusion_k FROM p")
def retry_plan(t: Tables) -> DataFrame:
    return planner.widen(_planned(t)).select("query_id", "retry_dense_k", "retry_lexical_k", "retry_fusion_k")


def _ordered(expr: str) -> str:
    raw = f"list_concat(CASE WHEN regexp_extract({expr}, '([0-9]+(?:\\.[0-9]+){{1,3}})', 1) <> '' THEN [regexp_extract({expr}, '([0-9]+(?:\\.[0-9]+){{1,3}})', 1)] ELSE [] END, list_transform(regexp_extract_all({expr}, '[A-Za-z0-9_.%/-]+'), lambda x: lower(x)))"
    return raw


RERANKED = f"""{HYBRID}, fu AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, best_rank, chunk_id) AS INT) AS fusion_rank FROM f QUALIFY fusion_rank <= 20),
j AS (SELECT fu.*, b.text AS query, d.text AS content, {_ordered('b.text')} AS q0, {_ordered('d.text')} AS c0 FROM fu JOIN benchmark b ON b.item_id = fu.query_id JOIN documents d ON d.doc_id = fu.chunk_id),
o AS (SELECT *, list_filter(q0, lambda x, i: list_position(q0, x) = i) AS qt, list_filter(c0, lambda x, i: list_position(c0, x) = i) AS ct FROM j),
sc AS (SELECT query_id, chunk_id, fusion_rank, fusion_score, round(0.30 * fusion_score + 0.20 * CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / CAST(len(qt) AS DOUBLE) ELSE 0 END
  + 0.10 * CASE WHEN len(qt) > 0 AND contains(array_to_string(ct, ' '), array_to_string(qt, ' ')) THEN 1 ELSE 0 END + 0.05 / (best_rank + 1.0) - least(0.05, greatest(greatest(len(ct), 1) - 220, 0) / 220.0 * 0.05), 9)::DOUBLE AS rerank_score FROM o)"""
FINAL = "rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_rank) AS INT) AS rerank_rank FROM sc QUALIFY rerank_rank <= 16)"


def _reranked(t: Tables) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    content = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return rerank(hybrid(t, 20).join(asked, "query_id").join(content, "chunk_id"), 16)


@query(f"WITH {RERANKED}, {FINAL} SELECT query_id, chunk_id, rerank_rank, rerank_score FROM rr")
def heuristic_rerank(t: Tables) -> DataFrame:
    return _reranked(t).select("query_id", "chunk_id", "rerank_rank", "rerank_score")


@query(
    f"""WITH {RERANKED}, {FINAL}, x AS (SELECT rr.*, d.source = 'src1' AS tgt, CASE WHEN query_id % 2 = 0 THEN 'structure' ELSE 'general' END AS route FROM rr JOIN documents d ON d.doc_id = rr.chunk_id),
    g AS (SELECT query_id, route, count(*) AS n, sum(tgt::INT) AS nt, max(CASE WHEN rerank_rank = 1 THEN rerank_score END) AS s1, max(CASE WHEN rerank_rank = 2 THEN rerank_score END) AS s2 FROM x GROUP BY 1, 2)
    SELECT query_id, route, n, CASE WHEN n < 3 THEN 'insufficient_count' WHEN route = 'structure' AND nt = 0 THEN 'no_target_block_hit' WHEN s1 < 0.05 AND coalesce(s2, 0) < 0.04 THEN 'low_rerank_confidence' ELSE 'sufficient' END AS reason,
    NOT (n < 3 OR (route = 'structure' AND nt = 0) OR (s1 < 0.05 AND coalesce(s2, 0) < 0.04)) AS sufficient FROM g"""
)
def sufficiency(t: Tables) -> DataFrame:
    rows = _reranked(t).join(t.documents.select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    rows = rows.select("query_id", F.when(F.col("query_id") % 2 == 0, "structure").otherwise("general").alias("route"), F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"), (F.col("source") == "src1").alias("is_target"), F.lit(True).alias("is_context"))
    return planner.sufficiency(rows)

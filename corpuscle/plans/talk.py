"""Queries over turns: citations by source and page, their report, prompts, answers given, messages kept, evaluation, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators import answers, evaluate, turns
from corpuscle.operators.lexical import bm25

from .registry import Tables, query
from .retrieval import ASKED, LEXICAL, NORM, POST, SCORED, _asked

HITS = f"{POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(20)}, hit AS (SELECT l.query_id, l.lexical_rank AS rank, d.doc_id, d.source, d.lang, d.doc_id % 3 AS page, d.text FROM l JOIN d ON d.doc_id = l.chunk_id)"
CITED = "kc AS (SELECT query_id, source, page, lang, min(rank) AS rank FROM hit GROUP BY 1, 2, 3, 4), ci AS (SELECT kc.*, hit.doc_id, hit.text, CAST(row_number() OVER (PARTITION BY kc.query_id ORDER BY kc.rank) AS INT) AS index FROM kc JOIN hit ON hit.query_id = kc.query_id AND hit.rank = kc.rank)"


def _hits(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("source_name"), F.lit("").alias("source_uri"), F.nullif((F.col("doc_id") % 3).cast("string"), F.lit("0")).alias("page"), F.lit(None).cast("string").alias("page_or_section"), F.array_compact(F.array("lang")).alias("section_path"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
    return bm25(t.documents, _asked(t), 20).select("query_id", "chunk_id", F.col("lexical_rank").alias("rank")).join(docs, "chunk_id")


@query(f"WITH {HITS}, {CITED}, n AS (SELECT *, {NORM.format('text')} AS s FROM ci) SELECT query_id, index, CAST(doc_id AS VARCHAR) AS doc_id, source AS source_name, CASE WHEN page > 0 THEN CAST(page AS VARCHAR) ELSE '' END AS page, coalesce(lang, '') AS section_path, CASE WHEN length(s) <= 180 THEN s ELSE rtrim(left(s, 177)) || '...' END AS snippet FROM n")
def source_citations(t: Tables) -> DataFrame:
    """Citations of each question's hits, one a source, page and path."""
    found = turns.build_citations(_hits(t))
    return found.select("query_id", "index", "doc_id", "source_name", F.coalesce("page", F.lit("")).alias("page"), F.array_join("section_path", "/").alias("section_path"), "snippet")


@query(
    """WITH x AS (SELECT conv_id, turn, text || ' [1] [' || (turn % 5) || '] [9]' AS answer, list_transform(range(1, 4), lambda i: CASE WHEN (turn + i) % 4 = 0 THEN '' ELSE 'd' || (conv_id + i) END) AS c, list_transform(range(1, 3), lambda i: 'd' || (conv_id + i)) AS f FROM conversations WHERE role = 'assistant'),
    y AS (SELECT conv_id, turn, len(regexp_extract_all(answer, '\\[([0-9]+)\\]')) AS said, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda v: CAST(v AS BIGINT))), lambda v: v < 1 OR v > 3)) AS wrong, list_sort(list_filter(c, lambda d: d <> '' AND NOT list_contains(f, d))) AS lost FROM x)
    SELECT conv_id, turn, CASE WHEN len(wrong) = 0 AND len(lost) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, array_to_string(wrong, ',') AS invalid, CAST(3 AS INT) AS citation_count, CAST(said AS INT) AS mentioned, array_to_string(lost, ',') AS unmapped FROM y"""
)
def citation_reports(t: Tables) -> DataFrame:
    """Score and details of every answer: citations of nothing, and cited documents that weren't retrieved."""
    turn, conv = F.col("turn"), F.col("conv_id")
    doc = lambda i: F.concat(F.lit("d"), (conv + i).cast("string"))
    rows = t.conversations.where("role = 'assistant'").select(conv, turn, F.concat("text", F.lit(" [1] ["), (turn % 5).cast("string"), F.lit("] [9]")).alias("answer"), F.array(*(F.when((turn + i) % 4 == 0, "").otherwise(doc(i)) for i in (1, 2, 3))).alias("citation_docs"), F.array(doc(1), doc(2)).alias("found_docs"))
    r = turns.citation_report(rows)
    return r.select("conv_id", "turn", "report.score", F.array_join(F.transform("report.invalid_indices", lambda x: x.cast("string")), ",").alias("invalid"), "report.citation_count", F.col("report.mentioned_citation_count").alias("mentioned"), F.array_join("report.unmapped_doc_ids", ",").alias("unmapped"))


@query(
    f"""WITH h AS (SELECT conv_id, turn, role, text, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM conversations)
    SELECT conv_id, turn, '{turns.ASKED}' || text || chr(10) || chr(10) || '{turns.TALKED.strip()}' || chr(10) || CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) ELSE '{turns.NO_HISTORY}' END || chr(10) || chr(10) || '{turns.FOUND.strip()}' || chr(10) || '[1] source=s' || conv_id || '; title=T; section=; page=; doc_type=txt' || chr(10) || 'context of ' || turn || chr(10) || chr(10) || '{turns.RULE}' AS prompt FROM h WHERE role = 'user'"""
)
def answer_prompts(t: Tables) -> DataFrame:
    """The prompt of every question, with the turns before it."""
    before = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-8, -1))
    none = F.lit(None).cast("string")
    doc = F.struct(F.lit(1).alias("index"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source_name"), F.lit("T").alias("title"), none.alias("section"), none.alias("page"), F.lit("txt").alias("doc_type"), F.concat(F.lit("context of "), F.col("turn").cast("string")).alias("content"))
    rows = t.conversations.withColumn("history", before).where("role = 'user'").withColumn("documents", F.array(doc))
    return rows.select("conv_id", "turn", turns.answer_prompt("text", "history", turns.context_blocks("documents")).alias("prompt"))


def _turns(t: Tables) -> DataFrame:
    """Every assistant's text as a draft; some turns have no documents or no citations, some can be extracted."""
    turn = F.col("turn")
    doc, cite = "array<struct<doc_id:string,page:string,text:string>>", "array<struct<index:int,doc_id:string,page:string,source_name:string>>"
    found = F.array(F.struct(F.lit("d1").alias("doc_id"), F.lit("").alias("page"), F.when(turn % 7 == 1, "本规范适用于桥梁").otherwise("other").alias("text")))
    cites = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(f"d{i}").alias("doc_id"), F.lit("").alias("page"), F.lit(f"s{i}").alias("source_name")) for i in (1, 2)))
    rows = t.conversations.where("role = 'assistant'")
    return rows.select(F.col("conv_id").alias("session_id"), "turn", F.when(turn % 2 == 1, "适用范围").otherwise("其他").alias("question"), F.when(F.col("conv_id") % 5 == 0, F.array().cast(doc)).otherwise(found).alias("documents"), F.when(F.col("conv_id") % 5 == 1, F.array().cast(cite)).otherwise(cites).alias("citations"), F.concat("text", F.lit(" [3] because x")).alias("drafted"))


_SENT = "list_filter(list_transform(regexp_split_to_array({0}, '[。！？!?]+|\\n+'), lambda s: trim(s)), lambda s: s <> '')"
_BARE = "len(list_filter(" + _SENT + ", lambda s: regexp_matches(s, '(?i)[0-9]|%|more|less|higher|lower|increase|decrease|because|therefore|due to|提高|降低|因此|导致') AND NOT regexp_matches(s, '\\[[0-9]+\\]')))"
#: The draft of every turn without citations of nothing, mended, and what is given in the end.
GIVEN = f"""tx AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 1 THEN 0 ELSE 2 END AS n, text || ' [3] because x' AS raw FROM conversations WHERE role = 'assistant'),
sa AS (SELECT conv_id, turn, n, trim(regexp_replace(list_reduce(list_filter(list_distinct(regexp_extract_all(raw, '\\[([0-9]+)\\]', 1)), lambda v: CAST(v AS BIGINT) < 1 OR CAST(v AS BIGINT) > n), lambda a, v: replace(a, '[' || v || ']', ''), raw), ' {{2,}}', ' ', 'g')) AS d FROM tx),
ra AS (SELECT *, CASE WHEN n > 0 THEN array_to_string(list_transform({_SENT.format('d')}, lambda s: s || CASE WHEN regexp_matches(s, '(?i)[0-9]|%|more|less|higher|lower|increase|decrease|because|therefore|due to|提高|降低|因此|导致') AND NOT regexp_matches(s, '\\[[0-9]+\\]') THEN ' [1]' ELSE '' END), ' ') ELSE d END AS m FROM sa),
ga AS (SELECT *, turn % 2 = 1 AND turn % 7 = 1 AND conv_id % 5 > 1 AS ext, conv_id % 5 = 0 AS nodocs, {_BARE.format('d')} = 0 AS fine, {_BARE.format('m')} = 0 AS better FROM ra),
gi AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '适用范围' ELSE '其他' END AS question, CASE WHEN ext THEN '本规范适用于桥梁 [1]。' WHEN nodocs THEN '{turns.NO_CONTEXT}' WHEN fine THEN d WHEN better THEN m WHEN n > 0 THEN '{turns.WEAK}[1] s1, [2] s2。' ELSE '{turns.REJECTED}{turns.NO_SOURCES}。' END AS answer, ext OR (NOT nodocs AND (fine OR better)) AS grounded,
  CASE WHEN ext THEN 'ok' WHEN nodocs THEN 'rejected' WHEN fine OR better THEN 'ok' WHEN n > 0 THEN 'weak_hit' ELSE 'rejected' END AS status, CASE WHEN ext THEN 'normal' WHEN nodocs THEN 'no_context' WHEN fine OR better THEN 'normal' WHEN n > 0 THEN 'weak_evidence' ELSE 'unsupported' END AS reason, CASE WHEN nodocs THEN 0 ELSE n END AS n_citations FROM ga)"""


@query(f"WITH {GIVEN} SELECT conv_id AS session_id, turn, answer, grounded, status, reason, CAST(n_citations AS INT) AS n_citations FROM gi")
def answer_flow(t: Tables) -> DataFrame:
    """Every turn from draft to answer: extracted, refused, checked, mended or given up."""
    return turns.answer_turns(_turns(t)).select("session_id", "turn", "answer", "grounded", "status", "reason", F.size("used_citations").alias("n_citations"))


@query(f"WITH {GIVEN}, ms AS (SELECT conv_id, turn, 0 AS pos, 'user' AS role, question AS content, 'none' AS status FROM gi UNION ALL SELECT conv_id, turn, 1, 'assistant', answer, status FROM gi) SELECT conv_id AS session_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS INT) AS seq, role, content, status FROM ms")
def persisted_turns(t: Tables) -> DataFrame:
    found = turns.persisted(turns.answer_turns(_turns(t)))
    return found.select("session_id", "turn", "seq", "role", "content", F.coalesce("status", F.lit("none")).alias("status"))


_EVAL = f"{POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(4)}, hit AS (SELECT l.query_id, l.lexical_rank AS rank, d.text FROM l JOIN d ON d.doc_id = l.chunk_id)"
_MATCH = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g'))"
_ANCHOR = "(regexp_matches(text, '[0-9]+(?:\\.[0-9]+){1,3}') OR regexp_matches(text, '(?i)[0-9]+(?:\\.[0-9]+)?(?:%|MPa)') OR len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(trim(s), '^[A-Za-z]+\\s+[0-9]+(?:\\.[0-9]+)?$'))) > 0)"


def _samples(t: Tables) -> tuple[DataFrame, DataFrame]:
    samples = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("text").alias("expected"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("ref "), F.col("item_id").cast("string"))).otherwise("").alias("reference_answer"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    hits = bm25(t.documents, _asked(t), 4).join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id").select("query_id", F.col("lexical_rank").alias("rank"), "content")
    return samples, hits


@query(f"WITH {_EVAL} SELECT item_id AS query_id, 'answer ' || item_id AS answer, CAST(count(hit.text) AS INT) AS n_contexts, sha256(coalesce(string_agg(hit.text, '|' ORDER BY rank), '')) AS contexts_sha, CASE WHEN item_id % 2 = 0 THEN 'ref ' || item_id ELSE any_value(benchmark.text) END AS ground_truth FROM benchmark LEFT JOIN hit ON hit.query_id = item_id GROUP BY item_id")
def evaluation_rows(t: Tables) -> DataFrame:
    rows = turns.dataset_rows(*_samples(t))
    return rows.select("query_id", "answer", F.size("contexts").alias("n_contexts"), F.sha2(F.array_join("contexts", "|"), 256).alias("contexts_sha"), "ground_truth")


@query(
    f"""WITH {_EVAL}, sm AS (SELECT item_id AS query_id, text AS expected FROM benchmark), a AS (SELECT sm.query_id, coalesce(bool_or(contains({_MATCH.format('hit.text')}, {_MATCH.format('sm.expected')})), false) AS snip, coalesce(bool_or({_ANCHOR}), false) AS anch FROM sm LEFT JOIN hit ON hit.query_id = sm.query_id GROUP BY 1),
    b AS (SELECT *, CASE WHEN query_id % 4 = 3 THEN 'fallback' ELSE 'ok' END AS status, CASE WHEN query_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS score FROM a)
    SELECT count(*) AS sample_count, CAST(count_if(status = 'ok') AS BIGINT) AS ok_count, CAST(count_if(status <> 'ok') AS BIGINT) AS fallback_count, round(coalesce(avg(score), 0), 9)::DOUBLE AS citation_correctness_avg_all, round(coalesce(avg(score) FILTER (status = 'ok'), 0), 9)::DOUBLE AS citation_correctness_avg_ok, round(coalesce(avg(snip::INT), 0), 9)::DOUBLE AS expected_snippet_hit_rate, round(coalesce(avg(anch::INT), 0), 9)::DOUBLE AS anchor_hit_rate FROM b"""
)
def evaluation_report(t: Tables) -> DataFrame:
    """Rates over all samples: citations that hold, snippets found, anchors among the hits."""
    samples, hits = _samples(t)
    q = F.col("query_id")
    found = evaluate.snippet_hits(samples, hits).join(turns.anchor_hits(samples, hits.select("query_id", answers.text_anchors("content").alias("anchors"))), "query_id")
    return turns.evaluation(found.withColumns({"status": F.when(q % 4 == 3, "fallback").otherwise("ok"), "score": F.when(q % 5 == 0, 0.0).otherwise(1.0)}))


@query("SELECT conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'renamed ' || conv_id WHEN conv_id % 2 = 0 THEN 'old' ELSE '' END AS title, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE min(turn) + 10 END AS created_at, max(turn) + 10 + CASE WHEN conv_id % 3 = 0 THEN 1000 ELSE 0 END AS updated_at FROM conversations GROUP BY conv_id")
def sessions_ensured(t: Tables) -> DataFrame:
    """Every turn ensures its session, of which half exist; every third is renamed."""
    held = t.conversations.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("session_id")).distinct().select("session_id", F.lit("old").alias("title"), F.lit(0).cast("long").alias("created_at"), F.lit(5).cast("long").alias("updated_at"))
    asked = t.conversations.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 10).cast("long").alias("at"))
    last = asked.groupBy("session_id").agg((F.max("at") + 1000).alias("at"))
    names = last.where(F.col("session_id").cast("long") % 3 == 0).select("session_id", F.concat(F.lit("renamed "), "session_id").alias("new_title"), "at")
    found = turns.rename_sessions(turns.ensure_sessions(held, asked), names)
    return found.select(F.col("session_id").cast("long").alias("session_id"), F.coalesce("title", F.lit("")).alias("title"), "created_at", "updated_at")


@query("WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN '{\"turn\": ' || turn || '}' WHEN 2 THEN 'null' ELSE '[' || turn END AS trace FROM conversations WHERE role = 'assistant'), k AS (SELECT * FROM m WHERE trace IS NOT NULL AND trace <> 'null' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id AS session_id, turn AS message_id, trace FROM k WHERE trace LIKE '{%'")
def query_traces(t: Tables) -> DataFrame:
    turn = F.col("turn")
    trace = F.when(turn % 4 == 1, F.concat(F.lit('{"turn": '), turn.cast("string"), F.lit("}"))).when(turn % 4 == 2, "null").when(turn % 4 == 3, F.concat(F.lit("["), turn.cast("string")))
    rows = t.conversations.select(F.col("conv_id").alias("session_id"), turn.alias("message_id"), "role", trace.alias("trace"))
    return turns.query_traces(rows, 3).select("session_id", "message_id", "trace")

"""Queries over the catalogue, sessions, the block graph, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import catalog, evaluate, graph

from .registry import Tables, query
from .retrieval import ASKED, LEXICAL, NORM, POST, SCORED, _asked, bm25

MSG = "m AS (SELECT conv_id AS session_id, turn AS message_id, role, text AS content FROM conversations)"
LINES = "ln AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_order, text FROM (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(text) <> '')"
NEAR = "bl AS (SELECT vec_id // 50 AS page, vec_id AS block_id, CAST(embedding[1] AS DOUBLE) AS cx, CAST(embedding[2] AS DOUBLE) AS cy FROM embeddings)"


def _messages(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"))


@query(f"WITH {MSG} SELECT session_id, left(coalesce(nullif(trim((arg_min(content, message_id) FILTER (role = 'user'))), ''), 'New session'), 32) AS title, count(*) AS message_count, max(message_id) AS last_id FROM m GROUP BY 1")
def session_list(t: Tables) -> DataFrame:
    return catalog.sessions(_messages(t))


@query(f"WITH {MSG} SELECT session_id, message_id, role, content FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) <= 4")
def recent_messages(t: Tables) -> DataFrame:
    return catalog.recent_messages(_messages(t), 4)


@query(f"WITH {MSG}, u AS (SELECT * FROM m WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) <= 3) SELECT session_id, string_agg(content, chr(10) ORDER BY message_id) AS retrieval_query FROM u GROUP BY 1")
def retrieval_query(t: Tables) -> DataFrame:
    return catalog.retrieval_query(_messages(t))


@query(f"WITH {MSG} SELECT session_id, message_id FROM m WHERE session_id % 7 <> 0")
def session_delete_cascade(t: Tables) -> DataFrame:
    gone = t.conversations.where("conv_id % 7 = 0").select(F.col("conv_id").alias("session_id")).distinct()
    return _messages(t).join(gone, "session_id", "left_anti").select("session_id", "message_id")


@query("SELECT source AS doc, count(*) AS n_chunks, array_to_string(list_sort(list_distinct(list(lang))), ',') AS locations, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def doc_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("n_chunks"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("locations"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(t: Tables) -> DataFrame:
    """The log's last row for each key."""
    return catalog.latest(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS version FROM documents UNION ALL SELECT doc_id + 1000000, 'new', 1 FROM documents WHERE doc_id % 10 = 1")
def catalog_upsert(t: Tables) -> DataFrame:
    current = t.documents.select("doc_id", "lang", F.lit(0).alias("version"))
    changes = t.documents.where("doc_id % 10 IN (0, 1)").select(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("lang"), F.lit(1).alias("version"))
    return catalog.upsert(current, changes, "doc_id")


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'deleted' ELSE 'active' END AS status FROM documents")
def soft_delete(t: Tables) -> DataFrame:
    gone = t.documents.where("source = 'src3'").select("doc_id")
    return catalog.soft_delete(t.documents.select("doc_id", F.lit("active").alias("status")), gone, "doc_id")


@query("SELECT doc_id, sha256(text) AS mark FROM documents WHERE doc_id % 3 <> 0")
def noop_skip(t: Tables) -> DataFrame:
    """Documents whose fingerprint hasn't changed."""
    mark = F.sha2(F.col("text").cast("binary"), 256)
    current = t.documents.select("doc_id", mark.alias("mark"))
    changed = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "!").otherwise(""))
    return catalog.unchanged(current, t.documents.select("doc_id", F.sha2(changed.cast("binary"), 256).alias("mark")), "doc_id", "mark")


@query("SELECT s.source AS object, coalesce(n, 0) AS references FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1) c USING (source)")
def ref_counts(t: Tables) -> DataFrame:
    return catalog.reference_counts(t.documents, t.labels, "doc_id", "source").withColumnRenamed("source", "object")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def active_chunks(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("toxic = 0"), "doc_id").select("doc_id", "source", "quality")


@query(f"WITH {LINES} SELECT * FROM (SELECT doc_id, block_order AS source, 'next_block' AS edge_type, lead(block_order) OVER w AS target, 0.72::DOUBLE AS weight FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY block_order) UNION ALL SELECT doc_id, block_order, 'prev_block', lag(block_order) OVER w, 0.72 FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY block_order)) WHERE target IS NOT NULL")
def block_neighbors(t: Tables) -> DataFrame:
    return graph.neighbors(graph.lines(t.documents)).select("doc_id", "source", "edge_type", "target", "weight")


@query(f"WITH {LINES}, e AS (SELECT * FROM (SELECT doc_id, block_order AS source, 'next_block' AS edge_type, lead(block_order) OVER w AS target FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY block_order) UNION ALL SELECT doc_id, block_order, 'prev_block', lag(block_order) OVER w FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY block_order)) WHERE target IS NOT NULL) SELECT doc_id, source, string_agg(edge_type || ':' || target, ',' ORDER BY edge_type, target) AS edges, string_agg(target, ',' ORDER BY edge_type, target) AS neighbors FROM e GROUP BY 1, 2")
def graph_projection(t: Tables) -> DataFrame:
    edges = graph.neighbors(graph.lines(t.documents))
    found = graph.outgoing(graph.distinct_edges(edges.union(edges)))
    return found.select("doc_id", "source", F.array_join("edges", ",").alias("edges"), F.array_join("neighbors", ",").alias("neighbors"))


@query(
    f"""WITH {NEAR}, p AS (SELECT a.page, a.block_id AS source, b.block_id AS target, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS d FROM bl a JOIN bl b ON a.page = b.page AND a.block_id <> b.block_id),
    k AS (SELECT * FROM p WHERE d <= 0.18 QUALIFY row_number() OVER (PARTITION BY page, source ORDER BY d, target) <= 4) SELECT page, source, target, round_even(greatest(0.3, 1 - d), 4)::DOUBLE AS weight FROM k"""
)
def near_edges(t: Tables) -> DataFrame:
    x = lambda i: F.col("embedding")[i].cast("double")
    return graph.near(t.embeddings.select(F.expr("vec_id div 50").alias("page"), F.col("vec_id").alias("block_id"), x(0).alias("cx"), x(1).alias("cy"), F.lit(1.0).alias("diagonal")))


ANSWER = "x AS (SELECT conv_id, turn, text || ' [1] [7]  [2]' AS answer FROM conversations WHERE role = 'assistant')"
SIGNAL = "(?i)[0-9]|%|more|less|higher|lower|increase|decrease|because|therefore|due to"
SENT = "list_filter(list_transform(regexp_split_to_array(answer, '[！？!?。]+|\\n+'), lambda s: trim(s)), lambda s: s <> '')"


def _answers(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" [1] [7]  [2]")).alias("answer"))


#: Citations of an answer that aren't among the first n.
WRONG = "list_filter(list_distinct(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)), lambda x: CAST(x AS HUGEINT) < 1 OR CAST(x AS HUGEINT) > {0})"


@query(f"WITH {ANSWER} SELECT conv_id, turn, trim(regexp_replace(list_reduce({WRONG.format(3)}, lambda a, x: replace(a, '[' || x || ']', ''), answer), ' {{2,}}', ' ', 'g')) AS answer FROM x")
def citation_sanitize(t: Tables) -> DataFrame:
    return _answers(t).select("conv_id", "turn", tx.sanitize_citations("answer", F.lit(3)).alias("answer"))


@query(f"WITH {ANSWER} SELECT conv_id, turn, CAST(len({SENT}) AS INT) AS n_sentences, CAST(len(list_filter({SENT}, lambda s: regexp_matches(s, '{SIGNAL}') AND NOT regexp_matches(s, '\\[[0-9]+\\]'))) AS INT) AS n_uncited, array_to_string(list_transform({SENT}, lambda s: s || CASE WHEN regexp_matches(s, '{SIGNAL}') AND NOT regexp_matches(s, '\\[[0-9]+\\]') THEN ' [1]' ELSE '' END), ' ') AS repaired FROM x")
def answer_validate_repair(t: Tables) -> DataFrame:
    return _answers(t).select("conv_id", "turn", F.size(tx.sentences("answer")).alias("n_sentences"), F.size(tx.uncited("answer")).alias("n_uncited"), tx.repaired("answer").alias("repaired"))


@query(f"WITH {ANSWER}, s AS (SELECT conv_id, turn, unnest({SENT}) AS sentence FROM x) SELECT conv_id, turn, sentence, count(*) AS n FROM s GROUP BY ALL")
def sentence_split(t: Tables) -> DataFrame:
    return _answers(t).select("conv_id", "turn", F.explode(tx.sentences("answer")).alias("sentence")).groupBy("conv_id", "turn", "sentence").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWER} SELECT conv_id, turn, CAST(i AS INT) AS slice_index, substring(answer, i * 120 + 1, 120) AS slice FROM (SELECT conv_id, turn, answer, unnest(range(CAST(ceil(length(answer) / 120.0) AS BIGINT))) AS i FROM x)")
def stream_slices(t: Tables) -> DataFrame:
    return _answers(t).select("conv_id", "turn", F.posexplode(tx.slices("answer")).alias("slice_index", "slice"))


@query(f"WITH {ANSWER} SELECT conv_id, turn, CASE WHEN len(CASE WHEN turn % 2 = 0 THEN {WRONG.format(3)} ELSE {WRONG.format(7)} END) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS correct FROM x")
def citation_correctness(t: Tables) -> DataFrame:
    n = F.when(F.col("turn") % 2 == 0, 3).otherwise(7)
    return _answers(t).select("conv_id", "turn", evaluate.citation_correctness("answer", n).alias("correct"))


MATCH = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g'))"


@query(f"WITH {POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(4)} SELECT b.item_id AS query_id, coalesce(bool_or(contains({MATCH.format('d.text')}, {MATCH.format('b.text')})), false) AS snippet_hit FROM benchmark b LEFT JOIN l ON l.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = l.chunk_id GROUP BY 1")
def snippet_hit(t: Tables) -> DataFrame:
    hits = bm25(t.documents, _asked(t), 4).join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return evaluate.snippet_hits(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("expected")), hits.select("query_id", "content"))


@query("SELECT CASE WHEN quality = 1 THEN 'ok' ELSE 'fallback' END AS status, CASE WHEN toxic = 1 THEN 'unsupported' ELSE 'none' END AS reason, count(*) AS n, round(coalesce(avg(CASE WHEN quality = 1 THEN quality END), 0), 6)::DOUBLE AS mean_ok FROM labels GROUP BY 1, 2")
def fallback_summary(t: Tables) -> DataFrame:
    return t.labels.groupBy(F.when(F.col("quality") == 1, "ok").otherwise("fallback").alias("status"), F.when(F.col("toxic") == 1, "unsupported").otherwise("none").alias("reason")).agg(F.count("*").alias("n"), F.round(evaluate.safe_mean("quality", F.col("quality") == 1), 6).alias("mean_ok"))


PARENTS = f"""{POST}, {ASKED}, {SCORED.format('true')}, {LEXICAL.format(30)}, h AS (SELECT l.*, d.source AS parent FROM l JOIN documents d ON d.doc_id = l.chunk_id)"""


@query(f"WITH {PARENTS} SELECT query_id, parent, max(score) AS score, arg_max(chunk_id, score * 1000000000 - lexical_rank) AS best_chunk, string_agg(chunk_id, ',' ORDER BY chunk_id) AS children, count(*) AS n FROM h GROUP BY 1, 2")
def parent_group(t: Tables) -> DataFrame:
    """Hits of one parent: its best child, all children, the largest score."""
    hits = bm25(t.documents, _asked(t), 30).join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent")), "chunk_id")
    return hits.groupBy("query_id", "parent").agg(F.max("score").alias("score"), F.min_by("chunk_id", "lexical_rank").alias("best_chunk"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("children"), F.count("*").alias("n"))


@query(f"WITH {PARENTS}, f AS (SELECT query_id, parent, min(lexical_rank) AS r FROM h GROUP BY 1, 2) SELECT query_id, parent, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS citation_index FROM f")
def citations(t: Tables) -> DataFrame:
    """One citation for each different source, numbered from 1 in the order of the hits."""
    hits = bm25(t.documents, _asked(t), 30).join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent")), "chunk_id")
    first = hits.groupBy("query_id", "parent").agg(F.min("lexical_rank").alias("r"))
    return first.select("query_id", "parent", F.row_number().over(Window.partitionBy("query_id").orderBy("r")).alias("citation_index"))


@query(f"SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS INT) AS word_pieces, 'chunk-' || left(sha1(doc_id || ':b:p:0:' || left(sha1(text), 12)), 20) AS chunk_id, {NORM.format('left(text, 100)')} AS preview FROM documents")
def chunk_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.word_pieces("text").alias("word_pieces"), tx.child_key(F.col("doc_id").cast("string"), F.lit("b"), F.lit("p"), F.lit("0"), "text").alias("chunk_id"), tx.normalize(F.left("text", F.lit(100))).alias("preview"))

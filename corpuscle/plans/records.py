"""Queries over session files, the bucket store, storage migration and extracted answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import answers, migration
from corpuscle.sources import store
from corpuscle.sources.tables import saved, work_root
from corpuscle.streaming import session_files as files

from .registry import Tables, query

# --- session files: events as actions on the files of users

_KINDS = ["upload", "register", "update", "update", "delete", "recover"]
ACTIONS = """ac AS (SELECT user_id AS session_id, event_id % 3 AS file_id, event_id AS seq, ['upload', 'register', 'update', 'update', 'delete', 'recover'][1 + (event_id // 3 + CAST(floor(value) AS BIGINT)) % 6] AS action,
  ['parsed', 'failed', 'indexed'][1 + event_id % 7 % 3] AS new_status, CASE WHEN event_id % 4 = 0 THEN 'doc' || (event_id % 11) END AS doc_id, CASE WHEN event_id % 5 = 0 THEN event_id % 90 END AS page_count, event_type || '.txt' AS source_name, CASE WHEN event_id % 2 = 0 THEN 'broken' END AS error_message, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 1 THEN 'busy ' || event_id END AS cleanup FROM events WHERE user_id IS NOT NULL),
so AS (SELECT *, row_number() OVER (PARTITION BY session_id, file_id ORDER BY seq) AS k FROM ac),
st AS (SELECT session_id, file_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS action, '' AS outcome, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS doc_id, CAST(NULL AS BIGINT) AS page_count, CAST(NULL AS VARCHAR) AS source_name, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS BIGINT) AS created_seq FROM so WHERE k = 1
  UNION ALL SELECT session_id, file_id, k, seq, action, outcome,
    CASE WHEN keeps THEN p_status WHEN gone THEN NULL WHEN action = 'upload' THEN 'uploaded' WHEN action = 'register' THEN 'indexed' WHEN action = 'update' THEN new_status ELSE 'recover_pending' END,
    CASE WHEN gone OR (NOT keeps AND action = 'upload') THEN NULL WHEN NOT keeps AND action = 'register' THEN doc_id WHEN NOT keeps AND action = 'update' THEN coalesce(doc_id, p_doc_id) ELSE p_doc_id END,
    CASE WHEN gone OR (NOT keeps AND action IN ('upload', 'register')) THEN NULL WHEN NOT keeps AND action = 'update' THEN coalesce(page_count, p_page_count) ELSE p_page_count END,
    CASE WHEN gone THEN NULL WHEN NOT keeps AND action IN ('upload', 'register', 'update') THEN source_name ELSE p_source_name END,
    CASE WHEN keeps THEN p_error WHEN gone OR action IN ('upload', 'register') THEN NULL WHEN action = 'update' THEN CASE WHEN new_status = 'failed' THEN error_message END ELSE '[step=upload] ' || cleanup END,
    CASE WHEN gone THEN NULL WHEN NOT keeps AND action IN ('upload', 'register') THEN seq ELSE p_created END
  FROM (SELECT *, outcome IN ('exists', 'missing', 'already_deleted', 'conflict', 'skipped') AS keeps, outcome = 'ok' AND action IN ('delete', 'recover') AS gone
    FROM (SELECT so.*, st.status AS p_status, st.doc_id AS p_doc_id, st.page_count AS p_page_count, st.source_name AS p_source_name, st.error_message AS p_error, st.created_seq AS p_created,
      CASE WHEN so.action IN ('upload', 'register') THEN CASE WHEN st.status IS NULL THEN 'ok' ELSE 'exists' END WHEN st.status IS NULL THEN CASE WHEN so.action = 'recover' THEN 'already_deleted' ELSE 'missing' END WHEN so.action = 'update' THEN 'ok'
        WHEN so.action = 'delete' AND st.status = 'recover_pending' THEN 'conflict' WHEN so.action = 'recover' AND st.status <> 'recover_pending' THEN 'skipped' WHEN so.cleanup IS NULL THEN 'ok' ELSE 'failed' END AS outcome
      FROM st JOIN so ON so.session_id = st.session_id AND so.file_id = st.file_id AND so.k = st.k + 1)))"""
#: The files there are, after all actions.
HELD = f"{ACTIONS}, hf AS (SELECT * FROM st WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY session_id, file_id ORDER BY k DESC) = 1), hl AS (SELECT * FROM hf WHERE status IS NOT NULL)"


def _actions(t: Tables) -> DataFrame:
    e, none = F.col("event_id"), F.lit(None).cast("string")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    return t.events.where("user_id is not null").select(
        F.col("user_id").alias("session_id"), (e % 3).alias("file_id"), e.alias("seq"), pick(_KINDS, (F.expr("event_id div 3") + F.floor("value")) % 6).alias("action"), pick(["parsed", "failed", "indexed"], e % 7 % 3).alias("status"),
        F.when(e % 4 == 0, F.concat(F.lit("doc"), (e % 11).cast("string"))).alias("doc_id"), none.alias("doc_type"), F.when(e % 5 == 0, e % 90).alias("page_count"), F.concat("event_type", F.lit(".txt")).alias("source_name"), none.alias("source_uri"), none.alias("error_code"),
        F.when(e % 2 == 0, "broken").alias("error_message"), F.when((e % 3 == 0) | (e % 5 == 1), F.concat(F.lit("busy "), e.cast("string"))).alias("cleanup_error"), F.lit("upload").alias("cleanup_step"),
    )


def _outcomes(t: Tables) -> DataFrame:
    """All actions through the stream."""
    root = f"{work_root(t.spark)}/files-{uuid.uuid4().hex}"
    _actions(t).write.parquet(f"{root}/actions")
    files.follow(t.spark, f"{root}/actions", f"{root}/outcomes", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.schema(f"{files.OUTCOME}, batch int").parquet(f"{root}/outcomes")


@query(f"WITH RECURSIVE {HELD} SELECT session_id, file_id, status, coalesce(doc_id, '') AS doc_id, coalesce(page_count, -1) AS page_count, source_name, coalesce(error_message, '') AS error_message, created_seq FROM hl")
def session_files(t: Tables) -> DataFrame:
    """Files after all actions, which a stream with keyed state has followed."""
    found = files.files(_outcomes(t))
    return found.select("session_id", "file_id", "status", F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("page_count", F.lit(-1)).alias("page_count"), "source_name", F.coalesce("error_message", F.lit("")).alias("error_message"), "created_seq")


@query(f"WITH RECURSIVE {ACTIONS} SELECT action, outcome, count(*) AS n FROM st WHERE k > 0 GROUP BY 1, 2")
def session_file_outcomes(t: Tables) -> DataFrame:
    return _outcomes(t).groupBy("action", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {HELD}, gone AS (SELECT * FROM hl WHERE session_id % 4 = 0), rest AS (SELECT * FROM hl WHERE session_id % 4 <> 0)
    SELECT 'snapshot' AS kind, doc_id AS name FROM (SELECT DISTINCT doc_id FROM gone WHERE doc_id IS NOT NULL) WHERE doc_id NOT IN (SELECT doc_id FROM rest WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'upload', uri FROM (SELECT DISTINCT 'u/' || session_id % 40 || '/' || source_name AS uri FROM gone) WHERE uri NOT IN (SELECT 'u/' || session_id % 40 || '/' || source_name FROM rest)"""
)
def deletable_artifacts(t: Tables) -> DataFrame:
    """What deleting every fourth session frees."""
    held = files.files(_outcomes(t)).withColumn("source_uri", F.concat(F.lit("u/"), (F.col("session_id") % 40).cast("string"), F.lit("/"), "source_name"))
    return files.deletable(held, held.where("session_id % 4 = 0"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS INT) AS version, count(*) AS n, max(sha256(CASE WHEN doc_id % 9 = 0 THEN 'new ' ELSE '' END || line)) AS last FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 13 <> 5) GROUP BY 1, 2")
def document_store(t: Tables) -> DataFrame:
    """Lines of all documents in the store; every ninth document replaced, every thirteenth deleted, each touching its buckets only."""
    path = f"{work_root(t.spark)}/store-{uuid.uuid4().hex}"
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("version", F.lit(1))
    new = rows.where("doc_id % 9 = 0").withColumns({"line": F.concat(F.lit("new "), "line"), "version": F.lit(2)})
    store.replace_documents(path, rows, 32)
    store.replace_documents(path, new, 32)
    store.delete_documents(path, rows.schema, t.documents.where("doc_id % 13 = 5").select("doc_id"), 32)
    return store.documents(t.spark, path, rows.schema).groupBy("doc_id", "version").agg(F.count("*").alias("n"), F.max(F.sha2("line", 256)).alias("last"))


# --- migration

_PATH = "'/up/' || CASE WHEN page_id % 5 = 0 THEN 'objects/' || sha256(html) || '.html' ELSE 'p' || (page_id % 50) || '/Page' || page_id || '.HTML' END"
MOVES = f"""up AS (SELECT {_PATH} AS path, sha256(html) AS h, length(html) AS size FROM pages WHERE html IS NOT NULL),
mv AS (SELECT path AS legacy_path, '/up/objects/' || h || '.html' AS object_path, size, row_number() OVER (PARTITION BY h ORDER BY path) = 1 AS first FROM up WHERE NOT starts_with(path, '/up/objects/')),
dc AS (SELECT doc_id, '/up/p' || (doc_id % 50) || '/Page' || doc_id || '.HTML' AS uri FROM documents),
sn AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'Page' || doc_id WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE 'old' || doc_id END || '.normalized.json' AS name, sha256(coalesce(text, '')) AS h FROM documents UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'Page' || doc_id END || '.normalized.json', sha256(coalesce(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END, '')) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 < 2),
pl AS (SELECT dc.doc_id, a.h AS old, b.h AS new FROM dc LEFT JOIN sn a ON a.name = 'Page' || dc.doc_id || '.normalized.json' LEFT JOIN sn b ON b.name = dc.doc_id || '.normalized.json'),
sp AS (SELECT doc_id, CASE WHEN old IS NULL THEN 'noop' WHEN new IS NULL THEN 'rename' WHEN old = new THEN 'delete_duplicate' ELSE 'conflict' END AS action FROM pl)"""


def _migration(t: Tables) -> dict[str, DataFrame]:
    """Uploads from pages, and documents, their snapshots and files from documents."""
    n, p = F.col("doc_id"), F.col("page_id")
    hashed = F.sha2("html", 256)
    uploads = t.pages.where("html is not null").select(F.when(p % 5 == 0, F.concat(F.lit("/up/objects/"), hashed, F.lit(".html"))).otherwise(F.concat(F.lit("/up/p"), (p % 50).cast("string"), F.lit("/Page"), p.cast("string"), F.lit(".HTML"))).alias("path"), hashed.alias("content_hash"), F.length("html").cast("long").alias("size"))
    docs = t.documents.select("doc_id", F.concat(F.lit("/up/p"), (n % 50).cast("string"), F.lit("/Page"), n.cast("string"), F.lit(".HTML")).alias("source_uri"))
    said, i = F.coalesce("text", F.lit("")), n.cast("string")
    one = t.documents.select(F.concat(F.when(n % 3 == 0, F.concat(F.lit("Page"), i)).when(n % 3 == 1, i).otherwise(F.concat(F.lit("old"), i)), F.lit(migration.SNAPSHOT)).alias("name"), F.sha2(said, 256).alias("content_hash"))
    other = t.documents.where("doc_id % 2 = 0 and doc_id % 3 < 2").select(F.concat(F.when(n % 3 == 0, i).otherwise(F.concat(F.lit("Page"), i)), F.lit(migration.SNAPSHOT)).alias("name"), F.sha2(F.when(n % 7 == 0, "x").otherwise(said), 256).alias("content_hash"))
    held = t.documents.select((n % 20).alias("session_id"), n.alias("file_id"), F.when(n % 2 == 0, F.concat(F.lit("/up/p"), (n % 50).cast("string"), F.lit("/Page"), i, F.lit(".HTML"))).otherwise(F.concat(F.lit("/else/"), i)).alias("source_uri"))
    return {"uploads": uploads, "documents": docs, "snapshots": one.union(other), "files": held}


@query(f"WITH {MOVES} SELECT doc_id, action, action = 'conflict' AS conflict, 'Page' || doc_id || '.normalized.json' AS legacy_snapshot FROM sp")
def migration_plan(t: Tables) -> DataFrame:
    m = _migration(t)
    return migration.snapshot_plan(m["documents"], m["snapshots"]).select("doc_id", "action", "conflict", "legacy_snapshot")


@query(f"WITH {MOVES} SELECT legacy_path, object_path, size, first, object_path IN (SELECT path FROM up) AS exists_already FROM mv")
def upload_migrations(t: Tables) -> DataFrame:
    return migration.upload_plan(_migration(t)["uploads"], "/up")


@query(
    f"""WITH {MOVES}, fl AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '/up/p' || (doc_id % 50) || '/Page' || doc_id || '.HTML' ELSE '/else/' || doc_id END AS uri FROM documents)
    SELECT (SELECT count(*) FROM mv) AS uploads_scanned, (SELECT count(*) FROM mv WHERE first AND object_path NOT IN (SELECT path FROM up)) AS uploads_copied, (SELECT count(*) FROM fl JOIN mv ON uri = legacy_path) AS session_files_updated, (SELECT count(*) FROM dc JOIN mv ON uri = legacy_path) AS documents_updated,
    (SELECT count(*) FROM sp WHERE action = 'noop') AS snapshots_noop, (SELECT count(*) FROM sp WHERE action = 'rename') AS snapshots_rename, (SELECT count(*) FROM sp WHERE action = 'delete_duplicate') AS snapshots_delete_duplicate, (SELECT count(*) FROM sp WHERE action = 'conflict') AS snapshots_conflict,
    (SELECT count(DISTINCT name) FROM sn WHERE name NOT IN (SELECT 'Page' || doc_id || '.normalized.json' FROM documents)) AS stale_snapshots, (SELECT count(*) FROM mv) AS deleted_legacy_uploads"""
)
def migration_report(t: Tables) -> DataFrame:
    m = _migration(t)
    moves = saved(migration.upload_plan(m["uploads"], "/up"), "moves")
    plan = saved(migration.snapshot_plan(m["documents"], m["snapshots"]), "plan")
    return migration.summary(moves, migration.rewrites(m["files"], moves), migration.rewrites(m["documents"], moves), plan, migration.stale_snapshots(m["snapshots"], plan), migration.deletable_uploads(moves, m["files"], m["documents"]))


# --- extracted answers

_ASK = ["本规范适用于什么", "混凝土的英文名称是什么", "砂土几天", "制定的目的", "满足什么要求", "用于检测什么", "确定什么指标", "其他问题"]
_SAID = ["第1.0.2条 本规范适用于{0}。其余", "2.1.3 混凝土 {1} concrete body 说明", "表 3.2.1 砂土\n砂土 {2}\n黏土 25", "为了{0}，制定本规范；后", "不应低于{2}MPa；否则", "检测{0}并判定{2}；主要用于{0}", "单桩极限承载力{2}。", "没有答案"]
_WORD, _HEAD = "regexp_extract(text, '[A-Za-z]+', 0)", "regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0)"


@query(
    f"""WITH q AS (SELECT item_id, {_HEAD} AS head, {_WORD} AS word, item_id % 40 AS n, item_id % 8 AS k FROM benchmark),
    a AS (SELECT *, CASE k WHEN 0 THEN '本规范适用于' || head WHEN 1 THEN '混凝土的英文名称是 ' || word || ' concrete body' WHEN 2 THEN '砂土的休止时间是 ' || n || ' 天' WHEN 3 THEN '为了' || head || '，制定本规范' WHEN 4 THEN '不应低于' || n || 'MPa' WHEN 5 THEN '检测' || head || '并判定' || n WHEN 6 THEN '极限承载力' || n END AS said FROM q)
    SELECT item_id, CASE WHEN said IS NULL THEN '' ELSE said || ' [' || CASE WHEN item_id % 3 = 0 THEN 1 WHEN item_id % 5 = 0 THEN 2 ELSE 1 END || ']。' END AS answer FROM a"""
)
def extract_answer(t: Tables) -> DataFrame:
    """Every item asks one of eight questions; the first or the second document answers it, cited by id and page."""
    i = F.col("item_id")
    head, word = F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0), F.regexp_extract("text", "[A-Za-z]+", 0)

    def fill(v: str):
        parts = [v]
        for mark, value in (("{0}", head), ("{1}", word), ("{2}", (i % 40).cast("string"))):
            parts = [y for x in parts for y in ([z for w in [(p, value) for p in x.split(mark)] for z in w][:-1] if isinstance(x, str) else [x])]
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    pick = lambda values: F.get(F.array(*map(fill, values)), (i % 8).cast("int"))
    answering = F.struct(F.lit("d1").alias("doc_id"), F.when(i % 3 == 0, "7").when(i % 5 == 0, "9").otherwise("").alias("page"), pick(_SAID).alias("text"))
    silent = F.struct(F.lit("d0").alias("doc_id"), F.lit("").alias("page"), F.lit("nothing here").alias("text"))
    cite = lambda n, doc, page: F.struct(F.lit(n).alias("index"), F.lit(doc).alias("doc_id"), F.lit(page).alias("page"))
    rows = t.benchmark.select("item_id", pick(_ASK).alias("question"), F.when(i % 2 == 0, F.array(answering)).otherwise(F.array(silent, answering)).alias("documents"), F.array(cite(1, "d1", "7"), cite(2, "d1", "9")).alias("citations"))
    return answers.extract_answer(rows).select("item_id", F.coalesce("extracted", F.lit("")).alias("answer"))

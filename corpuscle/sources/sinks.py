"""What is written: snapshots and parents of documents (rows of the bucket store), messages, traces, reports, and the manifest of an index.

Messages and manifests are appended and never rewritten, so a writer that is lost leaves what was there before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import col

from .store import bucket, delete_documents, read, replace_documents, touched

SNAPSHOT = "doc_id string, block_order int, snapshot string"
PARENT = "doc_id string, parent_chunk_id string, record string"
MESSAGE = "message_id bigint, session_id string, role string, content string, grounded boolean, citations string, retrieval_query string, metadata_filter string, trace string, created_at timestamp"
MANIFEST = "version bigint, schema_version int, index_name string, embedding_model string, embedding_dimension int, vector_id_strategy string, chunk_schema_version int, parent_store_version int, created_at string, updated_at string"
MANIFEST_KEYS = [f.split()[0] for f in MANIFEST.split(", ")][1:]


def _one(spark: SparkSession, values: dict, names: list[str], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(values.get(n) for n in names)], schema)


# --- documents


def write_snapshots(path: str, docs: DataFrame) -> list[int]:
    """Blocks of documents (doc_id, block_order and others) as JSON, a row a block, in place of what their documents had; the buckets written."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("block_order").cast("int").alias("block_order"), F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("snapshot"))
    return replace_documents(path, rows)


def write_parents(path: str, parents: DataFrame) -> list[int]:
    """Parents (doc_id, parent_chunk_id and others) in place of those their documents had; documents without parents keep theirs."""
    rows = parents.select(F.col("doc_id").cast("string").alias("doc_id"), "parent_chunk_id", F.to_json(F.struct(*parents.columns)).alias("record"))
    return replace_documents(path, rows)


def delete_parents(path: str, gone: DataFrame) -> list[int]:
    """Parents of the documents in `gone` (doc_id) leave the store."""
    return delete_documents(path, PARENT, gone.select(F.col("doc_id").cast("string").alias("doc_id")))


def parents_by_ref(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """refs (parent_store_ref and others) with `record`, null where there is none; only buckets of the documents they name are read.

    A ref is the document's id and the parent's, with the first colon between them.
    """
    at = F.instr("parent_store_ref", ":")
    asked = refs.withColumns({"_doc": F.when(at > 1, F.left("parent_store_ref", at - 1)), "_parent": F.when(at > 1, F.substr("parent_store_ref", at + 1))})
    some = touched(asked.where("_doc is not null").select(F.col("_doc").alias("doc_id")))
    held = read(spark, path, PARENT, some).select(F.col("doc_id").alias("_doc"), F.col("parent_chunk_id").alias("_parent"), "record")
    return asked.join(held, ["_doc", "_parent"], "left").drop("_doc", "_parent")


# --- messages, traces, reports


def message_rows(messages: DataFrame) -> DataFrame:
    """messages as they are stored: citations, metadata_filter and trace (arrays, structs or maps) as JSON, `[]` and `null` where there are none."""
    told = lambda c, none: F.coalesce(F.to_json(col(c)), F.lit(none)).alias(c)
    return messages.select("message_id", "session_id", "role", "content", "grounded", told("citations", "[]"), "retrieval_query", told("metadata_filter", "null"), told("trace", "null"), "created_at")


def append_messages(path: str, messages: DataFrame, buckets: int = 64) -> None:
    """Messages added to a table in folders by a hash of their session."""
    rows = message_rows(messages).withColumn("bucket", bucket("session_id", buckets))
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def stored_messages(spark: SparkSession, path: str, sessions: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """All messages, or those of a few sessions, whose folders alone are read."""
    rows = spark.read.schema(f"{MESSAGE}, bucket int").parquet(path)
    if sessions is not None:
        asked = spark.createDataFrame([(s,) for s in sessions], "session_id string")
        rows = rows.where(F.col("bucket").isin([r.b for r in asked.select(bucket("session_id", buckets).alias("b")).distinct().collect()]) & F.col("session_id").isin(sessions))
    return rows.drop("bucket")


def touched_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions (session_id, title, created_at, updated_at) after their messages were added."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    return sessions.join(last, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")


def trace_rows(traces: DataFrame) -> DataFrame:
    """session_id, count, message_id, trace: a row a trace, with how many its session has, so no session is gathered into one row.

    traces: session_id, message_id, trace.
    """
    n = traces.groupBy("session_id").agg(F.count("*").alias("count"))
    return traces.join(n, "session_id").select("session_id", "count", "message_id", "trace")


def export_traces(path: str, traces: DataFrame) -> None:
    """Traces as lines of JSON."""
    trace_rows(traces).write.mode("errorifexists").json(path)


def write_report(path: str, report: DataFrame, made_at: Column) -> None:
    """Rows of a report as lines of JSON with the time they were made; nulls are written out."""
    report.withColumn("generated_at", made_at).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- manifest


def append_manifest(spark: SparkSession, path: str, manifest: dict) -> int:
    """A new version of the manifest, which is the one that counts from now on."""
    version = (read_manifest(spark, path) or {"version": 0})["version"] + 1
    _one(spark, manifest | {"version": version}, ["version", *MANIFEST_KEYS], MANIFEST).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(path)
    return version


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The last version; null where there is none yet."""
    try:
        rows = spark.read.schema(MANIFEST).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    last = rows.orderBy(F.desc("version")).limit(1).collect()
    return last[0].asDict() if last else None


def touch_manifest(spark: SparkSession, path: str, at: str) -> int:
    """A version that differs by its time only."""
    held = read_manifest(spark, path)
    if held is None:
        raise ValueError(f"no manifest in {path}")
    return append_manifest(spark, path, held | {"updated_at": at})


def check_manifest(spark: SparkSession, path: str, schema_version: int, embedding_model: str) -> None:
    """An error if the index was built by another schema or with another model."""
    held = read_manifest(spark, path) or {}
    if held.get("schema_version") != schema_version:
        raise ValueError(f"index has schema version {held.get('schema_version')}, not {schema_version}: rebuild it")
    if held.get("embedding_model") != embedding_model:
        raise ValueError(f"index was built with {held.get('embedding_model')}, not {embedding_model}: rebuild it")

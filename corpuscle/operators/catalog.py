"""The catalogue as an append-only log with a latest-row view, and sessions over messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an upsert is an append."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of their key; columns that one side lacks are null."""
    kept = current.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def unchanged(current: DataFrame, incoming: DataFrame, key: str, mark: str) -> DataFrame:
    """Incoming rows whose key and fingerprint are there already: nothing to write."""
    return incoming.join(current.select(key, mark), [key, mark], "left_semi")


def soft_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """status becomes deleted for the keys given."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marks, key, "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def reference_counts(files: DataFrame, excluded: DataFrame, key: str, by: str) -> DataFrame:
    """How many rows still refer to each value of `by`, the excluded ones apart."""
    left = files.join(excluded.select(key).distinct(), key, "left_anti").groupBy(by).agg(F.count("*").alias("n"))
    return files.select(by).distinct().join(left, by, "left").select(by, F.coalesce("n", F.lit(0)).cast("long").alias("references"))


def sessions(messages: DataFrame, title_chars: int = 32) -> DataFrame:
    """messages: session_id, message_id, role, content -> title (first user message), message_count."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("message_id")))
    found = messages.groupBy("session_id").agg(first.alias("t"), F.count("*").alias("message_count"), F.max("message_id").alias("last_id"))
    return found.select("session_id", F.left(F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.lit("New session")), F.lit(title_chars)).alias("title"), "message_count", "last_id")


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    last = Window.partitionBy("session_id").orderBy(F.desc("message_id"))
    return messages.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def retrieval_query(messages: DataFrame, turns: int = 3) -> DataFrame:
    """The last user messages of a session, oldest first, one a line."""
    asked = recent_messages(messages.where("role = 'user'"), turns)
    return asked.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "content"))), lambda m: m.content), "\n").alias("retrieval_query"))

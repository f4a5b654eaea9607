"""The plan of a storage migration: uploads move to paths named by their content, snapshots to names by document.

Everything is joins over tables of what there is, so a plan is made for any number of files at once; applying it is up to
whoever owns the files, one row at a time and in any order, and a plan made afterwards is empty of what was done.

uploads: path, content_hash, size.  documents: doc_id, source_uri.  session_files: session_id, file_id, source_uri.
snapshots: name, content_hash (names end in `.normalized.json`).  Null paths and hashes take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT = ".normalized.json"
#: Names of snapshots by document begin so.
BY_DOCUMENT = "doc-"


def object_path(root: str, content_hash: Column, path: Column) -> Column:
    """Where content lies by its hash, with the suffix of the path in lower case."""
    suffix = F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))
    return F.concat(F.lit(f"{root}/objects/"), content_hash, suffix)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def upload_plan(uploads: DataFrame, root: str) -> DataFrame:
    """legacy_path, object_path, size, exists_already (an object of that path is there), first (of the uploads with its content: the one that is copied)."""
    inside = F.col("path").startswith(f"{root}/objects/")
    rows = uploads.where("path is not null and content_hash is not null")
    legacy = rows.where(~inside).select(F.col("path").alias("legacy_path"), object_path(root, F.col("content_hash"), F.col("path")).alias("object_path"), "size")
    there = rows.where(inside).select(F.col("path").alias("object_path"), F.lit(True).alias("there")).distinct()
    first = F.row_number().over(Window.partitionBy("object_path").orderBy("legacy_path")) == 1
    return legacy.withColumn("first", first).join(there, "object_path", "left").select("legacy_path", "object_path", "size", F.coalesce("there", F.lit(False)).alias("exists_already"), "first")


def rewrites(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows whose source_uri is an upload that moves, with object_path, their new one."""
    moves = plan.where("legacy_path <> object_path").select(F.col("legacy_path").alias("source_uri"), "object_path")
    return rows.join(moves, "source_uri")


def snapshot_plan(documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """doc_id, legacy_snapshot, target_snapshot, action, conflict for every document.

    noop without a snapshot by the source's name; rename if none stands under the document's; else delete_duplicate if both
    hold the same, conflict if they differ.
    """
    wanted = documents.select("doc_id", F.concat(stem(F.col("source_uri")), F.lit(SNAPSHOT)).alias("legacy_snapshot"), F.concat(F.col("doc_id").cast("string"), F.lit(SNAPSHOT)).alias("target_snapshot"))
    held = lambda name, as_: snapshots.select(F.col("name").alias(name), F.col("content_hash").alias(as_)).distinct()
    rows = wanted.join(held("legacy_snapshot", "old"), "legacy_snapshot", "left").join(held("target_snapshot", "new"), "target_snapshot", "left")
    action = F.when(F.col("old").isNull(), "noop").when(F.col("new").isNull(), "rename").when(F.col("old") == F.col("new"), "delete_duplicate").otherwise("conflict")
    return rows.select("doc_id", "legacy_snapshot", "target_snapshot", action.alias("action"), (action == "conflict").alias("conflict"))


def stale_snapshots(snapshots: DataFrame, plan: DataFrame) -> DataFrame:
    """Names of snapshots that are neither a document's nor the legacy one of any."""
    rows = snapshots.where(F.col("name").endswith(SNAPSHOT) & ~F.col("name").startswith(BY_DOCUMENT))
    return rows.select("name").distinct().join(plan.select(F.col("legacy_snapshot").alias("name")).distinct(), "name", "left_anti")


def deletable_uploads(plan: DataFrame, *referring: DataFrame) -> DataFrame:
    """Legacy paths that nothing names once all rows of `referring` (source_uri) are rewritten: all that move, and no others."""
    named = None
    for rows in referring:
        left = rows.join(plan.where("legacy_path <> object_path").select(F.col("legacy_path").alias("source_uri")), "source_uri", "left_anti").select("source_uri")
        named = left if named is None else named.union(left)
    return plan.select("legacy_path").join(named.select(F.col("source_uri").alias("legacy_path")).distinct(), "legacy_path", "left_anti")


def summary(uploads: DataFrame, moved_files: DataFrame, moved_documents: DataFrame, snapshots: DataFrame, stale: DataFrame, deletable: DataFrame) -> DataFrame:
    """The report's counts in one row: each is an aggregate of its own, joined as single rows."""
    parts = [
        uploads.agg(F.count("*").alias("uploads_scanned"), F.count_if(~F.col("exists_already") & F.col("first")).alias("uploads_copied")), moved_files.agg(F.count("*").alias("session_files_updated")), moved_documents.agg(F.count("*").alias("documents_updated")),
        snapshots.agg(*(F.count_if(F.col("action") == a).alias(f"snapshots_{a}") for a in ("noop", "rename", "delete_duplicate", "conflict"))), stale.agg(F.count("*").alias("stale_snapshots")), deletable.agg(F.count("*").alias("deleted_legacy_uploads")),
    ]
    first, *others = [p.withColumn("_", F.lit(1)) for p in parts]
    for p in others:
        first = first.join(p, "_")
    return first.drop("_")

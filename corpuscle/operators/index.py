"""Runs over the catalogue of an index: rebuilding it, moving a document's address, the log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .display import index_documents


def active(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active chunks of active documents; both carry doc_id and status."""
    return chunks.where("status = 'active'").join(documents.where("status = 'active'").select("doc_id"), "doc_id", "left_semi")


def rebuilt(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, content, metadata of everything that an index holds after it is rebuilt."""
    return index_documents(active(documents, chunks).drop("status"))


def rewrite_uris(documents: DataFrame, chunks: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents and chunks with the addresses that moved (doc_id, new_uri, at; a row a document) names; the others, and what isn't active, stay.

    documents: doc_id, status, source_uri, updated_at.  chunks: doc_id, status, metadata (a JSON object), updated_at; its
    source_uri_or_path changes, and its keys are written in order.  A null or broken metadata becomes an object of that key.
    """
    known = moved.join(documents.where("status = 'active'").select("doc_id"), "doc_id", "left_semi")
    hit = (F.col("status") == "active") & F.col("new_uri").isNotNull()
    docs = documents.join(known, "doc_id", "left").withColumns({"source_uri": F.when(hit, F.col("new_uri")).otherwise(F.col("source_uri")), "updated_at": F.when(hit, F.col("at")).otherwise(F.col("updated_at"))}).drop("new_uri", "at")

    key = "source_uri_or_path"
    own = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: k != key)
    all_of = F.map_concat(own, F.create_map(F.lit(key), F.parse_json(F.to_json(F.array("new_uri")))))
    in_order = F.transform(F.array_sort(F.map_keys(all_of)), lambda k: F.struct(k.alias("key"), F.when(k == key, F.try_variant_get(all_of[k], "$[0]", "variant")).otherwise(all_of[k]).alias("value")))
    told = F.to_json(F.map_from_entries(in_order), {"ignoreNullFields": "false"})
    rows = chunks.join(known, "doc_id", "left").withColumns({"metadata": F.when(hit, told).otherwise(F.col("metadata")), "updated_at": F.when(hit, F.col("at")).otherwise(F.col("updated_at"))}).drop("new_uri", "at")
    return docs, rows


def runs(chunks: DataFrame, known: DataFrame, at, schema_version: int) -> DataFrame:
    """doc_id, run_type (`update` for documents in `known`, else `append`), chunk_count, status, at, schema_version: a log row a document of chunks."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    seen = known.select("doc_id").distinct().withColumn("_seen", F.lit(True))
    kind = F.when(F.col("_seen"), "update").otherwise("append")
    return n.join(seen, "doc_id", "left").select("doc_id", kind.alias("run_type"), "chunk_count", F.lit("completed").alias("status"), at.alias("at"), F.lit(schema_version).alias("schema_version"))

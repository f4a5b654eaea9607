"""Ingest: new files of documents as a stream, written once by fingerprint; a folder of text files from file to stored blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.functions.text import clean_ingest, doc_key
from corpuscle.operators import blocks, display, index
from corpuscle.sources import sinks
from corpuscle.sources import store as buckets
from corpuscle.sources.tables import saved, text_files

SCHEMA = "doc_id long, text string, mark string"


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of doc_id, text under source; a document's new text takes the place of the one in the store.

    A document whose fingerprint is in the store already is left alone, so files are safe to repeat and a batch that is run
    again writes nothing.  A batch reads and writes only the buckets of its own documents.  Of several texts of a document
    in one batch the one with the largest fingerprint stays.
    """
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    marked = stream.withColumn("mark", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))

    def write(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("doc_id").orderBy(F.col("mark").desc())
        new = batch.where("doc_id is not null").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        known = buckets.read(batch.sparkSession, store, SCHEMA, buckets.touched(new)).select("doc_id", "mark")
        buckets.replace_documents(store, new.join(known, ["doc_id", "mark"], "left_anti").select("doc_id", "text", "mark"))

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_folder(spark: SparkSession, folder: str, store: str, schema_version: int = 1) -> DataFrame:
    """Text and markdown files under folder as blocks in the store of snapshots; the log: doc_id, run_type, chunk_count, status, at, schema_version.

    A file's document is named by its path in lower case, and its blocks take the place of those it had; ingesting it again
    gives the same store.  Files of other kinds, and those without any block, are logged as skipped with no chunks and leave
    the store as it is, as do files of no bytes, which Spark doesn't list; a suffix of no known kind is an error before anything
    is written.
    """
    files = text_files(spark, folder).withColumn("doc_id", doc_key("file", F.lower("path")))
    files = saved(files.select("doc_id", "source_type", "source_name", F.col("path").alias("source_uri"), F.lit(None).cast("string").alias("title"), F.col("content").alias("text"), "updated_at"), "files")
    read = files.where(F.col("source_type").isin("txt", "markdown"))
    found = blocks.blocks(read.select("doc_id", clean_ingest("text").alias("text")))
    found = found.select("*", F.concat_ws("-", "doc_id", F.col("block_order").cast("string")).alias("block_id"), F.lit(1).alias("page_number"), F.lit("1").alias("page_label"))
    rows = saved(display.normalized_documents(found, read).join(read.select("doc_id", "updated_at"), "doc_id"), "normalized")
    known = saved(buckets.read(spark, store, sinks.SNAPSHOT, buckets.touched(rows)).select("doc_id").distinct(), "known")
    sinks.write_snapshots(store, rows)
    log = index.runs(rows, known, F.current_timestamp(), schema_version)
    left = files.select("doc_id").join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    skipped = left.select("doc_id", F.lit("noop").alias("run_type"), F.lit(0).cast("long").alias("chunk_count"), F.lit("skipped").alias("status"), F.current_timestamp().alias("at"), F.lit(schema_version).alias("schema_version"))
    return log.unionByName(skipped)

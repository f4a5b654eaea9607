"""Parquet tables and file sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files by suffix.
KINDS = {"docx": "word", "md": "markdown", "csv": "csv", "json": "json", "txt": "txt", "pdf": "pdf"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_kind(path: Column) -> Column:
    """Source type by lower-case suffix; any other suffix is an error."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for kv in KINDS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[suffix], F.raise_error(F.concat(F.lit("unsupported file type: "), path)).cast("string"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, source_name, title (its stem), source_type, content, updated_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("source_name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), file_kind(F.col("path")).alias("source_type"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("updated_at"), F.sha2("content", 256).alias("content_hash"))


def json_samples(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: a JSON array of samples."""
    return spark.read.schema("question string, expected_source_name string, expected_snippet string, reference_answer string, allow_uncertain boolean").json(path, multiLine=True)


def web_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages as web documents named by their host."""
    return pages.select("page_id", "url", F.expr("parse_url(url, 'HOST')").alias("source_name"), F.lit("web").alias("source_type"), F.col("html").alias("content"))


def work_root(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; where that is unset, a local one under a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back, so that what follows starts from its files."""
    path = f"{work_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

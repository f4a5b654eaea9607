"""A store of documents' rows in buckets, in which documents are replaced without reading or writing the other buckets.

Rows lie in folders by a hash of their doc_id.  A change reads only the buckets its documents fall into, merges, writes the
result as a table of its own, and then puts it in the place of those buckets by dynamic partition overwrite: a writer that is
lost before leaves the store as it was, and the same change done twice gives the same store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved

BUCKETS = 256


def bucket(key: str | Column = "doc_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the rows' documents: at most as many numbers as there are buckets."""
    return sorted(r.bucket for r in rows.select(bucket(buckets=buckets).alias("bucket")).distinct().collect())


def read(spark: SparkSession, path: str, schema, some: list[int] | None = None) -> DataFrame:
    """Rows of the store, or of some buckets; the others' files aren't listed.  An empty frame where there is no store yet."""
    full = f"{schema if isinstance(schema, str) else schema.simpleString()[len('struct<') : -1].replace(':', ' ')}, bucket int"
    try:
        rows = spark.read.schema(full).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], full)
    return rows if some is None else rows.where(F.col("bucket").isin(some))


def _put(merged: DataFrame, path: str, some: list[int]) -> None:
    """The merged rows in place of the buckets; one of which nothing is left keeps a file without rows."""
    spark, rows = merged.sparkSession, saved(merged, "merged")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    emptied = sorted(set(some) - {r.bucket for r in rows.select("bucket").distinct().collect()})
    if emptied:
        # dynamic overwrite leaves partitions alone that get no row: rows of no document stand there instead
        names = [f for f in merged.schema.fields if f.name != "bucket"]
        blank = spark.createDataFrame([(b,) for b in emptied], "bucket int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in names), "bucket")
        blank.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_documents(path: str, rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Rows of the documents in `rows` take the place of all they had; other documents stay.  The buckets written.

    Rows of null doc_id are left out.
    """
    rows = rows.where("doc_id is not null").drop("bucket")
    some = touched(rows, buckets)
    if some:
        old = read(rows.sparkSession, path, rows.schema, some).where("doc_id is not null").join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        _put(old.unionByName(rows.withColumn("bucket", bucket(buckets=buckets))), path, some)
    return some


def delete_documents(path: str, schema, gone: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Documents named in `gone` leave the store; the buckets written.  Documents the store hasn't got change nothing."""
    gone = gone.where("doc_id is not null").select("doc_id").distinct()
    there = read(gone.sparkSession, path, schema, touched(gone, buckets)).join(gone, "doc_id", "left_semi")
    some = touched(there, buckets)
    if some:
        old = read(gone.sparkSession, path, schema, some).where("doc_id is not null").join(gone, "doc_id", "left_anti")
        _put(old, path, some)
    return some


def documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the store."""
    return read(spark, path, schema).where("doc_id is not null").drop("bucket")

"""Small helpers the corpus operators share: tables, the shared work folder, and Arrow-in/Arrow-out tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only under a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps, and retries after a lost executor, start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: list = []


def kept_by_worker(make):
    """make's results, one for each Python worker and arguments, until a task of another module's function begins there."""
    cached = functools.cache(make)
    _KEPT.append(cached)
    return cached


def forget_others(module: str) -> None:
    """Drops what this worker keeps for tasks of other modules; such objects may hold each other."""
    others = [x for x in _KEPT if x.__module__ != module and x.cache_info().currsize]
    for x in others:
        x.cache_clear()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(fn):
    """fn over a task's batches; its worker, which lives on, first forgets what other operators kept, and gives memory back at the end."""

    @functools.wraps(fn)
    def run(batches):
        forget_others(fn.__module__)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_small_batches(spark: SparkSession, rows: int = 256) -> None:
    """From now on Spark hands Python tasks at most so many rows at a time, so whole texts take little room beside the heap."""
    spark.conf.set(_BATCH, str(rows))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """set_small_batches, within."""
    before = spark.conf.get(_BATCH)
    set_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Rows of a few numbers each that every executor may hold.
SMALL = 1 << 18


def if_small(table: DataFrame, rows: int = SMALL) -> DataFrame:
    """A saved table of few columns, to be broadcast if its counted rows are few; else it joins as Spark sees fit."""
    return F.broadcast(table) if table.count() <= rows else table


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without building Python strings."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Exact dense retrieval by squared distance, for batches of query vectors.

Queries are counted and go to the tasks in blocks of at most BLOCK vectors; a task measures its vectors against a block by
arrays and passes on the k nearest of each query.  A larger batch reads the vectors once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors of a block, numbers of a difference worked out at a time, candidates a task holds.
BLOCK, AT_ONCE, HELD = 4096, 1 << 22, 1 << 17


def _best(found: pa.Table, k: int) -> pa.Table:
    found = found.sort_by([("query", "ascending"), ("d", "ascending"), ("chunk_id", "ascending")])
    query = found["query"].to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def _nearest(rows: DataFrame, block: list, kind: T.DataType, k: int) -> DataFrame:
    """query_id, chunk_id, allowed, d: of each task the k nearest of each query of the block."""
    size = len(block[0].query_vector)
    held = rows.sparkSession.sparkContext.broadcast(([r.query_id for r in block], np.array([r.query_vector for r in block], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        found, held_rows = [], 0
        step = max(1, AT_ONCE // q.size)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                d = np.round(((x[:, None, :] - q[None]) ** 2).sum(axis=2), 9)
                most = np.partition(d, k - 1, axis=0)[k - 1] if len(d) > k else np.full(d.shape[1], np.inf)
                row, query = np.nonzero(d <= most)
                at_rows = pa.array(row)
                found.append(pa.table({"query": pa.array(query), "d": pa.array(d[row, query]), "chunk_id": batch.column("chunk_id").take(at_rows), "allowed": batch.column("allowed").take(at_rows)}))
                held_rows += len(row)
                if held_rows > HELD:
                    found, held_rows = [_best(pa.concat_tables(found), k)], 0
        if found:
            best = _best(pa.concat_tables(found), k).combine_chunks()
            names = pa.array([i.asDict() if isinstance(i, Row) else i for i in ids], to_arrow_type(kind))
            yield from pa.table({"query_id": names.take(best["query"].combine_chunks()), "chunk_id": best["chunk_id"], "allowed": best["allowed"], "d": best["d"]}).to_batches(max_chunksize=1 << 16)

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("allowed", T.BooleanType()), T.StructField("d", T.DoubleType())])
    return rows.where(F.size("v") == size).mapInArrow(run, schema)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, chunk_id, score, dense_rank; queries: query_id, query_vector.

    The k nearest are taken first and the filter applies to them, so fewer may remain; ranks count what remains.  Vectors
    that are null, hold a null or have another length than the queries' take no part.
    """
    allowed = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    rows = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v"), allowed.alias("allowed")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    queries = queries.where(F.col("query_vector").isNotNull() & ~F.exists("query_vector", lambda x: x.isNull())).select("query_id", "query_vector")
    n, kind = queries.count(), queries.schema["query_id"].dataType
    parts = -(-2 * n // BLOCK) if n > BLOCK else 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    found = []
    for i in range(parts):
        some: dict[int, list] = {}
        for r in queries.where(part == i).collect():  # about half a block where there are several
            some.setdefault(len(r.query_vector), []).append(r)
        found += [_nearest(rows, block, kind, k) for block in some.values()]
    if not found:
        found = [rows.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("allowed", T.BooleanType()), T.StructField("d", T.DoubleType())]))]
    near = Window.partitionBy("query_id").orderBy("d", "chunk_id")
    best = reduce(DataFrame.union, found).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).where("allowed")
    return best.select("query_id", "chunk_id", F.round(1 / (1 + F.greatest("d", F.lit(0.0))), 6).alias("score"), F.row_number().over(near).alias("dense_rank"))

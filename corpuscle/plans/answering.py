"""Queries over the whole way from a question to its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import retrieve as way

from .registry import Tables, query


def _inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions of all kinds, their vectors, documents as chunks of their source's type, and the vectors."""
    i = F.col("item_id")
    said = F.concat(F.when(i % 4 == 0, "Explain Figure 2 ").when(i % 4 == 1, "Table 3 ").otherwise(""), F.col("text"))
    queries = t.benchmark.select(i.alias("query_id"), said.alias("query"))
    vectors = t.benchmark.select(i.alias("query_id")).join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    kind = F.when(F.col("source") == "src1", "table").when(F.col("source") == "src2", "image").when(F.col("source") == "src3", "section_header").otherwise("paragraph")
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), kind.alias("block_type"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("parent_id"))
    return queries, vectors, chunks, t.embeddings


@query()
def retrieve(t: Tables) -> DataFrame:
    """All questions through plan, rounds, reranking, retry and hydration; a plain Python version tests it."""
    found = way.retrieve(*_inputs(t))
    return found.withColumn("children", F.array_join("children", ","))

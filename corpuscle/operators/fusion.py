"""Reciprocal-rank fusion over lists, query variants and retry rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def best_rank() -> F.Column:
    return F.coalesce(F.least("dense_rank", "lexical_rank"), F.lit(10000))


def rrf(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, dense_rank, lexical_rank, best_rank, fusion_score, fusion_rank of the k best."""
    both = dense.select("query_id", "chunk_id", "dense_rank").join(lexical.select("query_id", "chunk_id", "lexical_rank"), ["query_id", "chunk_id"], "full")
    share = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumns({"fusion_score": F.round(share("dense_rank") + share("lexical_rank"), 9), "best_rank": best_rank()})
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "best_rank", "chunk_id")
    return both.withColumn("fusion_rank", F.row_number().over(order)).where(F.col("fusion_rank") <= k)


def weighted_rrf(lists: DataFrame, k: int, by: str = "variant_id") -> DataFrame:
    """lists: query_id, <by>, weight, chunk_id, rank -> the k best by the sum of weight / (60 + rank); a single list keeps its order."""
    found = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("fusion_score"),
        F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set(by)), ",").alias("sources"), F.max((F.col(by) == "original").cast("int")).alias("has_original"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.desc("has_original"), "best_rank", "chunk_id")
    return found.withColumn("fusion_rank", F.row_number().over(order)).where(F.col("fusion_rank") <= k).drop("has_original")

"""Retrieval from question to parent texts for a whole batch: plan, recall, fuse, rerank, assess, retry, hydrate.

Recall runs once for all variants of all questions, as deep as the widest retry asks; the first round, the widened one
and the one with a keyword variant are ranks of those lists, so a retry scans nothing again.  After recall all tables are
as small as the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.sources.tables import saved

from . import planner
from .dense import dense_topk
from .fusion import RRF_K, best_rank
from .lexical import bm25
from .rerank import rerank

# What a target adds, what a section adds at most, how many targets make a hard choice, weight of a retry.
BIAS, SECTION_BIAS, LEAST_TARGETS, RETRY_WEIGHT = 0.06, 0.03, 2, 0.95
AIMED = ("structure", "explained_structure")
KEY = ["query_id", "round"]


def rounds(planned: DataFrame) -> DataFrame:
    """A row for each question, round and variant: its text, weight, budgets and targets; only the first round aims hard."""
    wide = planner.widen(planned)
    order = F.when(F.col("variant_id") == "original", 0).when(F.col("variant_id") == "keyword_focused", 1).when(F.col("variant_id") == "clarified", 2).otherwise(3)
    variants = planner.expand(planned).withColumn("rounds", F.array(*map(F.lit, (1, 2, 3)))).unionByName(planner.retry_variant(planned).withColumn("rounds", F.array(F.lit(3))))
    rows = variants.withColumn("variant_order", order).join(wide.drop("tokens"), "query_id").withColumn("round", F.explode("rounds")).drop("rounds")
    first = F.col("round") == 1
    budget = {f"{n}_k": F.when(first, F.col(f"{n}_k")).otherwise(F.col(f"retry_{n}_k")).cast("int") for n in ("dense", "lexical", "fusion")}
    return rows.withColumns(budget).withColumn("hard", first & F.col("route").isin(*AIMED))


def _section_hit(columns: list[str]) -> Column:
    parts = [c for c in (F.col("title") if "title" in columns else None, F.col("caption_text") if "caption_text" in columns else None, F.array_join("section_path", " ") if "section_path" in columns else None) if c is not None]
    return F.exists("section_terms", lambda x: F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(x))) if parts else F.lit(False)


def annotated(rows: DataFrame) -> DataFrame:
    """Candidates with is_target, is_soft, targeting_bias and priority (0 target, 1 soft target, 2 section, 3 other)."""
    rows = rows.withColumns({"block_type": F.lower(F.coalesce("block_type", F.lit("paragraph"))), "in_section": F.coalesce(_section_hit(rows.columns), F.lit(False))})
    rows = rows.withColumns({"is_target": F.array_contains("targets", F.col("block_type")), "is_soft": F.array_contains("soft_targets", F.col("block_type"))})
    bias = F.when(F.col("is_target"), BIAS).when(F.col("is_soft"), BIAS / 2).otherwise(0.0) + F.when(F.col("in_section"), min(SECTION_BIAS, BIAS / 2)).otherwise(0.0)
    explains = (F.col("route") == "explained_structure") & (F.col("block_type") == "paragraph")
    return rows.withColumns({"targeting_bias": bias, "priority": F.when(F.col("is_target") & ~explains, 0).when(F.col("is_target") | F.col("is_soft"), 1).when(F.col("in_section"), 2).otherwise(3)})


def candidates(asks: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, deepest: int) -> DataFrame:
    """The fused candidates of each question and round, in fusion_rank order."""
    by = [*KEY, "variant_id"]
    texts = asks.select(F.struct("query_id", "variant_id", "hard").alias("query_id"), F.col("variant").alias("query"), F.when(F.col("hard"), F.col("targets")).alias("only")).distinct()
    lexical = bm25(chunks, texts, deepest, id_col="chunk_id", text_col="content").select("query_id.*", "chunk_id", "lexical_rank")
    lexical = asks.join(lexical, ["query_id", "variant_id", "hard"]).where("lexical_rank <= lexical_k").select(*by, "chunk_id", F.lit(None).cast("int").alias("dense_rank"), "lexical_rank")
    dense = asks.join(dense_topk(vectors, query_vectors, deepest), "query_id").where("dense_rank <= dense_k").select(*by, "chunk_id", "dense_rank", F.lit(None).cast("int").alias("lexical_rank"))
    lists = dense.union(lexical).groupBy(*by, "chunk_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"))
    info = chunks.select("chunk_id", *(c for c in ("block_type", "title", "section_path", "caption_text") if c in chunks.columns))
    rows = annotated(lists.join(asks.select(*by, "variant_order", "weight", "hard", "route", "targets", "soft_targets", "section_terms", "fusion_k"), by).join(info, "chunk_id"))
    # enough targets among the nearest: only they stay in that list
    own = Window.partitionBy(*by)
    enough = F.col("hard") & (F.sum((F.col("is_target") & F.col("dense_rank").isNotNull()).cast("int")).over(own) >= LEAST_TARGETS)
    rows = rows.withColumn("enough", enough).withColumn("dense_rank", F.when(~F.col("enough") | F.col("is_target"), F.col("dense_rank"))).where("dense_rank IS NOT NULL OR lexical_rank IS NOT NULL")
    share = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    rows = rows.withColumns({"score": F.round(share("dense_rank") + share("lexical_rank"), 9), "best_rank": best_rank()})
    rows = rows.withColumn("n", F.row_number().over(own.orderBy(F.desc("score"), "best_rank", "chunk_id"))).where("n <= fusion_k")
    rows = rows.withColumns({"rank": F.row_number().over(own.orderBy("priority", F.desc("score"), "best_rank", "chunk_id")), "lists": F.size(F.collect_set("variant_id").over(Window.partitionBy(*KEY)))})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("variant_order"))).alias(c)
    keep = ["block_type", "is_target", "is_soft", "targeting_bias", "priority", "fusion_k", "route", "lists", *(c for c in info.columns if c not in ("chunk_id", "block_type"))]
    fused = rows.groupBy(*KEY, "chunk_id").agg(
        F.when(F.first("lists") == 1, F.max("score")).otherwise(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9)).alias("fusion_score"), first("dense_rank"), first("lexical_rank"),
        F.min("rank").alias("rank"), F.count("*").alias("n_variants"), F.max((F.col("variant_id") == "original").cast("int")).alias("has_original"), *(F.first(c).alias(c) for c in keep),
    ).withColumn("best_rank", best_rank())
    order = Window.partitionBy(*KEY).orderBy(F.when(F.col("lists") == 1, F.col("rank")).otherwise(0), F.desc("fusion_score"), F.desc("has_original"), "best_rank", "chunk_id")
    return fused.withColumn("fusion_rank", F.row_number().over(order)).where("fusion_rank <= fusion_k").drop("rank", "lists", "fusion_k")


def _ranked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Reranked within a question and round, as many as the route's budget."""
    rows = rows.join(asked, "query_id").withColumn("query_id", F.struct("query_id", "round")).drop("round")
    return rerank(rows, 1 << 20).where("rerank_rank <= rerank_k").select("query_id.*", *(c for c in rows.columns if c not in ("query_id", "query", "rerank_k")), "rerank_score", "rerank_rank")


def _assessed(ranked: DataFrame, k: int) -> DataFrame:
    rows = ranked.select(F.struct("query_id", "round").alias("query_id"), "route", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"), "is_target", (F.col("is_target") | F.col("is_soft")).alias("is_context"))
    return planner.sufficiency(rows, k).select("query_id.*", "reason", "sufficient")


def retrieve(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 4, dense: int = 30, lexical: int = 30, fusion: int = 20) -> DataFrame:
    """The k best texts of each question, and what became of it on the way.

    queries: query_id, query; query_vectors: query_id, query_vector; chunks: chunk_id, content, block_type, parent_id
    (null for a chunk that stands for itself), and where they have them title, section_path, caption_text; vectors:
    vec_id, embedding.  Returns query_id, result_rank, chunk_id (the best child), parent_id, children, score, route,
    round (the last that ran), retry_reason and status.  A question that finds nothing has no row.
    """
    planned = planner.plan(planner.route(planner.analyze(queries)), k, dense, lexical, fusion)
    deepest = max(-(-3 * max(dense, 4 * k) // 2), -(-3 * max(lexical, 4 * k) // 2))
    found = candidates(rounds(planned), query_vectors, chunks, vectors, deepest)
    # texts once, for all rounds' candidates
    found = found.join(chunks.select("chunk_id", "content"), "chunk_id")
    asked = planned.select("query_id", F.col("normalized").alias("query"), "rerank_k")
    ranked = saved(_ranked(found, asked), "ranked")
    judged = _assessed(ranked, k).groupBy("query_id").pivot("round", [1, 2]).agg(F.first("sufficient").alias("ok"), F.first("reason").alias("reason"))
    more = planner.retry_variant(planned).select("query_id", F.lit(True).alias("more"))
    last = F.when(F.coalesce("1_ok", F.lit(False)) | (F.col("retry") == "none"), 1).when(F.coalesce("2_ok", F.lit(False)) | F.col("more").isNull(), 2).otherwise(3)
    fate = judged.join(planned.select("query_id", "retry"), "query_id").join(more, "query_id", "left").select("query_id", last.alias("last"), F.col("1_reason").alias("first_reason"))
    mine = ranked.join(fate, "query_id").where("round = 1 OR round = last")
    weight = F.when(F.col("round") == 1, F.lit(1.0)).otherwise(F.lit(RETRY_WEIGHT))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("round"))).alias(c)
    keep = [c for c in ("content", "block_type", "title", "section_path", "caption_text", "is_target", "is_soft", "targeting_bias", "route", "last", "first_reason") if c in mine.columns]
    both = mine.groupBy("query_id", "chunk_id").agg(F.when(F.first("last") == 1, F.max("fusion_score")).otherwise(F.round(F.sum(weight / (RRF_K + F.col("rerank_rank"))), 9)).alias("fusion_score"), first("dense_rank"), first("lexical_rank"), F.max("n_variants").alias("n_variants"), F.max("has_original").alias("has_original"), F.min("rerank_rank").alias("at"), *(F.first(c).alias(c) for c in keep))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("last") == 1, F.col("at")).otherwise(0), F.desc("fusion_score"), F.desc("has_original"), "best_rank", "chunk_id")
    both = both.withColumn("best_rank", best_rank()).withColumns({"fusion_rank": F.row_number().over(order), "round": F.col("last")}).drop("at", "last")
    final = _ranked(both, asked)
    status = _assessed(final, k).select("query_id", F.when(F.col("sufficient"), "ok").otherwise("weak_hit").alias("status"))
    return hydrated(final.join(chunks.select("chunk_id", "parent_id"), "chunk_id").join(status, "query_id"), k)


def hydrated(final: DataFrame, k: int) -> DataFrame:
    """Children of one parent as one result with its best child; the k best, parents before chunks without one where scores are equal."""
    alone = F.col("parent_id").isNull()
    place = F.struct("rerank_rank", "chunk_id")
    rows = final.groupBy("query_id", F.coalesce(F.concat(F.lit("p"), F.col("parent_id").cast("string")), F.concat(F.lit("c"), F.col("chunk_id").cast("string"))).alias("key")).agg(
        F.max("rerank_score").alias("score"), F.min_by("chunk_id", place).alias("chunk_id"), F.first("parent_id").alias("parent_id"), F.array_sort(F.collect_set("chunk_id")).alias("children"), F.min("rerank_rank").alias("at"), F.max(alone.cast("int")).alias("alone"),
        *(F.first(c).alias(c) for c in ("route", "round", "first_reason", "status")),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "alone", "at")
    rows = rows.withColumn("result_rank", F.row_number().over(order)).where(F.col("result_rank") <= k)
    return rows.select("query_id", "result_rank", "chunk_id", "parent_id", "children", "score", "route", "round", F.when(F.col("round") > 1, F.col("first_reason")).otherwise("none").alias("retry_reason"), "status")

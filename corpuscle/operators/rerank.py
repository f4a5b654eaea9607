"""Heuristic reranking as one expression over query and candidate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import normalize, search_tokens

# Words that ask for a kind of block, and what finding it adds.
BLOCK_WORDS = [("table", "table row column schema field", 0.06), ("image", "image figure fig diagram screenshot", 0.06), ("formula", "formula equation math", 0.06), ("caption", "caption figure table", 0.04)]
BUDGET = 220


def _overlap(q: Column, text: Column) -> Column:
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, search_tokens(text))) / F.size(q)).otherwise(0.0)


def rerank_score(columns: list[str]) -> Column:
    """Over query, content, fusion_score, best_rank, and of the rest what the candidates have.

    title, section_path, caption_text, block_type, clause_id, table_id, is_normative, english_alias, numeric_terms,
    row_key, is_anchor, n_variants, targeting_bias.
    """
    empty = F.array().cast("array<string>")
    default = {"title": F.lit(""), "section_path": empty, "caption_text": F.lit(""), "block_type": F.lit("paragraph"), "clause_id": F.lit(""), "table_id": F.lit(""), "is_normative": F.lit(False), "english_alias": F.lit(""), "numeric_terms": empty, "row_key": F.lit(""), "is_anchor": F.lit(False), "n_variants": F.lit(1), "targeting_bias": F.lit(0.0)}
    c = {k: F.coalesce(F.col(k), v) if k in columns else v for k, v in default.items()}
    q, text, tokens = normalize("query"), normalize("content"), search_tokens("query")
    content = search_tokens("content")
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    inside = lambda x: (x != "") & F.contains(q, x)
    exact = (F.size(tokens) > 0) & F.contains(F.array_join(content, " "), F.array_join(tokens, " "))
    boost = F.lit(0.0)
    for kind, words, gain in reversed(BLOCK_WORDS):
        boost = F.when((F.lower(c["block_type"]) == kind) & F.arrays_overlap(tokens, F.array(*map(F.lit, words.split()))), gain).otherwise(boost)
    size = F.greatest(F.size(content), F.lit(1))
    return (
        0.30 * F.col("fusion_score") + 0.20 * _overlap(tokens, F.col("content")) + 0.10 * one(exact)
        + 0.09 * _overlap(tokens, c["title"]) + 0.08 * _overlap(tokens, F.array_join(c["section_path"], " ")) + 0.06 * _overlap(tokens, c["caption_text"])
        + 0.05 / (F.col("best_rank") + 1.0)
        + 0.06 * one(inside(c["clause_id"])) + 0.06 * one(inside(c["table_id"]))
        + 0.05 * one(c["is_normative"] & q.rlike("目的|适用|规定|要求|不应|应满足|用于|检测")) + 0.05 * one((c["english_alias"] != "") & q.rlike("(?i)英文|english"))
        + 0.05 * one((F.size(c["numeric_terms"]) > 0) & q.rlike("(?i)%|mpa|多少|几|天|要求|阈值|强度|数值")) + 0.06 * one(inside(c["row_key"]))
        + 0.04 * one(c["is_anchor"])
        + 0.08 * one(q.rlike("目的|宗旨") & F.contains(text, F.lit("制定本规范"))) + 0.08 * one(F.contains(q, F.lit("适用")) & F.contains(text, F.lit("适用于")))
        + 0.07 * one(F.contains(q, F.lit("主要用于")) & text.rlike("主要用于|检测[^。；]*判定")) + 0.07 * one(q.rlike("承载力指标|确定什么") & F.contains(text, F.lit("极限承载力")))
        + F.least(F.lit(0.08), F.greatest(c["n_variants"] - 1, F.lit(0)) * 0.03) + boost + c["targeting_bias"]
        - F.least(F.lit(0.05), F.greatest(size - BUDGET, F.lit(0)) / BUDGET * 0.05)
    )


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """candidates with fusion_rank -> rerank_score (9 places) and rerank_rank, the k best; ties keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fusion_rank")
    scored = candidates.withColumn("rerank_score", F.round(rerank_score(candidates.columns), 9))
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)

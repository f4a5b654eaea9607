"""Query planning as columns: signals, route, budgets, variants, retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import CLAUSE, TABLE, col, normalize, search_tokens

# Signals, stop-words and keyword terms.
WORD = r"(?U)[\w一-鿿]+"
STRUCTURE = r"(?i)\b(?:figure|fig\.?|table|section|page|equation|formula)\b|[图表公式]\s*\d+|第\s*\d+\s*[章节页]"
EXPLAIN = r"(?i)\b(?:explain|meaning|tradeoff|result|results|interpret|interpretation)\b|说明|解释|含义|结果|权衡"
ERROR = r"(?i)\b(?:error|exception|traceback|stack trace|failed|failure|timeout|404|500|importerror|keyerror|valueerror)\b"
REGULATION = r"(?i)目的|宗旨|适用于|适用范围|英文名称|英文名|主要用于|用于检测|确定什么|承载力指标|不应低于|应满足什么要求|多少天|表\s*\d+(?:\.\d+)+|(?:\d+\.){1,3}\d+条?"
CODE = r"[/\\]|::|->|[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z0-9_.]+|[A-Za-z_][A-Za-z0-9_]*\(|[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+"
KEYWORD = r"(?i)表\s*\d+(?:\.\d+)+|(?:\d+\.){1,3}\d+条?|低应变法|高应变法|声波透射法|本规范|适用于|目的|英文名称|休止时间|承载力|桩身完整性|混凝土强度|设计强度|砂土|MPa|天"
STOP_WORDS = """a an the is are was were be to of for and or in on at by how what why when where which does do did can could should would
please explain meaning tradeoff result results interpret interpretation 请 帮 一下 怎么 如何 什么 哪个 哪些 以及 或者 还有 和 的 与 及""".split()
SECTION_STOP_WORDS = [*STOP_WORDS, *"说明 解释 含义 结果 权衡 图 表 公式 页 节 第".split()]
KEYWORD_STOP_WORDS = [*STOP_WORDS, *"比较 说明 解释 含义 结果 权衡".split()]
BROAD = r"(?i)总结|比较|区别|原理|设计|概览|overview|compare|difference|design|architecture|workflow|summary"
FOLLOW_UP = r"(?i)\b(?:it|this|that|these|those|they|them|he|she|there)\b|这个|那个|这些|那些|上面|前面|刚才"
LITERAL_SHARE = 0.34
SHORT_QUERY = 5


def _upper_inside(x: Column) -> Column:
    return x.rlike(r"^.+\p{Lu}") & x.rlike(r"\p{Ll}")


def _words(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(WORD), F.lit(0))


def analyze(queries: DataFrame) -> DataFrame:
    """queries: query_id, query -> normalized, tokens, token_count, literal_ratio and the signals."""
    q = F.col("normalized")
    literal = F.size(F.filter(_words(q), lambda x: x.rlike(r"[/\\._]|\p{Nd}") | _upper_inside(x)))
    camel = F.size(F.filter(_words(q), _upper_inside))
    rows = queries.withColumn("normalized", normalize("query")).withColumn("tokens", search_tokens("normalized"))
    rows = rows.withColumn("token_count", F.size("tokens"))
    return rows.withColumns({
        "literal_ratio": F.when(F.col("token_count") > 0, literal / F.col("token_count")).otherwise(0.0),
        "has_structure": q.rlike(STRUCTURE), "has_explain": q.rlike(EXPLAIN), "has_error": q.rlike(ERROR),
        "has_code": q.rlike(CODE) | (camel >= 2), "has_regulation": q.rlike(REGULATION), "has_broad": q.rlike(BROAD),
        "is_short": F.col("token_count") <= SHORT_QUERY, "is_follow_up": q.rlike(FOLLOW_UP) & (F.col("token_count") <= max(6, SHORT_QUERY + 1)),
    })


def route(analyzed: DataFrame) -> DataFrame:
    """route: regulation before explained_structure, structure, precision and general."""
    precise = F.col("has_error") | F.col("has_code") | (F.col("literal_ratio") >= LITERAL_SHARE)
    r = F.when(F.col("has_regulation"), "regulation").when(F.col("has_structure") & F.col("has_explain"), "explained_structure").when(F.col("has_structure"), "structure").when(precise, "precision")
    return analyzed.withColumn("route", r.otherwise("general"))


def plan(routed: DataFrame, k: int = 4, dense: int = 30, lexical: int = 30, fusion: int = 20) -> DataFrame:
    """Budgets of each route: dense_k, lexical_k, fusion_k, rerank_k, max_variants, targets, soft_targets, retry."""
    general, precise, law = F.col("route") == "general", F.col("route") == "precision", F.col("route") == "regulation"
    explained, structure = F.col("route") == "explained_structure", F.col("route") == "structure"
    lit = lambda n: F.lit(int(n))
    names = lambda s: F.array(*map(F.lit, s.split()))
    none = F.array().cast("array<string>")
    return routed.withColumns({
        "dense_k": F.when(general, lit(max(dense, 4 * k))).otherwise(lit(max(2 * k, min(dense, max(2 * k, 8))))),
        "lexical_k": F.when(general, lit(max(lexical, 4 * k))).when(precise, lit(max(3 * k, min(lexical, max(3 * k, 10))))).otherwise(lit(max(4 * k, min(lexical, max(4 * k, 12))))),
        "fusion_k": F.when(general, lit(max(fusion, 4 * k))).otherwise(lit(2 * k)),
        "rerank_k": F.when(general, lit(max(fusion, 4 * k))).otherwise(lit(4 * k)),
        "max_variants": F.when(explained, lit(3)).when(structure | law, lit(2)).otherwise(lit(1)),
        "targets": F.when(explained, names("table image formula caption paragraph")).when(structure, names("table image formula caption section_header")).otherwise(none),
        "soft_targets": F.when(explained, names("section_header")).when(structure, names("paragraph")).otherwise(none),
        "retry": F.when(precise, "none").otherwise("widen_then_keyword"),
        "section_terms": F.slice(F.filter(F.array_distinct(F.transform("tokens", F.lower)), lambda x: ~x.isin(SECTION_STOP_WORDS) & (F.length(x) > 1)), 1, 4),
    })


def keyword_text(c="normalized") -> Column:
    """Anchors and domain terms of a regulation query, else the words that aren't stop-words, else all words."""
    q = col(c)
    clause, table = F.regexp_extract(q, CLAUSE, 1), F.regexp_extract(q, TABLE, 1)
    terms = F.array_distinct(F.filter(F.concat(F.array(clause, table, F.when(table != "", F.concat(F.lit("表"), table)).otherwise("")), F.transform(F.regexp_extract_all(q, F.lit(KEYWORD), F.lit(0)), lambda s: F.trim(s))), lambda x: x != ""))
    words = _words(q)
    kept = F.filter(words, lambda x: ~F.lower(x).isin(KEYWORD_STOP_WORDS))
    free = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")
    return F.when(F.col("token_count") == 0, F.lit("")).when(F.col("has_regulation") & (F.size(terms) > 0), F.array_join(terms, " ")).otherwise(free)


def expand(planned: DataFrame) -> DataFrame:
    """query_id, variant_id, variant, weight: the original, keywords, and for explained structures a clarified text."""
    rows = planned.withColumn("kw", keyword_text())
    q, other = F.col("normalized"), (F.col("kw") != "") & (F.lower("kw") != F.lower("normalized"))
    clarified = F.when(other, F.concat(q, F.lit(" "), F.col("kw"))).otherwise(q)
    variant = lambda name, text, w: F.struct(F.lit(name).alias("variant_id"), text.alias("variant"), F.lit(w).alias("weight"))
    several = F.col("max_variants") > 1
    found = F.array(variant("original", q, 1.0), F.when(several & other, variant("keyword_focused", F.col("kw"), 0.92)), F.when(several & (F.col("route") == "explained_structure") & ~F.lower(clarified).isin(F.lower(q), F.lower("kw")), variant("clarified", clarified, 0.85)))
    found = F.filter(found, lambda x: x.isNotNull())
    return rows.select("query_id", F.explode(F.slice(found, 1, F.col("max_variants"))).alias("v")).select("query_id", "v.*")


def retry_variant(planned: DataFrame) -> DataFrame:
    rows = planned.withColumn("kw", keyword_text()).where((F.col("kw") != "") & (F.lower("kw") != F.lower("normalized")))
    return rows.select("query_id", F.lit("retry_keyword").alias("variant_id"), F.col("kw").alias("variant"), F.lit(0.84).alias("weight"))


def sufficiency(ranked: DataFrame, k: int = 4) -> DataFrame:
    """ranked: query_id, route, score, rank, is_target, is_context -> reason, sufficient, for each query."""
    top = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    found = ranked.groupBy("query_id", "route").agg(F.count("*").alias("n"), F.sum(F.col("is_target").cast("int")).alias("n_target"), F.sum(F.col("is_context").cast("int")).alias("n_context"), top(1).alias("s1"), top(2).alias("s2"))
    aimed = F.col("route").isin("structure", "explained_structure")
    reason = (
        F.when(F.col("n") < max(1, -(-3 * k // 4)), "insufficient_count")
        .when(aimed & (F.col("n_target") == 0), "no_target_block_hit")
        .when((F.col("route") == "explained_structure") & (F.col("n_context") == 0), "missing_explanatory_context")
        .when((F.col("s1") < 0.05) & (F.coalesce("s2", F.lit(0.0)) < 0.04), "low_rerank_confidence")
        .otherwise("sufficient")
    )
    return found.select("query_id", "route", "n", reason.alias("reason"), (reason == "sufficient").alias("sufficient"))


def widen(planned: DataFrame) -> DataFrame:
    """Budgets of a retry: half as many again, fusion at least the larger."""
    more = lambda c: F.greatest(F.col(c) + 1, F.ceil(F.col(c) * 1.5).cast("int"))
    return planned.withColumns({"retry_dense_k": more("dense_k"), "retry_lexical_k": more("lexical_k")}).withColumn("retry_fusion_k", F.greatest("fusion_k", "retry_dense_k", "retry_lexical_k"))

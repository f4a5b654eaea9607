"""Literal cases of the text functions and the planner."""

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import planner


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_tokens_of_ideographs_and_clauses(spark):
    assert one(spark, "见表 3.2.1 第2.1.8条 Cross-Hole", tx.search_tokens("t"))[:4] == ["3.2.1", "3.2.1", "表3.2.1", "见表"][:1] + ["表3.2.1", "见表", "第"]
    assert one(spark, "混凝土强度等级", tx.search_tokens("t"))[:3] == ["混凝", "凝土", "土强"]
    assert one(spark, None, tx.search_tokens("t")) == []


def test_anchors(spark):
    a = one(spark, "2.1.8 声波透射法 cross-hole sonic logging 不应低于 70% 和 15MPa", tx.anchors("t"))
    assert (a.clause_id, a.english_alias, a.is_normative, a.numeric_terms) == ("2.1.8", "cross-hole sonic logging", True, ["70%", "15MPa"])


def test_snippet_and_slices(spark):
    assert one(spark, "a" * 200, tx.snippet("t")) == "a" * 177 + "..."
    assert [len(x) for x in one(spark, "b" * 250, tx.slices("t"))] == [120, 120, 10]
    assert one(spark, "", tx.slices("t")) == []


@pytest.mark.parametrize(
    ("query", "route", "variants"),
    [
        ("StreamingResponse class path backend/src/api/main.py", "precision", ["original"]),
        ("Figure 2 on page 12", "structure", ["original", "keyword_focused"]),
        ("Explain Figure 2 latency tradeoff", "explained_structure", ["original", "keyword_focused", "clarified"]),
        ("How does FastAPI stream answers", "general", ["original"]),
        ("本规范适用于哪些内容的检测与评价？", "regulation", ["original", "keyword_focused"]),
    ],
)
def test_routes(spark, query, route, variants):
    planned = planner.plan(planner.route(planner.analyze(spark.createDataFrame([(1, query)], "query_id long, query string"))))
    assert planned.first().route == route
    assert [r.variant_id for r in planner.expand(planned).orderBy(F.desc("weight")).collect()] == variants


def test_citations(spark):
    assert one(spark, "See [1] and [9]  now.", tx.sanitize_citations("t", F.lit(2))) == "See [1] and now."
    assert one(spark, "It grew 5%\nPlain words", tx.repaired("t")) == "It grew 5% [1] Plain words"

"""Offline evaluation of answers and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import CITATION, col, match_text


def cited(answer) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(col(answer), F.lit(CITATION), F.lit(1)), lambda x: x.cast("bigint"))))


def citation_correctness(answer, n_citations) -> Column:
    """1 where every citation of the answer exists, else 0."""
    return F.when(F.exists(cited(answer), lambda x: (x < 1) | (x > col(n_citations))), 0.0).otherwise(1.0)


def snippet_hits(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """samples: query_id, expected; hits: query_id, content -> whether some hit holds the expected words."""
    held = F.contains(match_text("content"), match_text("expected"))
    found = samples.join(hits, "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(held), F.lit(False)).alias("snippet_hit"))
    return found


def safe_mean(c, when: Column | None = None) -> Column:
    x = col(c) if when is None else F.when(when, col(c))
    return F.coalesce(F.avg(x), F.lit(0.0))

"""Metadata filters compiled to a predicate; nothing here is a UDF."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class MetadataFilter:
    """Every given part must hold; an empty list is no condition."""

    doc_ids: list = field(default_factory=list)
    source_names: list = field(default_factory=list)
    doc_types: list = field(default_factory=list)
    pages: list = field(default_factory=list)
    section_path_prefix: list = field(default_factory=list)
    title_contains: str | None = None
    updated_after: datetime | None = None
    updated_before: datetime | None = None

    def predicate(self, columns: list[str]) -> Column:
        """Over the columns a table has: a condition on a column it lacks never holds.

        Rows scoped to a session pass only if their doc_id is listed.  Bounds of time are inclusive and fail on null.
        """
        has = lambda *names: [F.col(n) for n in names if n in columns]
        any_of = lambda cols, values: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(c.isin(values), F.lit(False)) for c in cols], F.lit(False)), F.lit(False))
        parts: list[Column] = []
        if "scope" in columns:
            parts.append((F.coalesce(F.col("scope"), F.lit("global")) != "session") | any_of(has("doc_id"), self.doc_ids))
        for values, names in ((self.doc_ids, ("doc_id",)), (self.source_names, ("source_name", "source_uri_or_path")), (self.doc_types, ("doc_type",)), (self.pages, ("page", "page_or_section"))):
            if values:
                parts.append(any_of(has(*names), values))
        if p := self.section_path_prefix:
            parts.append(F.coalesce(F.slice("section_path", 1, len(p)) == F.array(*map(F.lit, p)), F.lit(False)) if "section_path" in columns else F.lit(False))
        if self.title_contains:
            shown = [F.nullif(c, F.lit("")) for c in has("title", "source_name")]
            parts.append(F.contains(F.lower(F.coalesce(*shown, F.lit(""))), F.lit(self.title_contains.lower())))
        for bound, test in ((self.updated_after, lambda c, v: c >= v), (self.updated_before, lambda c, v: c <= v)):
            if bound is not None:
                parts.append(F.coalesce(test(F.col("updated_at"), F.lit(bound)), F.lit(False)) if "updated_at" in columns else F.lit(False))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def session_scope(wanted: list | None, session_docs: list, has_files: bool) -> list | None:
    """Documents to search in a session: None is no limit, an empty list matches nothing."""
    if not has_files:
        return wanted
    return [d for d in wanted if d in set(session_docs)] if wanted else list(session_docs)


def hard_target(hits: DataFrame, hit: Column, least: int = 2) -> DataFrame:
    """Only targets where a query has enough of them, else all its hits; targeting tells which."""
    n = F.sum(hit.cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumns({"is_target": hit, "n_target": n}).withColumn("targeting", F.when(F.col("n_target") >= least, "hard").otherwise("soft_fallback")).where((F.col("targeting") == "soft_fallback") | F.col("is_target")).drop("n_target")

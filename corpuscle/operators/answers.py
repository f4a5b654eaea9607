"""Answers taken from retrieved texts by rule, the citation a text answers with, and the answer that is given where nothing fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import CLAUSE, NORMATIVE, TABLE, let, normalize

# What anchors look like, what a question asks for, and what answers it.
ALIAS = r"[一-鿿]+\s+([A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*)+)"
NUMBER = r"(?i)[0-9]+(?:\.[0-9]+)?(?:%|MPa|天)"
PSEUDO_ROW = r"^(?:表\s*[0-9]+(?:\.[0-9]+)+\s+)?([一-鿿A-Za-z]+)\s+([0-9]+(?:\.[0-9]+)?)$"
ASKS_NAME, ASKS_DAYS = r"(?i)英文名称|英文名|english", "多少天|几天"
SUBJECT, OTHER_SUBJECT, NO_SUBJECT = r"([一-鿿A-Za-z0-9-]+?)的英文名称", r"[0-9.]+\s*([一-鿿A-Za-z0-9-]+)\s+[A-Za-z]", "该术语"
PATTERNS = (
    ("目的|宗旨", ("为了[^。；]*制定本规范",)),
    ("适用", ("本规范适用于[^。；]*",)),
    ("主要用于|用于检测", ("检测[^。；]*判定[^。；]*", "主要用于[^。；]*")),
    ("承载力指标|确定什么", ("确定[^。；]*极限承载力[^。；]*", "极限承载力[^。；]*")),
    ("不应低于|应满足什么要求|满足什么要求", ("不应低于[^。；]*",)),
)
#: Documents whose texts are looked at.
FIRST = 2


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def text_anchors(value) -> Column:
    """All ten anchors of a text: ids, alias, terms with numbers, key and value of its first line that is a table's row, and the list of all terms."""
    raw = F.col(value) if isinstance(value, str) else value
    lines = F.filter(F.transform(F.split(raw, r"\r\n|\r|\n"), lambda x: normalize(x)), lambda x: x.rlike(PSEUDO_ROW))

    def anchors(s: Column) -> Column:
        text, row = s["text"], s["row"]
        key, number = _found(row, PSEUDO_ROW, 1), _found(row, PSEUDO_ROW, 2)
        clause, table, alias = _found(text, CLAUSE, 1), _found(text, TABLE, 1), _found(text, ALIAS, 1)
        terms = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.array_compact(F.array(number))))
        normative = text.rlike(NORMATIVE)
        return let(terms, lambda n: F.struct(
            clause.alias("clause_id"), table.alias("table_id"), alias.alias("english_alias"), normative.alias("is_normative"), (F.size(n) > 0).alias("has_numeric"), n.alias("numeric_terms"), key.alias("row_key"), number.alias("row_value"),
            (F.coalesce(clause, table, alias).isNotNull() | (F.size(n) > 0) | normative).alias("is_anchor"), F.concat(F.array_compact(F.array(clause, table, alias, key)), n).alias("terms"),
        ))

    return let(F.struct(normalize(F.coalesce(raw, F.lit(""))).alias("text"), F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("row")), anchors)


def citation_of(document: Column, citations: Column) -> Column:
    """The index of the first citation of the document's id and page - a page that either hasn't got fits - else of the first citation."""
    page = lambda x: F.coalesce(x["page"], F.lit(""))
    same = F.filter(citations, lambda c: (F.coalesce(document["doc_id"], F.lit("")) != "") & (c["doc_id"] == document["doc_id"]) & ((page(document) == "") | (page(c) == "") | (page(c) == page(document))))
    return F.coalesce(F.get(same, F.lit(0))["index"], F.get(citations, F.lit(0))["index"])


def _one(question: Column, document: Column, citations: Column) -> Column:
    """What one document answers, or null."""
    text, a = normalize(F.coalesce(document["text"], F.lit(""))), text_anchors(document["text"])

    def answer(s: Column) -> Column:
        a, mark = s["a"], F.concat(F.lit(" ["), s["index"].cast("string"), F.lit("]。"))
        subject = F.coalesce(_found(question, SUBJECT, 1), _found(s["text"], OTHER_SUBJECT, 1), F.lit(NO_SUBJECT))
        name = F.when(question.rlike(ASKS_NAME) & a["english_alias"].isNotNull(), F.concat(subject, F.lit("的英文名称是 "), a["english_alias"], mark))
        days = F.when(question.rlike(ASKS_DAYS) & a["row_key"].isNotNull() & F.contains(question, a["row_key"]), F.concat(a["row_key"], F.lit("的休止时间是 "), a["row_value"], F.lit(" 天"), mark))
        said = F.lit(None).cast("string")
        for asked, patterns in reversed(PATTERNS):
            said = F.when(question.rlike(asked), F.coalesce(*(_found(s["text"], p, 0) for p in patterns))).otherwise(said)
        return F.when(s["index"].isNotNull(), F.coalesce(name, days, F.concat(F.regexp_replace(said, "[。；;]+$", ""), mark)))

    return let(F.struct(text.alias("text"), a.alias("a"), citation_of(document, citations).alias("index")), answer)


def extract_answer(rows: DataFrame) -> DataFrame:
    """rows with `extracted`: what the first of the first two documents that answers says, or null.

    rows: question; documents: an array of doc_id, page, text in the order of their ranks; citations: index, doc_id, page.
    """
    question = normalize(F.coalesce("question", F.lit("")))
    found = let(question, lambda q: F.filter(F.transform(F.slice("documents", 1, FIRST), lambda d: _one(q, d, F.col("citations"))), lambda x: x.isNotNull()))
    some = (F.size("documents") > 0) & (F.size("citations") > 0)
    return rows.withColumn("extracted", F.when(some, F.get(found, F.lit(0))))

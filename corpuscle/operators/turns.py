"""Turns of a conversation: citations of what was found, the prompt, the way from a drafted answer to the one that is given, and what is kept of it.

A drafted answer is a column: whatever wrote it, all that comes before and after is done here, for any number of turns at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import CITATION, col, let, repaired, sanitize_citations, snippet, uncited

from .answers import extract_answer
from .evaluate import cited

# What is said where nothing supports an answer, and the frame of a prompt.
NO_SOURCES = "无可用来源"
WEAK = "基于当前检索结果，我只能给出保守结论：该问题在现有证据下无法稳定确认完整细节。建议优先参考以下来源再确认："
REJECTED = "我无法从当前检索上下文中稳定支撑这个问题的回答。可参考来源："
NO_CONTEXT = "我无法从已索引文档中找到足够可靠的上下文来回答这个问题。"
NO_HISTORY, TURNS = "无", 4
ASKED, TALKED, FOUND = "当前问题：", "最近对话：\n", "检索上下文：\n"
RULE = "请严格依据检索上下文回答。先给结论，再给简短依据。事实性断言请使用引用编号，引用只能使用上下文中已有编号。"


def source_key() -> Column:
    """What makes two hits one source: where it is from (or its name, or its document), its page, its section path."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return F.struct(F.coalesce(filled("source_uri"), filled("source_name"), filled("doc_id"), F.lit("")).alias("source"), F.coalesce(filled("page"), filled("page_or_section")).alias("page"), F.coalesce("section_path", F.array().cast("array<string>")).alias("path"))


def build_citations(hits: DataFrame) -> DataFrame:
    """query_id, index, doc_id, source_name, source_uri, page, title, section_path, snippet: the first hit of each source, numbered from 1.

    hits: query_id, rank, doc_id, source_uri, source_name, page, page_or_section, section_path, title, content.
    """
    own = Window.partitionBy("query_id", "key").orderBy("rank")
    first = hits.withColumn("key", source_key()).withColumn("n", F.row_number().over(own)).where("n = 1")
    index = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return first.select("query_id", index.alias("index"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.nullif("source_name", F.lit("")), F.lit("unknown")).alias("source_name"), "source_uri", F.col("key.page").alias("page"), F.nullif("title", F.lit("")).alias("title"), "section_path", snippet("content").alias("snippet"))


def citation_report(rows: DataFrame) -> DataFrame:
    """rows with `report`: score, invalid_indices, citation_count, mentioned_citation_count, unmapped_doc_ids.

    rows: answer, citation_docs (doc ids of its citations, in order), found_docs (doc ids that were retrieved).
    """
    n = F.size("citation_docs")
    wrong = F.filter(cited("answer"), lambda x: (x < 1) | (x > n))
    lost = F.array_sort(F.array_except(F.filter("citation_docs", lambda d: F.coalesce(d, F.lit("")) != ""), "found_docs"))
    score = F.when((F.size(wrong) == 0) & (F.size(lost) == 0), 1.0).otherwise(0.0)
    return rows.withColumn("report", F.struct(score.alias("score"), wrong.alias("invalid_indices"), n.alias("citation_count"), F.regexp_count("answer", F.lit(CITATION)).alias("mentioned_citation_count"), lost.alias("unmapped_doc_ids")))


def context_blocks(documents) -> Column:
    """The prompt's block of each document: structs of index, source_name, title, section, page, doc_type, content."""
    said = lambda d, name: F.concat(F.lit(f"; {name}="), F.coalesce(d[name], F.lit("")))
    return F.transform(documents, lambda d: F.concat(F.lit("["), d["index"].cast("string"), F.lit("] source="), F.coalesce(d["source_name"], F.lit("")), said(d, "title"), said(d, "section"), said(d, "page"), said(d, "doc_type"), F.lit("\n"), F.coalesce(d["content"], F.lit(""))))


def answer_prompt(question, history, blocks) -> Column:
    """The prompt of a question, its last turns (structs of role, content) and its context blocks."""
    last = F.slice(history, F.greatest(F.size(history) - (TURNS - 1), F.lit(1)), F.lit(TURNS))
    talked = F.array_join(F.transform(last, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.concat(F.lit(ASKED), col(question), F.lit("\n\n" + TALKED), F.when(F.size(history) > 0, talked).otherwise(NO_HISTORY), F.lit("\n\n" + FOUND), F.array_join(blocks, "\n\n"), F.lit("\n\n" + RULE))


def fallback_answer(citations: Column, weak: Column) -> Column:
    """text, status, reason of an answer that nothing supports; citations: structs with index, source_name."""
    names = F.array_join(F.transform(citations, lambda c: F.concat(F.lit("["), c["index"].cast("string"), F.lit("] "), c["source_name"])), ", ")
    listed = F.when(F.size(citations) > 0, names).otherwise(NO_SOURCES)
    text = F.concat(F.when(weak, WEAK).otherwise(REJECTED), listed, F.lit("。"))
    return F.struct(text.alias("text"), F.when(weak, "weak_hit").otherwise("rejected").alias("status"), F.when(weak, "weak_evidence").otherwise("unsupported").alias("reason"))


def valid(answer: Column, n: Column) -> Column:
    """No citation beyond those there are, and no assertion without one."""
    return ~F.exists(cited(answer), lambda x: (x < 1) | (x > n)) & (F.size(uncited(answer)) == 0)


def answer_turns(rows: DataFrame) -> DataFrame:
    """rows with answer, grounded, status, reason, used_citations.

    rows: question, documents, citations as for `extract_answer` (citations with source_name as well), drafted.  In turn: what
    can be extracted is the answer; without documents there is none; a draft loses citations of nothing; if it still asserts
    something uncited it is mended once, and if that doesn't help, or nothing is left of it to cite, it is given up.
    """
    n = F.size("citations")

    def judged(draft: Column) -> Column:
        mended = F.when(n > 0, repaired(draft)).otherwise(draft)
        weak = n > 0

        def choose(m: Column) -> Column:
            back = fallback_answer(F.col("citations"), weak)
            fine, better = valid(draft, n), valid(m, n)
            return F.struct(
                F.when(fine, draft).when(better, m).otherwise(back["text"]).alias("answer"), (fine | better).alias("grounded"), F.when(fine | better, "ok").otherwise(back["status"]).alias("status"), F.when(fine | better, "normal").otherwise(back["reason"]).alias("reason")
            )

        return let(mended, choose)

    written = let(sanitize_citations(F.coalesce("drafted", F.lit("")), n), judged)
    given = lambda text, grounded, status, reason: F.struct(text.alias("answer"), F.lit(grounded).alias("grounded"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    found = extract_answer(rows)
    told = F.when(F.col("extracted").isNotNull(), given(F.col("extracted"), True, "ok", "normal")).when(F.size("documents") == 0, given(F.lit(NO_CONTEXT), False, "rejected", "no_context")).otherwise(written)
    used = F.when((F.size("documents") == 0) & F.col("extracted").isNull(), F.slice("citations", 1, F.lit(0))).otherwise(F.col("citations"))
    return found.withColumn("_told", told).select("*", "_told.*", used.alias("used_citations")).drop("_told", "extracted")


def persisted(turns: DataFrame) -> DataFrame:
    """The two messages of each turn: session_id, turn, seq, role, content, grounded, n_citations, status; seq counts a session's messages on from `held` (0)."""
    user = F.struct(F.lit(0).alias("at"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("boolean").alias("grounded"), F.lit(None).cast("int").alias("n_citations"), F.lit(None).cast("string").alias("status"))
    bot = F.struct(F.lit(1).alias("at"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("grounded"), F.size("used_citations").alias("n_citations"), F.col("status"))
    rows = turns.select("session_id", "turn", F.explode(F.array(user, bot)).alias("m"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "m.at"))
    return rows.select("session_id", "turn", seq.alias("seq"), "m.role", "m.content", "m.grounded", "m.n_citations", "m.status")


def anchor_hits(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, anchor_hit: whether some hit has an anchor; hits: query_id, anchors as `text_anchors` gives them."""
    a = F.col("anchors")
    held = a["is_anchor"] | F.coalesce(a["clause_id"], a["table_id"], a["english_alias"]).isNotNull() | a["has_numeric"]
    return samples.select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(held), F.lit(False)).alias("anchor_hit"))


def dataset_rows(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, question, answer, contexts in the order of ranks, ground_truth: the reference answer, or else the expected snippet."""
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    truth = F.coalesce(F.nullif("reference_answer", F.lit("")), "expected")
    return samples.join(found, "query_id", "left").select("query_id", "question", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), truth.alias("ground_truth"))


def evaluation(rows: DataFrame) -> DataFrame:
    """One row of counts and means over samples: status, score, snippet_hit, anchor_hit; a mean over none is 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    fine = F.col("status") == "ok"
    return rows.agg(
        F.count("*").alias("sample_count"), F.count_if(fine).alias("ok_count"), F.count_if(~fine).alias("fallback_count"), F.round(mean("score"), 9).alias("citation_correctness_avg_all"), F.round(mean(F.when(fine, F.col("score"))), 9).alias("citation_correctness_avg_ok"),
        F.round(mean(F.col("snippet_hit").cast("double")), 9).alias("expected_snippet_hit_rate"), F.round(mean(F.col("anchor_hit").cast("double")), 9).alias("anchor_hit_rate"),
    )


def ensure_sessions(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Sessions (session_id, title, created_at, updated_at) after those of `asked` (session_id, at) were seen: new ones without a title, known ones touched; a null id gets one of its own."""
    named = asked.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    seen = named.groupBy("session_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    rows = sessions.join(seen, "session_id", "full")
    return rows.select("session_id", "title", F.coalesce("created_at", "first_at").alias("created_at"), F.greatest("updated_at", "last_at").alias("updated_at"))


def rename_sessions(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """Sessions with the titles of names (session_id, new_title, at, one row each); unknown ones change nothing."""
    return sessions.join(names, "session_id", "left").select("session_id", F.coalesce("new_title", "title").alias("title"), "created_at", F.greatest("updated_at", "at").alias("updated_at"))


def query_traces(messages: DataFrame, most: int | None = None) -> DataFrame:
    """Messages of assistants whose trace is a JSON object, the last `most` of each session with any trace."""
    rows = messages.where("role = 'assistant' and trace is not null and trace <> 'null'")
    if most is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("message_id").desc()))).where(F.col("n") <= most).drop("n")
    return rows.where(F.schema_of_variant(F.try_parse_json("trace")).startswith("OBJECT"))


def candidate_summary(candidates: DataFrame, most: int = 10) -> DataFrame:
    """query_id, candidates: the first ones as structs of rank, chunk_id, doc_id, block_type, score, sources, variants, matched_query_count.

    candidates: query_id, rank, chunk_id, doc_id, block_type, rerank_score, query_fusion_score, fusion_score, dense_rank,
    lexical_rank, variants (ids of the variants that found it).
    """
    score = F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.nullif("query_fusion_score", F.lit(0.0)), "fusion_score")
    sources = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("lexical_rank").isNotNull(), "lexical")))
    one = F.struct("rank", "chunk_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("block_type", F.lit("paragraph")).alias("block_type"), score.alias("score"), sources.alias("sources"), "variants", F.size("variants").alias("matched_query_count"))
    return candidates.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))

"""Citations, flow, sessions and traces on literal cases."""

from corpuscle.operators import turns


def test_citations(spark):
    rows = [
        (1, 1, "d1", "/a", "a", "2", None, ["S"], "T", "first text"), (1, 2, "d1", "/a", "a", "2", None, ["S"], "T", "same source"), (1, 3, "d1", "/a", "a", "3", None, ["S"], "", "other page"), (1, 4, "d2", "", "a", None, "7", None, None, "by name"),
        (1, 5, "d2", None, "a", "7", None, [], None, "same by name"), (1, 6, "d3", None, None, None, None, None, None, "by id"), (2, 1, "d9", "/z", "z", None, None, None, None, "y" * 300),
    ]
    hits = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, source_uri string, source_name string, page string, page_or_section string, section_path array<string>, title string, content string")
    got = sorted((r.query_id, r["index"], r.doc_id, r.source_name, r.page, r.title, r.snippet[:10]) for r in turns.build_citations(hits).collect())
    assert got == [(1, 1, "d1", "a", "2", "T", "first text"), (1, 2, "d1", "a", "3", None, "other page"), (1, 3, "d2", "a", "7", None, "by name"), (1, 4, "d3", "unknown", None, None, "by id"), (2, 1, "d9", "z", None, None, "y" * 10)]


def test_report(spark):
    rows = [(1, "ok [1] [2]", ["a", "b"], ["a", "b", "c"]), (2, "bad [3] [0] [3]", ["a"], ["a"]), (3, "none", [], []), (4, "[1]", ["x", "", None], ["a"])]
    got = {r.i: tuple(r.report) for r in turns.citation_report(spark.createDataFrame(rows, "i int, answer string, citation_docs array<string>, found_docs array<string>")).collect()}
    assert got == {1: (1.0, [], 2, 2, []), 2: (0.0, [0, 3], 1, 3, []), 3: (1.0, [], 0, 0, []), 4: (0.0, [], 3, 1, ["x"])}


def test_flow(spark):
    doc, cite = "array<struct<doc_id:string,page:string,text:string>>", "array<struct<index:int,doc_id:string,page:string,source_name:string>>"
    d, c = [("d1", "", "本规范适用于桥。")], [(1, "d1", "", "one"), (2, "d2", "", "two")]
    rows = [
        (0, "适用什么", d, c, "ignored"), (1, "x", [], c, "draft"), (2, "x", d, c, "Fine words. See [1] [7]"), (3, "x", d, c, "It grew 5 times more"), (4, "x", d, [], "It grew 5 times more"), (5, "x", d, c, None), (6, "x", d, [], "plain words [2]"), (7, "x", d, c, "5 more!6 less [2]"),
    ]
    frame = spark.createDataFrame(rows, f"i int, question string, documents {doc}, citations {cite}, drafted string")
    got = {r.i: (r.answer, r.grounded, r.status, r.reason, len(r.used_citations)) for r in turns.answer_turns(frame).collect()}
    assert got == {
        0: ("本规范适用于桥 [1]。", True, "ok", "normal", 2), 1: (turns.NO_CONTEXT, False, "rejected", "no_context", 0), 2: ("Fine words. See [1]", True, "ok", "normal", 2), 3: ("It grew 5 times more [1]", True, "ok", "normal", 2),
        4: (turns.REJECTED + turns.NO_SOURCES + "。", False, "rejected", "unsupported", 0), 5: ("", True, "ok", "normal", 2), 6: ("plain words", True, "ok", "normal", 0), 7: ("5 more [1] 6 less [2]", True, "ok", "normal", 2),
    }


def test_sessions_and_traces(spark):
    held = spark.createDataFrame([("a", "A", 1, 2)], "session_id string, title string, created_at long, updated_at long")
    asked = spark.createDataFrame([("a", 9), ("a", 1), ("b", 4), (None, 5), ("", 6)], "session_id string, at long")
    got = turns.ensure_sessions(held, asked).collect()
    assert len(got) == 4 and {tuple(r) for r in got if r.session_id in "ab"} == {("a", "A", 1, 9), ("b", None, 4, 4)} and all(len(r.session_id) == 32 for r in got if r.session_id not in "ab")
    names = spark.createDataFrame([("a", "New", 20), ("zz", "No", 1)], "session_id string, new_title string, at long")
    assert {tuple(r) for r in turns.rename_sessions(held, names).collect()} == {("a", "New", 1, 20)}
    messages = spark.createDataFrame([(1, 1, "assistant", '{"a": 1}'), (1, 2, "user", '{"a": 2}'), (1, 3, "assistant", "null"), (1, 4, "assistant", "[1]"), (1, 5, "assistant", "{bad"), (1, 6, "assistant", None), (1, 7, "assistant", "{}")], "session_id int, message_id int, role string, trace string")
    ids = lambda df: sorted(r.message_id for r in df.collect())
    assert ids(turns.query_traces(messages)) == [1, 7] and ids(turns.query_traces(messages, 1)) == [7] and ids(turns.query_traces(messages, 3)) == [7]
    cand = spark.createDataFrame([(1, r, f"c{r}", None, None, 0.0 if r > 1 else 3.0, None, 0.5, 1 if r % 2 else None, r, ["original"]) for r in range(1, 13)], "query_id int, rank int, chunk_id string, doc_id string, block_type string, rerank_score double, query_fusion_score double, fusion_score double, dense_rank int, lexical_rank int, variants array<string>")
    one = turns.candidate_summary(cand).first().candidates
    assert len(one) == 10 and (one[0].score, one[0].sources, one[0].block_type, one[0].matched_query_count) == (3.0, ["dense", "lexical"], "paragraph", 1) and (one[1].score, one[1].sources) == (0.5, ["lexical"])

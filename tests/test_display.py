"""What is shown, written and rebuilt: titles, places, ids, traces, sinks, the manifest."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import display, index
from corpuscle.sources import sinks, store


def _values(spark, column, rows, schema):
    """The column over rows, in their order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_titles(spark):
    rows = [
        (" Given ", "# head", "a.md"), ("", "x\n  ## Head #1 \n# second", "a.md"), (None, "no mark", "dir.d/a.b.md"), (None, None, ".hidden"), (None, "a # b", "dir.d/plain"), (None, "x\r\n\t###\n# y", "a.md"),
        (None, "x # \u2028#deep", "a.md"), (None, "\n\n #\u00a0 wide\u3000", "a.md"), ("  ", "# h", "a.md"),
    ]
    got = _values(spark, display.document_title("g", "t", "n"), rows, "g string, t string, n string")
    assert got == ["Given", "Head #1", "a.b", ".hidden", "dir.d/plain", "", "deep", "wide", ""]


def test_pages_and_numbers(spark):
    rows = [("3", "4", "s", "9", 1), (None, "4", "s", None, 2), (None, None, "s", "9", 3), (None, None, None, "9", 4), (None, None, None, None, 5), ("", "1", None, None, 6), (" 7 ", None, None, None, 7), ("1.5", None, None, None, 8)]
    got = _values(spark, display.page_fields("a", "b", "c", "d", "n"), rows, "a string, b string, c string, d string, n int")
    assert [tuple(x) for x in got] == [("3", "3", 3), ("4", "4", 4), ("s", "s", 3), ("9", "9", 9), ("5", "5", 5), ("", "", 6), (" 7 ", " 7 ", 7), ("1.5", "1.5", 8)]
    assert _values(spark, display.whole("x", F.lit(-1)), [("5",), (None,), ("x",), ("99999999999",), ("-2",)], "x string") == [5, -1, -1, -1, -2]
    assert _values(spark, display.moment("x"), [("2024-05-06",), ("2024-05-06T07:08:09",), ("soon",), ("",), (None,)], "x string") == [datetime(2024, 5, 6), datetime(2024, 5, 6, 7, 8, 9), None, None, None]


def test_places_and_ids(spark):
    schema = "c string, o string, d string, s array<string>, p string, q string"
    rows = [("c1", "o", "d", ["A", " ", None, "B "], "3", "9"), ("", "o1", "d", [], "", "9"), ("  ", "o1", "d", ["A"], None, None), (None, None, None, None, None, None), (None, None, "", ["A", "B"], None, "q")]
    assert _values(spark, display.location("s", "p", "q"), rows, schema) == ["A > B  | p3", "9", "A", None, "A > B | pq"]
    assert _values(spark, display.chunk_key("c", "o", "d", "s", "p", "q", "hit"), rows, schema) == ["c1", "o1", "hit-d-na-A", "hit-hit-na-section", "hit-hit-q-A-B"]
    assert _values(spark, display.split_path("x"), [(" a/ b//c ",), ("",), (None,)], "x string") == [["a", "b", "c"], [], []]


def test_rules_and_loaders(spark):
    rows = [("txt", "two-\nparts"), ("json", '{"a": 1}'), ("json", "{"), ("pdf", "a-\nb"), ("markdown", None), ("csv", "a -\nb"), (None, "x")]
    plain = display.TEXT_RULES
    got = _values(spark, display.cleaning_rules("k", "t"), rows, "k string, t string")
    assert got == [[*plain, display.HYPHEN_RULE], [*plain, display.JSON_RULE], plain, display.PDF_RULES, plain, plain, plain]
    assert _values(spark, display.cleaning_rules("k", "t", F.lit(True)), [("pdf", "")], "k string, t string") == [[*display.PDF_RULES, display.OCR_RULE]]
    assert _values(spark, display.loader_name("k"), [("web",), ("other",), (None,)], "k string") == ["web_base_loader", None, None]


def test_normalized_documents(spark):
    blocks = spark.createDataFrame(
        [("d", "b1", "heading", 0, ["S", "T"], 2, "ii", "one", True), ("d", "b2", "paragraph", 1, [], None, "", "two", None), ("d", "b3", "paragraph", 2, ["U"], None, None, None, True), ("lost", "b4", "paragraph", 0, None, None, None, "x", False), ("e", "b5", "paragraph", 0, None, 7, None, "five", False)],
        "doc_id string, block_id string, block_type string, block_order int, section_path array<string>, page_number int, page_label string, text string, excluded boolean",
    )
    sources = spark.createDataFrame([("d", "markdown", "a.md", "/a.md", None, "# Top\nre-\nst"), ("e", "txt", "e", "/e", "E", None)], "doc_id string, source_type string, source_name string, source_uri string, title string, text string")
    got = {r.block_id: r for r in display.normalized_documents(blocks, sources).collect()}
    assert {k: (r.title, r.page, r.page_or_section, r.content) for k, r in got.items()} == {"b1": ("S", "2", "ii", "one"), "b2": ("Top", None, None, "two"), "b3": ("U", None, "U", None), "b5": ("E", "7", "7", "five")}
    assert got["b1"].loader == "unstructured_markdown_loader" and got["b1"].cleaning_rules[-1] == display.HYPHEN_RULE
    assert [tuple(r) for r in display.removed_blocks(blocks).collect()] == [("d", ["b1", "b3"])]
    assert display.normalized_documents(blocks.limit(0), sources).count() == 0


def test_merge_and_best(spark):
    left = spark.createDataFrame([("a", "", [], None, "l"), ("b", "x", ["1"], 5, "l"), ("c", None, None, None, "l"), (None, "", None, None, "l")], "k string, s string, l array<string>, n int, mine string")
    right = spark.createDataFrame([("a", "S", ["2"], 0, "r"), ("b", "S", ["2"], 0, "r")], "k string, s string, l array<string>, n int, `the.other` string")
    got = display.merge_filled(left, right, "k")
    assert got.columns == ["k", "s", "l", "n", "mine", "the.other"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("a", "S", ["2"], 0, "l", "r"), ("b", "x", ["1"], 5, "l", "r"), ("c", None, None, None, "l", None), (None, "", None, None, "l", None)], key=str)

    schema = "query_id int, rank int, score double, source_uri string, source_name string, doc_id string, page string, page_or_section string, section_path array<string>"
    hits = [(1, 1, 0.5, "u", "n", "d", "1", None, ["A"]), (1, 2, 0.9, "u", "m", "e", "", "1", ["A"]), (1, 3, 0.9, "u", "m", "f", "1", None, ["A"]), (1, 4, None, "u", "m", "g", "2", None, None), (2, 1, None, "", "", "h", None, None, None)]
    best = display.best_by_source(spark.createDataFrame(hits, schema))
    assert best.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((r.query_id, r.rank) for r in best.collect()) == [(1, 2), (1, 4), (2, 1)]


def test_output_context_and_trace(spark):
    schema = "chunk_id string, dense_rank int, lexical_rank int, fusion_score double, query_fusion_score double, rerank_score double, query_variant_ids array<string>"
    out = display.output_rows(spark.createDataFrame([("a", 1, None, 0.5, None, None, ["v1", "v2"]), ("b", None, 2, 0.25, 0.75, 0.0, None)], schema), "general")
    assert [(r.query_fusion_score, r.rerank_score, r.retrieval_sources, r.matched_query_count, r.route_name) for r in out.orderBy("chunk_id").collect()] == [(0.5, 0.5, ["dense"], 2, "general"), (0.75, 0.0, ["lexical"], 0, "general")]

    hits = spark.createDataFrame([(1, 7, None, "", None, "", None, "", "txt", "c"), (1, 2, "n", "T", ["A", ""], "3", "4", "doc", "txt", None)], "query_id int, rank int, source_name string, title string, section_path array<string>, page string, page_or_section string, doc_type string, source_type string, content string")
    assert [tuple(r)[1:] for r in display.context_rows(hits).orderBy("index").collect()] == [(1, "n", "T", "A", "3", "doc", None), (2, "unknown", "unknown", "unknown", "unknown", "txt", "c")]

    docs = [("1", "r2", ["dense"]), (None, "", None), ("3", "r1", []), ("4", "r2", None)]
    rows = [("s", "q", None, None, None, docs, [(1, "1", "n")], "x" * 300, "ok", "normal", True, [], 0), ("s", "q", "own", "weak", 9, [], [], None, "rejected", "no_context", None, None, None)]
    schema = "session_id string, retrieval_query string, route_name string, retry_reason string, result_count int, documents array<struct<doc_id:string,route_name:string,retrieval_sources:array<string>>>, citations array<struct<index:int,doc_id:string,source_name:string>>, answer string, status string, reason string, is_valid boolean, invalid_indices array<bigint>, n_uncited int"
    frame = spark.createDataFrame(rows, schema)
    first, second = (json.loads(r.t) for r in frame.select(F.to_json(display.debug_trace(), {"ignoreNullFields": "false"}).alias("t")).collect())
    assert first["request"] == {"session_id": "s", "retrieval_query": "q", "route_name": "r2", "retry_reason": "none"}
    assert first["retrieval"] == {"result_count": 4, "source_doc_ids": ["1", "", "3", "4"], "retrieval_sources": [["dense"], [], [], []]}
    assert first["generation"]["citation_indices_used"] == [1, 2, 3, 4] and first["generation"]["answer_text_len"] == 300 and first["generation"]["answer_preview"] == "x" * 240
    assert second["request"]["route_name"] == "own" and second["request"]["retry_reason"] == "weak" and second["retrieval"] == {"result_count": 9, "source_doc_ids": [], "retrieval_sources": []}
    assert second["generation"]["validation"] == {"is_valid": None, "invalid_citation_indices": [], "missing_citation_sentence_count": 0} and second["generation"]["citation_indices_used"] == []
    assert [r.r for r in frame.select(display.route_names("documents").alias("r")).collect()] == [["r2", "r1"], []]


def test_uploads(spark):
    names = ["C:\\dir\\a.txt", 'x/y<z>:"?*.md', " trailing. . ", "..", None, "dir/", "a\x01b", "ok"]
    assert _values(spark, display.upload_name("x"), [(n,) for n in names], "x string") == ["a.txt", "y_z_.md", "trailing", "upload", "upload", "upload", "a_b", "ok"]
    said = ["Loader broke", "can't DECODE the index", "faiss is gone", "disk full", None]
    assert _values(spark, display.upload_error("x"), [(n,) for n in said], "x string") == ["parse_failed", "parse_failed", "index_failed", "upload_processing_failed", "upload_processing_failed"]


def test_index_runs(spark):
    documents = spark.createDataFrame([("a", "active", "u", 1), ("b", "deleted", "u", 1), ("c", "active", None, 1)], "doc_id string, status string, source_uri string, updated_at int")
    chunks = spark.createDataFrame(
        [("a", "a1", "active", "t", '{"z": {"n": [1, null]}, "source_uri_or_path": "u", "b": 1.50}', 1), ("a", "a2", "deleted", "t", '{"b": 1}', 1), ("b", "b1", "active", "t", "{}", 1), ("c", "c1", "active", "t", None, 1), ("c", "c2", "active", None, "[", 1)],
        "doc_id string, chunk_id string, status string, retrieval_text string, metadata string, updated_at int",
    )
    got = {r.id: r for r in index.rebuilt(documents, chunks).collect()}
    assert set(got) == {"a1", "c1", "c2"} and json.loads(got["a1"].metadata)["doc_id"] == "a"
    moved = spark.createDataFrame([("a", 'n"ew', 5), ("b", "new", 5), ("x", "new", 5), ("c", "new", 6)], "doc_id string, new_uri string, at int")
    docs, rows = index.rewrite_uris(documents, chunks, moved)
    assert sorted(tuple(r) for r in docs.select("doc_id", "source_uri", "updated_at").collect()) == [("a", 'n"ew', 5), ("b", "u", 1), ("c", "new", 6)]
    told = {r.chunk_id: r for r in rows.collect()}
    assert list(json.loads(told["a1"].metadata).items()) == [("b", 1.5), ("source_uri_or_path", 'n"ew'), ("z", {"n": [1, None]})] and told["a1"].updated_at == 5
    assert (told["a2"].metadata, told["a2"].updated_at, told["b1"].metadata, told["b1"].updated_at) == ('{"b": 1}', 1, "{}", 1)
    assert json.loads(told["c1"].metadata) == json.loads(told["c2"].metadata) == {"source_uri_or_path": "new"}
    log = index.runs(chunks, documents.where("doc_id = 'a'"), F.lit("now"), 3)
    assert sorted(tuple(r) for r in log.collect()) == [("a", "update", 2, "completed", "now", 3), ("b", "append", 1, "completed", "now", 3), ("c", "append", 2, "completed", "now", 3)]


def test_stores_of_documents(spark, tmp_path):
    path = f"file://{tmp_path}/snapshots"
    docs = spark.createDataFrame([("a", 0, "x", None), ("a", 1, "y", 1.5), ("b", 0, "z", None)], "doc_id string, block_order int, text string, x0 double")
    sinks.write_snapshots(path, docs)
    sinks.write_snapshots(path, docs.where("doc_id = 'a' and block_order = 1"))
    rows = sorted((r.doc_id, r.block_order, json.loads(r.snapshot)["x0"]) for r in store.documents(spark, path, sinks.SNAPSHOT).collect())
    assert rows == [("a", 1, 1.5), ("b", 0, None)]

    path = f"file://{tmp_path}/parents"
    parents = spark.createDataFrame([("a", "p:1", "one"), ("a", "p2", "two"), ("b", "p1", "three")], "doc_id string, parent_chunk_id string, parent_content string")
    sinks.write_parents(path, parents)
    refs = spark.createDataFrame([(1, "a:p:1"), (2, "b:p1"), (3, "b:none"), (4, "nocolon"), (5, ":p1"), (6, None), (7, "a:")], "n int, parent_store_ref string")
    told = lambda: {r.n: r.record and json.loads(r.record)["parent_content"] for r in sinks.parents_by_ref(spark, path, refs).collect()}
    assert told() == {1: "one", 2: "three", 3: None, 4: None, 5: None, 6: None, 7: None}
    sinks.delete_parents(path, spark.createDataFrame([("a",), ("unknown",)], "doc_id string"))
    assert told() == {1: None, 2: "three", 3: None, 4: None, 5: None, 6: None, 7: None}


def test_messages_and_traces(spark, tmp_path):
    path = f"file://{tmp_path}/messages"
    schema = "message_id bigint, session_id string, role string, content string, grounded boolean, citations array<struct<index:int>>, retrieval_query string, metadata_filter map<string,string>, trace struct<n:int>, created_at timestamp, extra int"
    rows = [(1, "s", "user", "q", None, None, None, None, None, datetime(2024, 1, 1), 0), (2, "s", "assistant", "a", True, [(1,)], "q", {"k": "v"}, (5,), datetime(2024, 1, 2), 0)]
    sinks.append_messages(path, spark.createDataFrame(rows, schema))
    sinks.append_messages(path, spark.createDataFrame([(3, "t", "assistant", "b", False, [], "r", None, (6,), datetime(2024, 1, 3), 0)], schema))
    got = {r.message_id: (r.citations, r.metadata_filter, r.trace) for r in sinks.stored_messages(spark, path).collect()}
    assert got == {1: ("[]", "null", "null"), 2: ('[{"index":1}]', '{"k":"v"}', '{"n":5}'), 3: ("[]", "null", '{"n":6}')}
    held = sinks.stored_messages(spark, path)
    assert sorted(r.message_id for r in sinks.stored_messages(spark, path, ["t", "nobody"]).collect()) == [3]
    sessions = spark.createDataFrame([("s", "T", datetime(2023, 1, 1), datetime(2025, 1, 1)), ("t", None, None, None)], "session_id string, title string, created_at timestamp, updated_at timestamp")
    assert {r.session_id: r.updated_at for r in sinks.touched_sessions(sessions, held).collect()} == {"s": datetime(2025, 1, 1), "t": datetime(2024, 1, 3)}
    sinks.export_traces(f"file://{tmp_path}/traces", held.where("trace <> 'null'").select("session_id", "message_id", "trace"))
    assert sorted((r.session_id, r["count"], r.trace) for r in spark.read.json(f"file://{tmp_path}/traces").collect()) == [("s", 1, '{"n":5}'), ("t", 1, '{"n":6}')]
    sinks.write_report(f"file://{tmp_path}/report", spark.createDataFrame([(3, None)], "n int, rate double"), F.lit("2024"))
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/report").collect()] == ['{"n":3,"rate":null,"generated_at":"2024"}']


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/manifest"
    assert sinks.read_manifest(spark, path) is None
    with pytest.raises(ValueError):
        sinks.touch_manifest(spark, path, "t")
    with pytest.raises(ValueError):
        sinks.check_manifest(spark, path, 1, "m")
    assert sinks.append_manifest(spark, path, {"schema_version": 1, "embedding_model": "m", "embedding_dimension": 8, "created_at": "t0", "updated_at": "t0"}) == 1
    assert sinks.touch_manifest(spark, path, "t1") == 2
    held = sinks.read_manifest(spark, path)
    assert (held["version"], held["created_at"], held["updated_at"], held["embedding_dimension"], held["index_name"]) == (2, "t0", "t1", 8, None)
    sinks.check_manifest(spark, path, 1, "m")
    for version, model in ((2, "m"), (1, "other")):
        with pytest.raises(ValueError):
            sinks.check_manifest(spark, path, version, model)

"""Extracted answers, anchors and migration plans on literal cases."""

import re

from pyspark.sql import functions as F

from corpuscle.operators import answers, migration


def test_anchors(spark):
    texts = ["表 3.2.1 砂土\n砂土 14\n黏土  25", "第 5.1.2条 不应低于 20MPa 且 5% 5%", "混凝土 Concrete body-2 strength 说明", "", None, "plain words only", "A 1\n\nB 2.5", "1.2 x 表 4.4 y"]
    got = [r.a for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(answers.text_anchors("t").alias("a")).collect()]
    assert (got[0].clause_id, got[0].table_id, got[0].row_key, got[0].row_value) == ("3.2.1", "3.2.1", "砂土", "14") and got[0].terms == ["3.2.1", "3.2.1", "砂土", "14"]
    assert got[1].clause_id == "5.1.2" and got[1].numeric_terms == ["20MPa", "5%"] and got[1].is_normative and got[1].has_numeric and got[1].is_anchor
    assert got[2].english_alias == "Concrete body-2 strength" and got[2].is_anchor
    assert not got[3].is_anchor and not got[4].is_anchor and not got[5].is_anchor and got[4].terms == [] and got[5].row_key is None
    assert (got[6].row_key, got[6].row_value, got[6].numeric_terms) == ("A", "1", ["1"]) and got[7].table_id == "4.4"


def test_extract_answer(spark):
    doc, cite = "struct<doc_id:string,page:string,text:string>", "struct<index:int,doc_id:string,page:string>"
    schema = f"i int, question string, documents array<{doc}>, citations array<{cite}>"
    c = [(1, "d0", None), (2, "d1", "5"), (3, "d1", "6")]
    rows = [
        (0, "砂土 的休止时间是多少天", [("d1", "6", "砂土 14")], c), (1, "什么是英文名称", [("x", None, "2.1.3 混凝土 Concrete body")], c), (2, "钢筋的英文名称", [("d1", "", "钢 Steel bar")], c), (3, "适用范围", [("d0", "", "无"), ("d1", "9", "本规范适用于桥梁。其他")], c),
        (4, "适用范围", [("d0", "", "无"), ("d0", "", "无"), ("d1", "", "本规范适用于桥梁")], c), (5, "适用", [], c), (6, "适用", [("d1", "", "本规范适用于桥")], []), (7, None, [("d1", "", None)], c), (8, "目的 适用", [("d1", "", "本规范适用于桥")], c), (9, "用于检测", [("d1", "", "主要用于甲；")], c),
    ]
    got = {r.i: r.extracted for r in answers.extract_answer(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: "砂土的休止时间是 14 天 [3]。", 1: "混凝土的英文名称是 Concrete body [1]。", 2: "钢筋的英文名称是 Steel bar [2]。", 3: "本规范适用于桥梁 [1]。", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "主要用于甲 [2]。"}


def test_migration(spark):
    uploads = spark.createDataFrame([("/u/a.PDF", "h1", 1), ("/u/b.pdf", "h1", 1), ("/u/c", "h2", 2), ("/u/objects/h2", "h2", 2), ("/u/d.x.txt", "h3", 3), (None, "h", 1), ("/u/e.txt", None, 1)], "path string, content_hash string, size int")
    plan = migration.upload_plan(uploads, "/u")
    assert {(r.legacy_path, r.object_path, r.exists_already, r["first"]) for r in plan.collect()} == {
        ("/u/a.PDF", "/u/objects/h1.pdf", False, True), ("/u/b.pdf", "/u/objects/h1.pdf", False, False), ("/u/c", "/u/objects/h2", True, True), ("/u/d.x.txt", "/u/objects/h3.txt", False, True),
    }
    docs = spark.createDataFrame([("doc-1", "/u/a.PDF"), ("doc-2", "/u/b.pdf"), ("doc-3", "/u/c"), ("doc-4", "/v/none.txt"), ("doc-5", "/u/d.x.txt")], "doc_id string, source_uri string")
    held = spark.createDataFrame([("a", "1"), ("b", "2"), ("doc-2", "2"), ("c", "3"), ("doc-3", "9"), ("doc-4", "5"), ("lost", "0")], "n string, content_hash string").select(F.concat("n", F.lit(migration.SNAPSHOT)).alias("name"), "content_hash")
    snapshots = migration.snapshot_plan(docs, held)
    assert {(r.doc_id, r.action, r.conflict) for r in snapshots.collect()} == {("doc-1", "rename", False), ("doc-2", "delete_duplicate", False), ("doc-3", "conflict", True), ("doc-4", "noop", False), ("doc-5", "noop", False)}
    assert [r.name for r in migration.stale_snapshots(held, snapshots).collect()] == ["lost" + migration.SNAPSHOT]
    assert {(r.doc_id, r.object_path) for r in migration.rewrites(docs, plan).collect()} == {("doc-1", "/u/objects/h1.pdf"), ("doc-2", "/u/objects/h1.pdf"), ("doc-3", "/u/objects/h2"), ("doc-5", "/u/objects/h3.txt")}
    assert {r.legacy_path for r in migration.deletable_uploads(plan, docs).collect()} == {"/u/a.PDF", "/u/b.pdf", "/u/c", "/u/d.x.txt"}
    assert re.match("/u", plan.first().legacy_path) and migration.upload_plan(uploads.limit(0), "/u").count() == 0

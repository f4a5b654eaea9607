"""Blocks, chunks, filters and streams on literal cases."""

from datetime import datetime

from pyspark.sql import functions as F

from corpuscle.operators import assembly, blocks, catalog, chunking, graph
from corpuscle.operators.filters import MetadataFilter, session_scope
from corpuscle.streaming.ingest import ingest

TEXT = """# Guide
Intro text
goes on.

## Setup
- one
  more of one
- two
```
code # not a heading

x = 1
```
| a | b |
|---|---|
| 1 | 2 |
Figure 2: A picture
![alt](x.png)
$$ E = mc^2 $$
## Use
end"""


def test_blocks(spark):
    got = [tuple(r) for r in blocks.blocks(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")).orderBy("block_order").select("block_type", "text", F.array_join("section_path", "/")).collect()]
    kinds = [k for k, _, _ in got]
    assert kinds == ["section_header", "paragraph", "section_header", "list", "code", "table", "caption", "image", "formula", "section_header", "paragraph"]
    assert got[1][1] == "Intro text\ngoes on." and got[3] == ("list", "- one\n  more of one\n- two", "Guide/Setup")
    assert got[-1] == ("paragraph", "end", "Guide/Use") and got[4][1].count("\n") == 4


def test_table_and_packing(spark):
    row = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | |",)], "t string").select(blocks.linearize_table(F.col("t")).alias("x")).first().x
    assert row == "Table columns: a, b\nRow 1: a=1; b=2\nRow 2: a=3"
    table = "Table columns: name, value\n" + "\n".join(f"Row {i}: name=n{i}; value={i}" for i in range(1, 5))
    got = spark.createDataFrame([(table,)], "t string").select(chunking.table_chunks(F.col("t"), 16).alias("x")).first().x
    assert [(c["first"], c["last"]) for c in got] == [(1, 2), (3, 4)] and all(c["text"].startswith("Table columns: name, value\n") for c in got)
    code = spark.createDataFrame([("def a():\n  pass\ndef b():\n  pass",)], "t string").select(chunking.code_units(F.col("t")).alias("x")).first().x
    assert len(code) == 2


def test_word_windows(spark):
    got = chunking.word_windows(spark.createDataFrame([(1, " ".join(map(str, range(80)))), (2, "short"), (3, "")], "doc_id long, text string"), 24, 4).collect()
    assert len([r for r in got if r.doc_id == 1]) == 4 and all(len(r.text.split()) <= 24 for r in got) and {r.doc_id for r in got} == {1, 2}


def test_bounded_text(spark):
    x = spark.createDataFrame([(["a b c", "d " * 30, "e"], "child text")], "p array<string>, c string").select(chunking.bounded_text(F.col("p"), F.col("c"), 10).alias("x")).first().x
    assert x == "a b c\ne\nchild text"


def test_filters(spark):
    rows = spark.createDataFrame([("d1", "A.txt", "txt", ["x", "y"], datetime(2024, 1, 2), "global"), ("d2", "b.md", "markdown", ["x"], None, "session")], "doc_id string, source_name string, doc_type string, section_path array<string>, updated_at timestamp, scope string")
    ids = lambda **k: [r.doc_id for r in rows.where(MetadataFilter(**k).predicate(rows.columns)).collect()]
    assert ids() == ["d1"] and ids(doc_ids=["d2"]) == ["d2"] and ids(section_path_prefix=["x", "y"]) == ["d1"]
    assert ids(title_contains="a.T") == ["d1"] and ids(updated_after=datetime(2024, 1, 2)) == ["d1"] and ids(updated_before=datetime(2023, 1, 1)) == []
    assert session_scope(None, [], False) is None and session_scope(None, [], True) == [] and session_scope(["b", "a"], ["a"], True) == ["a"]


def test_references_and_upsert(spark):
    lines = spark.createDataFrame([(1, 0, "see Fig. 2 and Table 3.1, eq. 4")], "doc_id long, block_order int, text string")
    assert {(r.kind, r.number) for r in graph.references(lines).collect()} == {("figure", "2"), ("table", "3.1"), ("formula", "4")}
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    b = spark.createDataFrame([(2, "new", 5)], "k long, v string, extra long")
    assert sorted(map(tuple, catalog.upsert(a, b, "k").collect())) == [(1, "old", None), (2, "new", 5)]


def test_ingest_is_idempotent(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("src", "store", "ck"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    rows.write.parquet(src)
    ingest(spark, src, store, ck).awaitTermination()
    rows.write.mode("append").parquet(src)
    ingest(spark, src, store, ck).awaitTermination()
    assert spark.read.parquet(store).count() == 2


BLOCK = "doc_id long, page int, block_order int, block_type string, text string, section_path array<string>"


def test_edges_of_a_document(spark):
    rows = [
        (1, 1, 0, "section_header", "A", ["A"]), (1, 1, 1, "image", "picture", ["A"]), (1, 1, 2, "caption", "Figure 7: a cat", ["A"]), (1, 1, 3, "table", "x", ["A"]), (1, 1, 4, "caption", "Table: sizes", ["A"]),
        (1, 1, 5, "section_header", "B", ["A", "B"]), (1, 1, 6, "paragraph", "see figure 7 and eq. 9,", ["A", "B"]), (1, 2, 7, "paragraph", "more", ["A", "B"]), (1, 2, 8, "paragraph", "other", ["Z"]), (2, 1, 0, "caption", "Figure 1: alone", []),
    ]
    blocks = spark.createDataFrame(rows, BLOCK)
    pairs = lambda df, kind: {(r.source, r.target) for r in df.where(f"edge_type = '{kind}'").collect()}
    captions = graph.caption_edges(blocks)
    assert pairs(captions, "caption_of") == {(2, 1), (4, 3)} and pairs(captions, "table_row_context") == {(4, 3)}
    assert pairs(graph.reference_edges(blocks), "references") == {(2, 1), (6, 1)}
    assert pairs(graph.section_edges(blocks), "section_parent") == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 5), (7, 5)}
    assert pairs(graph.continued_edges(blocks), "continued_from") == {(7, 6)}
    every = graph.relations(blocks)
    assert pairs(every, "next_block") >= {(6, 5)[::-1], (7, 8)} and (6, 7) not in pairs(every, "next_block")
    assert graph.relations(blocks.limit(0)).count() == 0


def test_near_blocks(spark):
    at = [(0.0, 0.0), (0.1, 0.0), (-0.05, 0.02), (0.5, 0.5), (0.5, 0.67)]
    blocks = spark.createDataFrame([(1, i, x, y, 1.0) for i, (x, y) in enumerate(at)], "page int, block_id int, cx double, cy double, diagonal double")
    want = {(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if i != j and ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 <= 0.18}
    assert {(r.source, r.target) for r in graph.near(blocks).collect()} == want


def test_layout_roles(spark):
    rows = [(1, 0, "paragraph", "Title", 5.0, 8.0), (1, 1, "paragraph", "Body", 40.0, 60.0), (1, 2, "paragraph", "title ", 2.0, 9.0), (1, 3, "paragraph", "note", 90.0, 95.0), (1, 4, "caption", "Title", 1.0, 2.0), (1, 5, "paragraph", "p", None, None)]
    found = graph.layout_roles(spark.createDataFrame(rows, "doc_id long, block_order int, block_type string, text string, y0 double, y1 double").withColumn("page_height", F.lit(100.0)))
    assert [r.layout_role for r in found.orderBy("block_order").collect()] == ["header", "body", "header", "footnote", "caption", "body"]


def test_chunks_by_type(spark):
    table = "Table columns: a, b\n" + "\n".join(f"Row {i}: a={i}; b=x" for i in range(1, 7))
    rows = [
        (1, 1, 0, "table", table, ["T"]), (1, 1, 1, "caption", "Table 1: sizes", ["T"]), (1, 1, 2, "list", "Level 1: one\nLevel 2: two\nLevel 1: three", []), (1, 1, 3, "code", "def f():\n  return 1\n\ndef g():\n  return 2", []),
        (1, 1, 4, "paragraph", "w " * 50, []), (1, 1, 5, "page_marker", "7", []), (1, 1, 6, "paragraph", "  ", []), (1, 1, 7, "paragraph", "clause 3.2.1 holds 5% ", ["C"]),
    ]
    blocks = spark.createDataFrame(rows, BLOCK).withColumn("title", F.lit("Doc"))
    edges = spark.createDataFrame([(1, 0, 1, "has_caption", 0.98), (1, 0, 4, "references", 0.9), (1, 4, 0, "next_block", 0.72)], "doc_id long, source int, target int, edge_type string, weight double")
    found = assembly.chunks(blocks, edges, 20).orderBy("block_order", "child_index").collect()
    by = {}
    for r in found:
        by.setdefault(r.block_order, []).append(r)
    assert set(by) == {0, 1, 2, 3, 4, 7} and {r.split_strategy for r in by[0]} == {"table_rows"} and all(r.child_text.startswith("Table columns: a, b\n") for r in by[0])
    assert [r.child_text for r in by[2]] == ["Level 1: one\nLevel 2: two\nLevel 1: three"] and [r.split_strategy for r in by[3]] == ["code_units"] * 2
    assert {r.split_strategy for r in by[4]} == {"fallback"} and all(r.chunk_words <= 20 for r in found)
    # four budgets of 20 hold the caption, not the 50 words as well
    assert by[0][0].relation_types == ["has_caption"] and by[0][0].block_ids == ["1:1:0", "1:1:1"] and by[0][0].related == "Table 1: sizes"
    assert by[7][0].retrieval_text.startswith("Title: Doc\nSection: C\nClause: 3.2.1\n") and by[7][0].retrieval_strategy == "regulation_enhanced"
    assert len({r.chunk_id for r in found}) == len(found)

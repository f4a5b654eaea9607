"""Pages and layout items of page parsers' output."""

from __future__ import annotations

from corpuscle.operators import layout, parsed


def test_split_pages(spark):
    end = "--- end of page={} ---"
    rows = [(1, f"first\n{end.format(1)}\n second \n{end.format(2)}\nthird"), (2, "  alone "), (3, None), (4, ""), (5, f" \n{end.format(4)}\n"), (6, "not --- end of page=1 --- inside")]
    got = parsed.split_pages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "page_number", "page_label", "text"]
    assert sorted((r.doc_id, r.page_number, r.page_label, r.text) for r in got.collect()) == [
        (1, 1, "1", "first"), (1, 2, "2", "second"), (1, 3, "3", "third"), (2, 1, "1", "alone"), (4, 1, "1", ""), (5, 5, "5", ""), (6, 1, "1", "not --- end of page=1 --- inside"),
    ]
    assert {r.doc_id: r.n_pages for r in parsed.page_counts(got).collect()} == {1: 3, 2: 1, 4: 1, 5: 1, 6: 1}


def test_layout_items(spark):
    boxes = """[" plain ", {"text": " ", "content": "Head", "type": "title", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}, {"lines": [" a ", {"value": "b"}, 7, ""], "kind": "para", "box": {"left": 5, "top": 6, "right": 7, "bottom": 8}},
      {"text": 5}, 9, null, {"value": "v", "rect": [1.5, 2, 3, 4, 5], "id": "own"}, {"text": "t", "bbox": [1, 2]}]"""
    tables = '[{"rows": [[1, "x"]]}, {"rows": []}, {"text": "said", "id": "T"}]'
    images = '[{"caption": " c ", "src": "p.png"}, {}, {"alt": "a"}]'
    rows = [(1, 1, boxes, tables, images), (1, 2, '[{"text": "x", "label": "table"}, {"text": "y", "type": "figure"}]', tables, images), (2, 1, None, None, None), (3, 1, "[", "{}", images)]
    found = parsed.layout_items(spark.createDataFrame(rows, "doc_id long, page int, boxes string, tables string, images string"))
    got = sorted((tuple(r) for r in found.select("doc_id", "page", "item_order", "item_type", "text", "x0", "y1", "parser_block_id").collect()), key=lambda r: (*r[:3], r[4]))
    assert got == [
        (1, 1, 0, None, "plain", None, None, None), (1, 1, 1, "title", "Head", 1, 4, "box-1"), (1, 1, 2, "para", "a\nb", 5, 8, "box-2"), (1, 1, 5, "table", '[[1,"x"]]', None, None, "table-5"),
        (1, 1, 6, "table", "said", None, None, "T"), (1, 1, 6, None, "v", 1.5, 4, "own"), (1, 1, 7, "image", "![ c ](p.png)\nc", None, None, "image-7"), (1, 1, 7, None, "t", None, None, "box-7"), (1, 1, 8, "image", "![a]()", None, None, "image-8"),
        (1, 2, 0, "table", "x", None, None, "box-0"), (1, 2, 1, "figure", "y", None, None, "box-1"),
        (3, 1, 0, "image", "![ c ](p.png)\nc", None, None, "image-0"), (3, 1, 1, "image", "![a]()", None, None, "image-1"),
    ]
    blocks = layout.layout_blocks(found).where("doc_id = 1 and page = 1").collect()
    assert {"Head", "v"} <= {b.text for b in blocks}

"""Reading order, layout items and pages on literal cases and against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from corpuscle.operators import graph, layout

ITEM = "doc_id long, page int, item_order int, item_type string, text string, x0 double, y0 double, page_height double, heading_level int, title string"


def plain_order(items, height):
    """Items (order, x, y or None) as a reader goes: into the first band whose first item's top is near."""
    near = min(18.0, max(6.0, height * 0.008)) if height else 10.0
    bands = []
    for it in sorted(items, key=lambda i: (i[2] if i[2] is not None else i[0], i[1] or 0.0, i[0])):
        for band in bands:
            if it[2] is not None and band[0][2] is not None and abs(it[2] - band[0][2]) <= near:
                band.append(it)
                break
        else:
            bands.append([it])
    return [i[0] for band in bands for i in sorted(band, key=lambda i: (i[1] or 0.0, i[0]))]


def test_reading_order(spark):
    local, rows, want = np.random.default_rng(1), [], {}
    for page in range(40):
        height = [None, 0.0, 500.0, 2000.0, 5000.0][page % 5]
        items = [(k, float(local.integers(0, 300)), float(local.integers(0, 200)) if local.random() < 0.8 and page % 7 else None) for k in range(int(local.integers(1, 40)))]
        rows += [(page % 3, page, k, "text", f"t{k}", x if y is not None else None, y, height, None, None) for k, x, y in items]
        want[page % 3, page] = plain_order([(k, x if y is not None else None, y) for k, x, y in items], height)
    got = {}
    for r in layout.reading_order(spark.createDataFrame(rows, ITEM)).orderBy("doc_id", "page", "position").collect():
        got.setdefault((r.doc_id, r.page), []).append(r.item_order)
    assert got == want
    assert layout.reading_order(spark.createDataFrame([], ITEM)).count() == 0


def test_layout_blocks(spark):
    rows = [
        (1, 1, 0, "heading", "# Guide", 80.0, 60.0, 1000.0, None, "Root"), (1, 1, 2, "caption", "Equation 1. Energy formula", 90.0, 120.0, 1000.0, None, "Root"), (1, 1, 1, "formula", "$$ E = mc^2 $$", 90.0, 160.0, 1000.0, None, "Root"),
        (1, 1, 3, "paragraph", "Equation 1 explains the energy model.", 90.0, 240.0, 1000.0, None, "Root"), (1, 2, 0, "Title", "Deeper", 0.0, 5.0, 1000.0, 3, "Root"), (1, 2, 1, None, "![a cat](cat.png \"Tom\")", 0.0, 50.0, 1000.0, None, "Root"),
        (1, 2, 2, "table", "| a | b |\n|---|---|\n| 1 | 2 |", 0.0, 90.0, 1000.0, None, "Root"), (1, 2, 3, "table", "| x | y |\n| 3 |  |", 0.0, 130.0, 1000.0, None, "Root"), (1, 2, 4, "bul-let", "odd kind", 0.0, 170.0, 1000.0, None, "Root"),
        (1, 2, 5, "code", "x = 1 + 2", 0.0, 210.0, 1000.0, None, "Root"), (1, 2, 6, "list", "- one thing\n- two things", 0.0, 250.0, 1000.0, None, "Root"), (1, 2, 7, "text", "  ", 0.0, 290.0, 1000.0, None, "Root"), (1, 2, 8, "text", None, 0.0, 290.0, 1000.0, None, "Root"),
        (2, 1, 0, "text", "<img alt=\"dog\" src='d.png'>", 0.0, 0.0, None, None, None), (2, 1, 1, "image", "<img alt=\"dog\" src='d.png'/>", 0.0, 20.0, None, None, None), (2, 1, 2, "header", "Deep start", 0.0, 40.0, None, 2, None),
    ]
    found = layout.layout_blocks(spark.createDataFrame(rows, ITEM)).orderBy("doc_id", "block_order").collect()
    assert [(r.block_type, r.text, r.section_path) for r in found if r.doc_id == 1] == [
        ("section_header", "Guide", ["Guide"]), ("caption", "Equation 1. Energy formula", ["Guide"]), ("formula", "$$ E = mc^2 $$", ["Guide"]), ("paragraph", "Equation 1 explains the energy model.", ["Guide"]),
        ("section_header", "Deeper", ["Guide", "Deeper"]), ("image", "Image block\nAlt: a cat\nSource: cat.png\nTitle: Tom", ["Guide", "Deeper"]), ("table", "Table columns: a, b\nRow 1: a=1; b=2", ["Guide", "Deeper"]),
        ("table", "Table columns: column_1, column_2\nRow 1: column_1=x; column_2=y\nRow 2: column_1=3", ["Guide", "Deeper"]), ("paragraph", "odd kind", ["Guide", "Deeper"]), ("formula", "x = 1 + 2", ["Guide", "Deeper"]), ("list", "- one thing\n- two things", ["Guide", "Deeper"]),
    ]
    assert [(r.block_type, r.text, r.section_path) for r in found if r.doc_id == 2] == [("paragraph", "<img alt=\"dog\" src='d.png'>", []), ("image", "Image block\nAlt: dog\nSource: d.png", []), ("section_header", "Deep start", ["Deep start"])]
    # the graph reads them: the caption's formula is explained by the paragraph
    blocks = layout.layout_blocks(spark.createDataFrame(rows, ITEM))
    edges = {(r.source, r.target) for r in graph.reference_edges(blocks).where("edge_type = 'formula_explains' and doc_id = 1").collect()}
    assert (3, 2) in edges


def test_page_documents(spark):
    pages = [
        (1, 1, None, "\n 1 \n# Guide\nIntro\n1\n", "Root"), (1, 2, "ii", "Page two starts\n## Setup\n- a\n\n- b", "Root"), (1, 3, None, "PAGE 3", "Root"), (1, 4, "", "4 / 9\nlast  line", "Root"),
        (2, 1, None, None, None), (3, 7, "x", "### Deep\ntext", "Top"),
    ]
    docs = spark.createDataFrame(pages, "doc_id long, page_number int, page_label string, text string, title string").withColumn("marker", F.lit("z"))
    show = lambda df: [(r.doc_id, r.page, r.block_type, r.text, r.section_path) for r in df.orderBy("doc_id", "block_order").collect()]
    assert show(layout.page_documents(docs)) == [
        (1, 1, "page_marker", "1", ["Root"]), (1, 1, "section_header", "Guide", ["Guide"]), (1, 1, "paragraph", "Intro\n1", ["Guide"]), (1, 2, "page_marker", "ii", ["Guide"]), (1, 2, "paragraph", "Page two starts", ["Guide"]),
        (1, 2, "section_header", "Setup", ["Guide", "Setup"]), (1, 2, "list", "- a", ["Guide", "Setup"]), (1, 2, "list", "- b", ["Guide", "Setup"]), (1, 3, "page_marker", "PAGE 3", ["Guide", "Setup"]), (1, 4, "page_marker", "4 / 9", ["Guide", "Setup"]), (1, 4, "paragraph", "last line", ["Guide", "Setup"]),
        (2, 1, "page_marker", "1", []), (3, 7, "page_marker", "x", ["Top"]), (3, 7, "section_header", "Deep", ["Top", "Deep"]), (3, 7, "paragraph", "text", ["Top", "Deep"]),
    ]
    assert ("1", "page_marker") not in [(x[3], x[2]) for x in show(layout.page_documents(docs, markers=False))]
    assert layout.page_documents(docs.limit(0)).count() == 0

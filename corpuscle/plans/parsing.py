"""Queries over parsers: HTML, JSON and CSV blocks, line blocks, pages, reading order, recursive chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import assembly, blocks, graph, layout, markup, parsed, splitter, structured
from corpuscle.sources.tables import saved

from .registry import Tables, query

# --- HTML


def _pages(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("doc_id"), "html", F.parse_url("url", F.lit("HOST")).alias("title"))


def _html(t: Tables) -> DataFrame:
    """Blocks of all pages as a table, since graph and chunks read them several times."""
    return saved(markup.html_blocks(_pages(t)).withColumn("page", F.lit(1)), "html")


@query()
def html_blocks(t: Tables) -> DataFrame:
    found = markup.html_blocks(_pages(t))
    return found.withColumn("section_path", F.array_join("section_path", " > "))


@query()
def html_relations(t: Tables) -> DataFrame:
    """The block graph of all pages."""
    return graph.relations(_html(t))


@query()
def html_chunks(t: Tables) -> DataFrame:
    """Chunks of all pages along that graph."""
    found = _html(t)
    rows = assembly.chunks(found, saved(graph.relations(found), "edges"), captions=graph.captions(found))
    return rows.select("doc_id", "block_order", "child_index", "child_count", "chunk_id", "parent_id", "block_type", "split_strategy", "retrieval_strategy", "child_text", "chunk_words")


# --- JSON and CSV

_EVENT = "'{\"event\": {\"id\": ' || event_id || ', \"tags\": [\"' || event_type || '\", {\"value\": ' || CAST(floor(value) AS BIGINT) || ', \"none\": null}, []], \"empty\": {}}, \"props\": ' || coalesce(props, 'null') || ', \"odd\": ' || CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END || '}'"


def _events(t: Tables) -> DataFrame:
    """Each event as nested JSON around its properties."""
    n = F.floor("value").cast("long").cast("string")
    parts = ['{"event": {"id": ', F.col("event_id").cast("string"), ', "tags": ["', F.col("event_type"), '", {"value": ', n, ', "none": null}, []], "empty": {}}, "props": ', F.coalesce("props", F.lit("null")), ', "odd": ', (F.col("event_id") % 2 == 1).cast("string"), "}"]
    return t.events.select(F.col("event_id").alias("doc_id"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


@query(
    f"""WITH d AS (SELECT event_id AS doc_id, CAST({_EVENT} AS JSON) AS j FROM events), e AS (SELECT d.doc_id, x.fullkey, x.type, x.atom FROM d, json_tree(d.j) AS x)
    SELECT doc_id, replace(substr(fullkey, 3), '"', '') AS path, CASE type WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN CAST(atom AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string(atom, '$') END AS value FROM e WHERE type NOT IN ('OBJECT', 'ARRAY')"""
)
def json_paths(t: Tables) -> DataFrame:
    return structured.json_paths(_events(t)).select("doc_id", "path", "value")


@query(
    """WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty FROM lineitem), a AS (SELECT o_orderkey AS doc_id, o_custkey, o_orderpriority, o_orderstatus FROM orders)
    SELECT doc_id, 0 AS block_order, 'section_header' AS block_type, 'customer' AS text, 'customer' AS section_path, CAST(1 AS INT) AS heading_level, CAST(NULL AS VARCHAR) AS table_headers FROM a
    UNION ALL SELECT doc_id, 1, 'paragraph', 'customer.key=' || o_custkey, 'customer', 0, NULL FROM a
    UNION ALL SELECT doc_id, 2, 'paragraph', 'customer.note=', 'customer', 0, NULL FROM a
    UNION ALL SELECT doc_id, 3, 'list', '- ' || o_orderpriority || chr(10) || '- ' || o_orderstatus, 'flags', 0, NULL FROM a
    UNION ALL SELECT doc_id, 4, 'table', 'Table columns: part, qty' || chr(10) || string_agg('Row ' || r || ': part=' || part || '; qty=' || qty, chr(10) ORDER BY r), 'lines', 0, 'part, qty' FROM (SELECT a.doc_id, part, qty, row_number() OVER (PARTITION BY k ORDER BY n, part, qty) AS r FROM a JOIN li ON li.k = a.doc_id) GROUP BY doc_id"""
)
def json_blocks(t: Tables) -> DataFrame:
    """Orders as JSON objects with their lines, taken apart into blocks."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"))
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    lines = F.transform(F.coalesce("l", F.array().cast("array<struct<n:int,part:bigint,qty:bigint>>")), lambda x: F.concat(F.lit('{"part": '), x["part"].cast("string"), F.lit(', "qty": '), x["qty"].cast("string"), F.lit("}")))
    text = F.concat(F.lit('{"customer": {"key": '), F.col("o_custkey").cast("string"), F.lit(', "note": null}, "flags": ["'), "o_orderpriority", F.lit('", "'), "o_orderstatus", F.lit('"], "lines": ['), F.array_join(lines, ", "), F.lit("]}"))
    found = structured.json_blocks(t.orders.join(held, "o_orderkey", "left").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return found.select("doc_id", "block_order", "block_type", "text", F.array_join("section_path", " > ").alias("section_path"), F.coalesce("heading_level", F.lit(0)).alias("heading_level"), "table_headers")


_CSV = "'turn,role,text' || chr(10) || string_agg(turn || ',' || role || ',\"' || replace(text, '\"', '\"\"') || '\"', chr(10) ORDER BY turn)"


@query(
    f"""WITH d AS (SELECT conv_id, {_CSV} || chr(10) AS t FROM conversations GROUP BY 1), x AS (SELECT conv_id, unnest(regexp_extract_all(t, '("(?:[^"]|"")*"[^,\\n]*|[^,\\n]*)(,|\\n)', 1)) AS c, unnest(range(len(regexp_extract_all(t, '("(?:[^"]|"")*"[^,\\n]*|[^,\\n]*)(,|\\n)', 1)))) AS i FROM d),
    c AS (SELECT conv_id, i // 3 AS r, i % 3 AS k, trim(CASE WHEN c LIKE '"%' THEN replace(replace(c[2:-2], '""', '"'), chr(10), '') ELSE c END) AS v FROM x),
    w AS (SELECT conv_id, r, 'Row ' || r || ': ' || string_agg(['turn', 'role', 'text'][k + 1] || '=' || v, '; ' ORDER BY k) AS line FROM c WHERE r > 0 AND v <> '' GROUP BY 1, 2)
    SELECT conv_id AS doc_id, 0 AS block_order, 'Table columns: turn, role, text' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS text, 'turn, role, text' AS table_headers, CAST(max(r) AS INT) AS table_row_count FROM w GROUP BY 1"""
)
def csv_blocks(t: Tables) -> DataFrame:
    """Conversations as CSV texts, quotes doubled and line ends inside quotes, read into tables."""
    row = F.concat(F.col("turn").cast("string"), F.lit(","), "role", F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    texts = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))).alias("r"))
    texts = texts.select("doc_id", F.concat(F.lit("turn,role,text\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("text"))
    return structured.csv_blocks(texts).select("doc_id", "block_order", "text", "table_headers", "table_row_count")


# --- lines and pages

_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_SYMBOLS, _WORDS = _COUNT.format("s", r"\\sum|\\int|\\frac|\\sqrt|<=|>=|==|!=|=|\^|_|\+|-"), _COUNT.format("s", "[A-Za-z\\x{4e00}-\\x{9fff}]+")
#: Islands of lines of the rows (doc_id, text) of a table `src`.
ISLANDS = f"""t0 AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM src)),
t1 AS (SELECT *, trim(line) AS s, coalesce(sum(CAST(regexp_matches(trim(line), '{blocks.FENCE}') AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM t0),
t2 AS (SELECT *, CASE WHEN open OR regexp_matches(s, '{blocks.FENCE}') THEN 'code' WHEN s = '' THEN NULL WHEN regexp_matches(s, '{blocks.HEADING}') THEN 'section_header' WHEN regexp_matches(s, '{blocks.FORMULA}') THEN 'formula' WHEN regexp_matches(s, '{blocks.CAPTION}') THEN 'caption'
  WHEN regexp_matches(s, '{blocks.IMAGE}') THEN 'image' WHEN regexp_matches(s, '{blocks.TABLE_ROW}') THEN 'table' WHEN regexp_matches(s, '{blocks.LIST_ITEM}') THEN 'list' WHEN {_SYMBOLS} >= 2 AND {_WORDS} <= greatest(2, {_SYMBOLS} // 2) THEN 'formula' ELSE 'paragraph' END AS kind,
  sum(CAST(s = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t1),
t3 AS (SELECT *, kind = 'paragraph' AND regexp_matches(line, '^[ \\t]') AS plain FROM t2),
t4 AS (SELECT doc_id, i, line, open, CASE WHEN plain AND last_value(CASE WHEN plain THEN NULL ELSE kind END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY i) = 'list' THEN 'list' ELSE kind END AS type FROM t3),
t5 AS (SELECT *, lag(type) OVER w AS b_type, coalesce(lag(open) OVER w, false) AS b_open FROM t4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t6 AS (SELECT *, sum(CAST(type IS NOT NULL AND (b_type IS NULL OR b_type <> type OR type IN ('section_header', 'caption', 'image', 'formula') OR (type = 'code' AND NOT open AND NOT b_open AND b_type <> 'code')) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM t5),
t7 AS (SELECT doc_id, CAST(block - 1 AS INT) AS block_order, min(type) AS block_type, trim(string_agg(line, chr(10) ORDER BY i)) AS raw FROM t6 WHERE type IS NOT NULL GROUP BY doc_id, block),
isl AS (SELECT doc_id, block_order, block_type, CASE WHEN block_type = 'section_header' THEN regexp_extract(raw, '{blocks.HEADING}', 2) ELSE raw END AS text, CASE WHEN block_type = 'section_header' THEN len(regexp_extract(raw, '{blocks.HEADING}', 1)) END AS heading_level FROM t7)"""
#: Section paths of the blocks of a table `fb` (doc_id, block_order, block_type, text, heading_level).
PATHS = """hd AS (SELECT doc_id, heading_level AS lv, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_order) AS n FROM fb WHERE block_type = 'section_header'),
pth AS (SELECT doc_id, n, [text] AS path FROM hd WHERE n = 1 UNION ALL SELECT hd.doc_id, hd.n, CASE WHEN lv <= 1 THEN [text] ELSE pth.path[1 : least(lv - 1, len(pth.path))] || [text] END FROM pth JOIN hd ON hd.doc_id = pth.doc_id AND hd.n = pth.n + 1),
out AS (SELECT b.*, coalesce(array_to_string(pth.path, ' > '), '') AS section_path FROM (SELECT *, sum(CAST(block_type = 'section_header' AS INT)) OVER (PARTITION BY doc_id ORDER BY block_order) AS n FROM fb) b LEFT JOIN pth ON pth.doc_id = b.doc_id AND pth.n = b.n)"""


@query(f"WITH RECURSIVE src AS (SELECT doc_id, text FROM documents), {ISLANDS}, fb AS (SELECT * FROM isl), {PATHS} SELECT doc_id, block_order, block_type, text, section_path FROM out")
def line_blocks(t: Tables) -> DataFrame:
    found = blocks.blocks(t.documents.select("doc_id", "text"))
    return found.select("doc_id", "block_order", "block_type", "text", F.array_join("section_path", " > ").alias("section_path"))


_SIX = "pl AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s*\\n\\s*'), lambda x: trim(x) <> '') AS l FROM documents))"


@query(
    f"""WITH RECURSIVE {_SIX}, pg AS (SELECT doc_id, i // 6 AS page, string_agg(CASE i % 6 WHEN 0 THEN repeat('#', CAST(1 + (i // 6) % 3 AS INT)) || ' Part ' || i WHEN 3 THEN '- ' || 'item ' || i ELSE 'line ' || i || ' of ' || doc_id END, chr(10) ORDER BY i) AS body FROM pl GROUP BY 1, 2),
    src AS (SELECT doc_id * 1000000 + page AS doc_id, body AS text FROM pg), {ISLANDS},
    al AS (SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS page, block_order AS o, block_type, text, heading_level, CAST(NULL AS BOOLEAN) AS marker_detected FROM isl UNION ALL SELECT doc_id, page, -1, 'page_marker', CASE WHEN page % 2 = 0 THEN 'Page ' || page WHEN page % 3 = 0 THEN 'p' || page ELSE CAST(page AS VARCHAR) END, NULL, page % 2 = 0 FROM pg),
    fb AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, o) - 1 AS INT) AS block_order FROM al), {PATHS} SELECT doc_id, page, block_order, block_type, text, section_path, coalesce(marker_detected, false) AS marker_detected FROM out"""
)
def page_documents(t: Tables) -> DataFrame:
    """Documents as pages of six lines, with headings, items and printed page numbers on every other page, into blocks across pages."""
    found = F.filter(F.split("text", r"\s*\n\s*"), lambda x: F.trim(x) != "")
    rows = t.documents.select("doc_id", F.posexplode(found).alias("i", "line"))
    i, k = F.col("i").cast("string"), F.col("i") % 6
    said = F.when(k == 0, F.concat(F.repeat(F.lit("#"), (1 + F.expr("i div 6") % 3).cast("int")), F.lit(" Part "), i)).when(k == 3, F.concat(F.lit("- item "), i)).otherwise(F.concat(F.lit("line "), i, F.lit(" of "), F.col("doc_id").cast("string")))
    pages = rows.select("doc_id", F.expr("i div 6").alias("page_number"), "i", said.alias("said")).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("i", "said"))).alias("l"))
    n = F.col("page_number")
    head = F.when(n % 2 == 0, F.concat(F.lit("Page "), n.cast("string"), F.lit("\n"))).otherwise("")
    pages = pages.select("doc_id", "page_number", F.when(n % 3 == 0, F.concat(F.lit("p"), n.cast("string"))).alias("page_label"), F.concat(head, F.array_join(F.transform("l", lambda x: x["said"]), "\n")).alias("text"))
    return layout.page_documents(pages).select("doc_id", "page", "block_order", "block_type", "text", F.array_join("section_path", " > ").alias("section_path"), F.coalesce("marker_detected", F.lit(False)).alias("marker_detected"))


_ITEMS = """it AS (SELECT vec_id // 40 AS page, vec_id AS item_order, CASE WHEN vec_id % 7 <> 0 THEN round(CAST(embedding[1] AS DOUBLE) * 200 + 100, 1) END AS x0, CASE WHEN vec_id % 7 <> 0 THEN round(CAST(embedding[2] AS DOUBLE) * 200 + 100, 1) END AS y0, CASE WHEN (vec_id // 40) % 3 > 0 THEN 1000.0 * ((vec_id // 40) % 3) END AS h FROM embeddings),
so AS (SELECT *, coalesce(y0, item_order) AS y, coalesce(x0, 0) AS x, CASE WHEN h > 0 THEN least(18.0, greatest(6.0, h * 0.008)) ELSE 10.0 END AS tol, row_number() OVER (PARTITION BY page ORDER BY coalesce(y0, item_order), coalesce(x0, 0), item_order) AS k FROM it),
r AS (SELECT page, item_order, x, k, 0 AS band, 1 AS nxt, CASE WHEN y0 IS NOT NULL THEN y END AS anchor, CASE WHEN y0 IS NOT NULL THEN 0 ELSE -1 END AS cur FROM so WHERE k = 1
  UNION ALL SELECT so.page, so.item_order, so.x, so.k, CASE WHEN so.y0 IS NOT NULL AND so.y - r.anchor <= so.tol THEN r.cur ELSE r.nxt END, CASE WHEN so.y0 IS NOT NULL AND so.y - r.anchor <= so.tol THEN r.nxt ELSE r.nxt + 1 END,
  CASE WHEN so.y0 IS NOT NULL AND NOT coalesce(so.y - r.anchor <= so.tol, false) THEN so.y ELSE r.anchor END, CASE WHEN so.y0 IS NOT NULL AND NOT coalesce(so.y - r.anchor <= so.tol, false) THEN r.nxt ELSE r.cur END FROM r JOIN so ON so.page = r.page AND so.k = r.k + 1)"""


@query(f"WITH RECURSIVE {_ITEMS} SELECT page, item_order, band, CAST(row_number() OVER (PARTITION BY page ORDER BY band, x, item_order) - 1 AS INT) AS position FROM r")
def reading_order(t: Tables) -> DataFrame:
    """Boxes from vectors, forty to a page, some without a box, in the order in which they are read."""
    v, page = F.col("vec_id"), F.expr("vec_id div 40")
    at = lambda i: F.when(v % 7 != 0, F.round(F.col("embedding")[i].cast("double") * 200 + 100, 1))
    items = t.embeddings.select(F.lit(0).alias("doc_id"), page.alias("page"), v.alias("item_order"), at(0).alias("x0"), at(1).alias("y0"), F.when(page % 3 > 0, (page % 3) * 1000.0).alias("page_height"))
    return layout.reading_order(items).select("page", "item_order", "band", "position")


@query()
def recursive_chunks(t: Tables) -> DataFrame:
    """All documents under the budget of word pieces; a plain version tests the splitter."""
    return splitter.recursive_chunks(t.documents.select("doc_id", "text"))


# --- output of page parsers


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS n FROM l)
SELECT doc_id, CAST(n AS INT) AS page_number, CAST(n AS VARCHAR) AS page_label, '(' || line || ')' AS text FROM p UNION ALL SELECT doc_id, CAST(len(l) + 1 AS INT), CAST(len(l) + 1 AS VARCHAR), '' FROM l"""
)
def split_pages(t: Tables) -> DataFrame:
    """Documents with a separator after each line, as a parser writes it after each page, into pages."""
    ended = F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("("), s, F.lit(")\n\n--- end of page="), (i + 1).cast("string"), F.lit(" ---\n")))
    return parsed.split_pages(t.documents.select("doc_id", F.array_join(ended, "").alias("text")))


@query(
    """WITH e AS (SELECT vec_id // 10 AS page, vec_id AS v, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS i, v % 5 AS k FROM embeddings),
b AS (SELECT page, i AS o, CASE k WHEN 1 THEN 'title' WHEN 2 THEN CASE WHEN page % 2 = 0 THEN 'para' ELSE 'table' END END AS kind, CASE k WHEN 0 THEN 's ' || v WHEN 1 THEN 't ' || v WHEN 2 THEN 'c ' || v ELSE 'a' || chr(10) || v END AS said,
  CASE WHEN k > 0 THEN v END AS x0, CASE WHEN k > 0 THEN v + 1 END AS y0, CASE WHEN k > 0 THEN v + 2 END AS x1, CASE WHEN k > 0 THEN v + 3 END AS y1, CASE WHEN k = 3 THEN 'own' || v WHEN k > 0 THEN 'box-' || i END AS id FROM e WHERE k < 4),
n AS (SELECT DISTINCT e.page, coalesce(c, 0) AS c, coalesce(tabled, false) AS tabled FROM e LEFT JOIN (SELECT page, count(*) AS c, bool_or(coalesce(kind = 'table', false)) AS tabled FROM b GROUP BY 1) h ON h.page = e.page)
SELECT page, CAST(o AS INT) AS item_order, kind AS item_type, said AS text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, id AS parser_block_id FROM b
UNION ALL SELECT page, CAST(c AS INT), 'table', '[[' || page || ',2]]', NULL, NULL, NULL, NULL, 'table-' || c FROM n WHERE NOT tabled
UNION ALL SELECT page, CAST(c + CASE WHEN tabled THEN 0 ELSE 1 END AS INT), 'image', '![c](p' || page || '.png)' || chr(10) || 'c', NULL, NULL, NULL, NULL, 'image-' || (c + CASE WHEN tabled THEN 0 ELSE 1 END) FROM n"""
)
def page_items(t: Tables) -> DataFrame:
    """Vectors as boxes of pages, ten to a page, in the shapes that parsers write, with a table and an image for each page."""
    v, k, page = F.col("vec_id"), F.col("vec_id") % 5, F.expr("vec_id div 10")
    at = [(v + i).cast("string") for i in range(4)]
    corners = lambda names: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), x) for n, x in zip(names, at, strict=True))), F.lit("}"))
    named = F.when(page % 2 == 0, "para").otherwise("table")
    entry = (
        F.when(k == 0, F.format_string('" s %d "', v))
        .when(k == 1, F.format_string('{"text":"t %d","type":"title","bbox":%s}', v, corners(parsed.CORNERS[0])))
        .when(k == 2, F.format_string('{"content":"c %d","kind":"%s","box":%s}', v, named, corners(parsed.CORNERS[1])))
        .when(k == 3, F.format_string('{"lines":[" a ",{"value":"%d"}],"rect":[%s],"id":"own%d"}', v, F.concat_ws(",", *at), v))
        .otherwise('{"text":"  "}')
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(v.alias("v"), entry.alias("entry")))), lambda x: x["entry"])
    pages = t.embeddings.groupBy(page.alias("page")).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("boxes"))
    pages = pages.select(F.lit(0).alias("doc_id"), "page", "boxes", F.format_string('[{"rows":[[%d,2]]}]', "page").alias("tables"), F.format_string('[{"caption":"c","src":"p%d.png"}]', "page").alias("images"))
    return parsed.layout_items(pages).drop("doc_id")

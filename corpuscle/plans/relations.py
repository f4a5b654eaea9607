"""Queries over typed blocks of pages: sections, captions, references, continuations, roles, and the graph of all edges.

The tables hold no typed blocks, so every line of every document is one, its type and place following from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import graph

from .registry import Tables, query
from .state import LINES

TYPED = f"""{LINES}, nn AS (SELECT doc_id, block_order, block_order % 8 AS k, block_order // 8 AS n, text FROM ln),
tb AS (SELECT doc_id, block_order, (block_order + 1) // 8 + 1 AS page, n, k,
  CASE k WHEN 0 THEN 'section_header' WHEN 2 THEN 'image' WHEN 3 THEN 'caption' WHEN 4 THEN 'table' WHEN 5 THEN 'formula' WHEN 7 THEN CASE WHEN doc_id % 3 = 0 THEN 'list' ELSE 'paragraph' END ELSE 'paragraph' END AS block_type,
  CASE k WHEN 0 THEN 'Part ' || n WHEN 1 THEN text || ' See Figure ' || n || ' and table ' || n || '.' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'Figure ' || n ELSE 'Picture' END
    WHEN 3 THEN CASE WHEN doc_id % 5 = 0 THEN 'Table ' ELSE 'Figure ' END || (n + doc_id % 3) || ': ' || text WHEN 4 THEN 'Table ' || n || ' | a | b' WHEN 5 THEN 'Eq. ' || n || ' = x'
    WHEN 6 THEN text || CASE WHEN doc_id % 2 = 0 THEN ':' ELSE ' eq. ' || n END ELSE text END AS text,
  CASE WHEN n % 2 = 0 THEN ['S' || (n // 2)] ELSE ['S' || (n // 2), 'T'] END AS section_path FROM nn)"""
REF = r"(?:figure|fig\.?|table|equation|formula|eq\.?)\s*([0-9]+(?:\.[0-9]+)*)"
KIND = "CASE WHEN lower({0}) LIKE 'fig%' THEN 'figure' WHEN lower({0}) LIKE 'table%' THEN 'table' ELSE 'formula' END"
TARGETS = f"""{TYPED}, named AS (SELECT *, {KIND.format(f"regexp_extract(text, '(?i){REF}', 0)")} AS kind, regexp_extract(text, '(?i){REF}', 1) AS number FROM tb),
num AS (SELECT doc_id, kind, number, max(block_order) AS target, arg_max(block_type, block_order) AS target_type FROM named WHERE number <> '' AND (block_type, kind) IN (('image', 'figure'), ('table', 'table'), ('formula', 'formula')) GROUP BY 1, 2, 3),
cp AS (SELECT *, CASE WHEN text LIKE 'Table%' THEN 'table' ELSE 'image' END AS fits FROM named WHERE block_type = 'caption'),
nearest AS (SELECT c.doc_id, c.block_order, b.block_order AS target, b.block_type AS target_type FROM cp c JOIN tb b ON b.doc_id = c.doc_id AND b.page = c.page AND b.block_type = c.fits QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.block_order ORDER BY abs(b.block_order - c.block_order), b.block_order) = 1),
ct AS (SELECT cp.doc_id, cp.block_order, cp.kind, cp.number, coalesce(num.target, nearest.target) AS target, coalesce(num.target_type, nearest.target_type) AS target_type FROM cp LEFT JOIN num USING (doc_id, kind, number) LEFT JOIN nearest ON nearest.doc_id = cp.doc_id AND nearest.block_order = cp.block_order WHERE coalesce(num.target, nearest.target) IS NOT NULL)"""
CAPTIONS = """e_cap AS (SELECT doc_id, block_order AS source, target, 'caption_of' AS edge_type, 0.98::DOUBLE AS weight FROM ct UNION ALL SELECT doc_id, target, block_order, 'has_caption', 0.98 FROM ct UNION ALL SELECT doc_id, block_order, target, 'table_row_context', 0.86 FROM ct WHERE target_type = 'table')"""
REFERENCES = f"""rf AS (SELECT DISTINCT doc_id, block_order, {KIND.format('raw')} AS kind, regexp_extract(raw, '([0-9]+(?:\\.[0-9]+)*)$', 1) AS number FROM (SELECT doc_id, block_order, unnest(regexp_extract_all(text, '(?i){REF}')) AS raw FROM tb WHERE block_type IN ('paragraph', 'list', 'code', 'caption'))),
kn AS (SELECT doc_id, kind, number, arg_max(target, o) AS target FROM (SELECT doc_id, kind, number, target, target AS o FROM num UNION ALL SELECT doc_id, kind, number, target, 1000000000 + block_order FROM ct) GROUP BY 1, 2, 3),
mt AS (SELECT rf.*, kn.target FROM rf JOIN kn USING (doc_id, kind, number)),
e_ref AS (SELECT doc_id, block_order AS source, target, 'references' AS edge_type, 0.9::DOUBLE AS weight FROM mt UNION ALL SELECT doc_id, target, block_order, 'referenced_by', 0.9 FROM mt UNION ALL SELECT doc_id, block_order, target, 'formula_explains', 0.88 FROM mt WHERE kind = 'formula')"""
SECTIONS = """hd AS (SELECT doc_id, block_order, section_path FROM tb WHERE block_type = 'section_header'),
wn AS (SELECT doc_id, block_order, CASE WHEN block_type = 'section_header' THEN section_path[1 : len(section_path) - 1] ELSE section_path END AS path FROM tb),
sp AS (SELECT wn.doc_id, wn.block_order, max(hd.block_order) AS parent FROM wn JOIN hd ON hd.doc_id = wn.doc_id AND hd.section_path = wn.path AND hd.block_order < wn.block_order GROUP BY 1, 2),
e_sec AS (SELECT doc_id, block_order AS source, parent AS target, 'section_parent' AS edge_type, 0.95::DOUBLE AS weight FROM sp UNION ALL SELECT doc_id, parent, block_order, 'section_child', 0.95 FROM sp)"""
CONTINUED = """pr AS (SELECT *, lag(block_order) OVER w AS p_order, lag(page) OVER w AS p_page, lag(block_type) OVER w AS p_type, lag(section_path) OVER w AS p_path, lag(trim(text)) OVER w AS p_text FROM tb WHERE block_type IN ('paragraph', 'list', 'table', 'formula') WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_order)),
e_con AS (SELECT doc_id, block_order AS source, p_order AS target, 'continued_from' AS edge_type, 0.8::DOUBLE AS weight FROM pr WHERE page = p_page + 1 AND block_type = p_type AND section_path = p_path AND p_text <> '' AND (right(p_text, 1) IN (':', ',', '(', '[') OR regexp_matches(trim(text), '^\\p{Ll}')))"""
AROUND = """e_nb AS (SELECT doc_id, block_order AS source, lead(block_order) OVER w AS target, 'next_block' AS edge_type, 0.72::DOUBLE AS weight FROM tb WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_order) UNION ALL SELECT doc_id, block_order, lag(block_order) OVER w, 'prev_block', 0.72 FROM tb WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_order))"""
ALL = f"{TARGETS}, {CAPTIONS}, {REFERENCES}, {SECTIONS}, {CONTINUED}, {AROUND}, al AS (SELECT doc_id, source, target, edge_type, max(weight) AS weight FROM (FROM e_cap UNION ALL FROM e_ref UNION ALL FROM e_sec UNION ALL FROM e_con UNION ALL FROM e_nb) WHERE target IS NOT NULL GROUP BY ALL)"


def typed(t: Tables) -> DataFrame:
    """Lines as blocks: doc_id, page, block_order, block_type, text, section_path."""
    k, n, d, text = F.col("block_order") % 8, F.expr("cast(block_order div 8 as string)"), F.col("doc_id"), F.col("text")
    kind = F.when(k == 0, "section_header").when(k == 2, "image").when(k == 3, "caption").when(k == 4, "table").when(k == 5, "formula").when((k == 7) & (d % 3 == 0), "list").otherwise("paragraph")
    said = (
        F.when(k == 0, F.concat(F.lit("Part "), n)).when(k == 1, F.concat(text, F.lit(" See Figure "), n, F.lit(" and table "), n, F.lit("."))).when(k == 2, F.when(d % 2 == 0, F.concat(F.lit("Figure "), n)).otherwise("Picture"))
        .when(k == 3, F.concat(F.when(d % 5 == 0, "Table ").otherwise("Figure "), F.expr("block_order div 8 + doc_id % 3").cast("string"), F.lit(": "), text)).when(k == 4, F.concat(F.lit("Table "), n, F.lit(" | a | b"))).when(k == 5, F.concat(F.lit("Eq. "), n, F.lit(" = x")))
        .when(k == 6, F.concat(text, F.when(d % 2 == 0, F.lit(":")).otherwise(F.concat(F.lit(" eq. "), n)))).otherwise(text)
    )
    top = F.concat(F.lit("S"), F.expr("cast(block_order div 16 as string)"))
    path = F.when(F.expr("(block_order div 8) % 2 = 0"), F.array(top)).otherwise(F.array(top, F.lit("T")))
    return graph.lines(t.documents).select("doc_id", F.expr("(block_order + 1) div 8 + 1").alias("page"), "block_order", kind.alias("block_type"), said.alias("text"), path.alias("section_path"))


@query(f"WITH {TYPED}, {SECTIONS} SELECT * FROM e_sec")
def section_edges(t: Tables) -> DataFrame:
    return graph.section_edges(typed(t))


@query(f"WITH {TARGETS}, {CAPTIONS} SELECT * FROM e_cap")
def caption_edges(t: Tables) -> DataFrame:
    return graph.caption_edges(typed(t))


@query(f"WITH {TARGETS}, {REFERENCES} SELECT * FROM e_ref")
def reference_edges(t: Tables) -> DataFrame:
    return graph.reference_edges(typed(t))


@query(f"WITH {TYPED}, {CONTINUED} SELECT * FROM e_con")
def continued_edges(t: Tables) -> DataFrame:
    return graph.continued_edges(typed(t))


@query(f"WITH {ALL} SELECT * FROM al")
def block_relations(t: Tables) -> DataFrame:
    return graph.relations(typed(t))


@query(f"WITH {ALL} SELECT doc_id, source, string_agg(edge_type || ':' || target, ',' ORDER BY weight DESC, edge_type, target) AS edges FROM al GROUP BY 1, 2")
def relation_projection(t: Tables) -> DataFrame:
    """Each block's edges, heaviest first."""
    return graph.outgoing(graph.relations(typed(t))).select("doc_id", "source", F.array_join("edges", ",").alias("edges"))


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, block_order, CASE WHEN block_order % 3 = 2 THEN text ELSE 'Page of ' || (doc_id % 4) END AS text, CASE WHEN block_order % 11 = 10 THEN 'page_marker' WHEN block_order % 11 = 9 THEN 'caption' ELSE 'paragraph' END AS block_type, (block_order % 10) * 10.0 AS y0, (block_order % 10) * 10.0 + 9 AS y1 FROM ln),
    c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) > 1 AS again, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) BETWEEN 1 AND 80 AS short, regexp_matches(text, '(?i){REF}') AS refers FROM b)
    SELECT doc_id, block_order, CASE WHEN block_type <> 'paragraph' THEN block_type WHEN again AND short AND NOT refers AND y0 <= 12 THEN 'header' WHEN again AND short AND NOT refers AND y1 >= 88 THEN 'footer' WHEN short AND y1 >= 90 THEN 'footnote' ELSE 'body' END AS layout_role,
    block_type = 'paragraph' AND again AND short AND NOT refers AND (y0 <= 12 OR y1 >= 88) AS excluded_from_body FROM c"""
)
def layout_roles(t: Tables) -> DataFrame:
    o = F.col("block_order")
    kind = F.when(o % 11 == 10, "page_marker").when(o % 11 == 9, "caption").otherwise("paragraph")
    said = F.when(o % 3 == 2, F.col("text")).otherwise(F.concat(F.lit("Page of "), (F.col("doc_id") % 4).cast("string")))
    rows = graph.lines(t.documents).select("doc_id", "block_order", said.alias("text"), kind.alias("block_type"), ((o % 10) * 10.0).alias("y0"), ((o % 10) * 10.0 + 9).alias("y1"), F.lit(100.0).alias("page_height"))
    return graph.layout_roles(rows).select("doc_id", "block_order", "layout_role", "excluded_from_body")

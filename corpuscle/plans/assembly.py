"""Queries over chunk assembly: parents along the block graph, child chunks with their retrieval texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import assembly, graph

from .registry import Tables, query
from .relations import ALL, typed

WP = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))"
WS = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE rtrim(left({0}, {1} - 3)) || '...' END"
PARENT_SQL = f"""{ALL}, sb AS (SELECT doc_id, block_order, block_type, trim(text) AS text, page, section_path, doc_id || ':' || page || ':' || block_order AS block_id, replace(block_type, '_', ' ') AS label FROM tb),
sz AS (SELECT *, {WP.format('text')} + {WP.format('label')} AS size FROM sb),
nr AS (SELECT al.doc_id, al.source AS block_order, list({{'size': sz.size, 'picks': [al.target], 'types': [al.edge_type]}} ORDER BY al.weight DESC, al.edge_type, al.target) AS near FROM al JOIN sz ON sz.doc_id = al.doc_id AND sz.block_order = al.target
  WHERE al.source <> al.target AND al.edge_type IN ('has_caption', 'caption_of', 'references', 'referenced_by', 'formula_explains', 'table_row_context', 'continued_from') GROUP BY 1, 2),
pk AS (SELECT sz.doc_id, sz.block_order, list_reduce(near, lambda a, x: CASE WHEN len(a.picks) < 3 AND NOT list_contains(a.picks, x.picks[1]) AND a.size + x.size <= 880 THEN {{'size': a.size + x.size, 'picks': list_concat(a.picks, x.picks), 'types': list_concat(a.types, x.types)}} ELSE a END,
  {{'size': sz.size, 'picks': CAST([] AS INT[]), 'types': CAST([] AS VARCHAR[])}}) AS r FROM sz JOIN nr USING (doc_id, block_order)),
mb AS (SELECT doc_id, block_order, unnest(list_append(r.picks, block_order)) AS member FROM pk WHERE len(r.picks) > 0),
gr AS (SELECT mb.doc_id, mb.block_order, string_agg('[' || m.label || ']' || chr(10) || m.text, chr(10) || chr(10) ORDER BY m.page, m.block_order) AS grown, string_agg(m.block_id, ':' ORDER BY m.page, m.block_order) AS ids, coalesce(string_agg(m.text, ' ' ORDER BY m.page, m.block_order) FILTER (m.block_order <> mb.block_order), '') AS related, count(*) AS n FROM mb JOIN sb m ON m.doc_id = mb.doc_id AND m.block_order = mb.member GROUP BY 1, 2),
pa AS (SELECT sb.*, coalesce(grown, sb.text) AS content, coalesce(related, '') AS related, coalesce(n, 1) AS n_blocks, coalesce(array_to_string(pk.r.types, ','), '') AS relation_types, CASE WHEN grown IS NULL THEN 'single_block' ELSE 'relation_limited' END AS strategy,
  'parent-' || left(sha1(sb.doc_id || ':' || coalesce(ids, block_id) || ':parent'), 16) AS parent_id FROM sb LEFT JOIN pk ON pk.doc_id = sb.doc_id AND pk.block_order = sb.block_order AND len(pk.r.picks) > 0 LEFT JOIN gr ON gr.doc_id = sb.doc_id AND gr.block_order = sb.block_order)"""
LINE = "CASE WHEN {1} <> '' THEN '{0}: ' || {1} END"


def _line(label: str, value: str) -> str:
    return LINE.format(label, CUT.format(WS.format(f"coalesce({value}, '')"), 180))


_TOP = f"{_line('Title', 'title')}, {_line('Section', chr(39).join(['array_to_string(section_path, ', ' > ', ')']))}"
_CONTEXT = f"{_line('Context', CUT.format(WS.format('related'), 160))}"
_SYMBOLS = "array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\\\sum|\\\\int|\\\\frac|\\\\sqrt|<=|>=|==|!=|=|\\^|_|\\+|-'))), ', ')"
CLAUSE_SQL = "nullif(regexp_extract({0}, '([0-9]+(?:\\.[0-9]+){{1,3}})', 1), '')"
TERMS_SQL = "list_distinct(regexp_extract_all({0}, '(?i)[0-9]+(?:\\.[0-9]+)?(?:%|MPa)'))"
CHUNK_SQL = f"""{PARENT_SQL}, cap AS (SELECT ct.doc_id, ct.target AS block_order, arg_max(c.text, ct.block_order) AS caption_text FROM ct JOIN tb c ON c.doc_id = ct.doc_id AND c.block_order = ct.block_order GROUP BY 1, 2),
wd AS (SELECT pa.*, caption_text, 'Doc ' || pa.doc_id AS title, block_type <> 'list' AND {WP.format('text')} > 220 AS long FROM pa LEFT JOIN cap ON cap.doc_id = pa.doc_id AND cap.block_order = pa.block_order),
lw AS (SELECT *, list_transform(parts, lambda p: greatest(1, {WP.format('p')})) AS sz FROM (SELECT doc_id, block_order, list_filter(list_transform(string_split(text, ' '), lambda p, i: CASE WHEN i > 1 THEN ' ' || p ELSE p END), lambda p: p <> '') AS parts FROM wd WHERE long)),
lc AS (SELECT *, len(parts) AS n, list_transform(range(len(sz) + 1), lambda i: coalesce(list_sum(sz[1 : i]), 0)) AS c FROM lw),
ck AS (SELECT *, 0 AS j, CAST(1 AS BIGINT) AS f, list_max(list_filter(range(1, n + 1), lambda e: c[e + 1] - c[1] + e - 1 <= 220)) AS e FROM lc
  UNION ALL SELECT doc_id, block_order, parts, sz, n, c, j, f, list_max(list_filter(range(f, n + 1), lambda x: c[x + 1] - c[f] + x - f <= 220)) FROM (SELECT doc_id, block_order, parts, sz, n, c, j + 1 AS j, list_min(list_filter(range(f, e + 2), lambda s: s > e OR (c[e + 1] - c[s] + e - s <= 40 AND c[e + 1] - c[s] + e - s + sz[e + 1] + 1 <= 220))) AS f FROM ck WHERE e < n)),
kd AS (SELECT doc_id, block_order, list(trim(array_to_string(parts[f : e], '')) ORDER BY j) FILTER (trim(array_to_string(parts[f : e], '')) <> '') AS k FROM ck GROUP BY 1, 2),
cw AS (SELECT wd.*, CASE WHEN long THEN kd.k ELSE [text] END AS kids FROM wd LEFT JOIN kd ON kd.doc_id = wd.doc_id AND kd.block_order = wd.block_order),
ch AS (SELECT *, CAST(unnest(range(len(kids))) AS INT) AS child_index, unnest(kids) AS child_text, CAST(len(kids) AS INT) AS child_count FROM cw),
an AS (SELECT *, coalesce({CLAUSE_SQL.format('child_text')}, {CLAUSE_SQL.format('text')}, {CLAUSE_SQL.format('content')}) AS clause_id, CASE WHEN len({TERMS_SQL.format('child_text')}) > 0 THEN regexp_extract_all(child_text, '(?i)[0-9]+(?:\\.[0-9]+)?(?:%|MPa)') WHEN len({TERMS_SQL.format('text')}) > 0 THEN regexp_extract_all(text, '(?i)[0-9]+(?:\\.[0-9]+)?(?:%|MPa)') ELSE regexp_extract_all(content, '(?i)[0-9]+(?:\\.[0-9]+)?(?:%|MPa)') END AS terms FROM ch),
pt AS (SELECT *, list_filter(CASE WHEN block_type = 'table' THEN CASE WHEN caption_text IS NOT NULL THEN [{_TOP}, {_line('Caption', 'caption_text')}] ELSE [] END WHEN block_type = 'image' THEN [{_TOP}, {_line('Caption', 'caption_text')}, {_CONTEXT}]
  WHEN block_type = 'formula' THEN [{_TOP}, {_line('Caption', 'caption_text')}, {_line('Formula', 'text')}, {_line('Symbols', _SYMBOLS)}, {_CONTEXT}]
  WHEN clause_id IS NOT NULL THEN [{_TOP}, {_line('Clause', 'clause_id')}, {_line('Numeric anchors', chr(39).join(['array_to_string(list_filter(terms, lambda x, i: list_position(terms, x) = i), ', ', ', ')']))}] ELSE [] END, lambda x: x IS NOT NULL AND trim(x) <> trim(child_text)) AS parts FROM an),
rt AS (SELECT *, list_reduce(list_transform(parts, lambda x: {{'s': {WP.format('x')}, 'l': [x]}}), lambda a, x: CASE WHEN a.s + x.s <= 220 THEN {{'s': a.s + x.s, 'l': list_concat(a.l, x.l)}} ELSE a END, {{'s': {WP.format('child_text')}, 'l': CAST([] AS VARCHAR[])}}) AS k FROM pt)"""


def _blocks(t: Tables) -> DataFrame:
    return typed(t)


@query(f"WITH {PARENT_SQL} SELECT doc_id, block_order, parent_id, strategy, n_blocks::INT AS n_blocks, relation_types, sha256(content) AS content_hash, greatest(1, {WP.format('content')})::INT AS words, CASE WHEN greatest(1, {WP.format('content')}) <= 440 THEN 'metadata' ELSE 'store' END AS available, {CUT.format(WS.format('content'), 240)} AS preview FROM pa")
def parent_assembly(t: Tables) -> DataFrame:
    blocks = _blocks(t)
    found = assembly.parents(assembly.source_blocks(blocks), graph.relations(blocks))
    return found.select("doc_id", "block_order", "parent_id", "strategy", F.size("block_ids").alias("n_blocks"), F.array_join("relation_types", ",").alias("relation_types"), "content_hash", "words", "available", "preview")


@query(
    f"""WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, block_order, child_index, child_count, 'chunk-' || left(sha1(doc_id || ':' || block_id || ':' || parent_id || ':' || child_index || ':' || left(sha1(child_text), 12)), 20) AS chunk_id, parent_id, clause_id,
    array_to_string(list_append(k.l, child_text), chr(10)) AS retrieval_text, CASE WHEN len(k.l) = 0 THEN 'original' WHEN block_type IN ('table', 'image', 'formula') THEN block_type || '_enhanced' ELSE 'regulation_enhanced' END AS retrieval_strategy FROM rt"""
)
def chunk_documents(t: Tables) -> DataFrame:
    blocks = _blocks(t)
    targets = graph.caption_targets(blocks)
    found = assembly.chunks(graph.captioned(blocks, targets).withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))), graph.relations(blocks))
    return found.select("doc_id", "block_order", "child_index", "child_count", "chunk_id", "parent_id", "anchors.clause_id", "retrieval_text", "retrieval_strategy")

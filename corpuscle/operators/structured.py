"""JSON and CSV texts into paths, tables and typed blocks, and the choice of a parser by source type.

JSON is taken apart one level at a time: a level's containers become rows of their entries, in the order in which they
stand, until no container is left - as many small jobs as the deepest text has levels, each written as a table.  Values
keep their JSON text from level to level; what kind of value each is comes from its variant.  A text that isn't JSON, or
has an object with the same key twice, has no paths.

CSV is told into cells by one pattern over the text - quoted cells with doubled quotes and line ends inside, or plain
ones - whose delimiters become marks to split by, so no character is looked at in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import clean_ingest, let, strip
from corpuscle.sources.tables import saved

from . import blocks as lines
from .markup import html_blocks, linearize_rows

#: A cell and the delimiter after it; the text ends with a line end.
CELL = r'((?:"(?:[^"]|"")*+"[^,\n]*+|[^,\n]*+))(,|\n)'
_NEXT, _END = "\u0001", "\u0002"


def _level(rows: DataFrame) -> DataFrame:
    """Entries of containers: doc_id, ord, path, key, raw, kind of each.  rows: doc_id, ord, path, raw (a container's JSON)."""
    is_object = F.ltrim("raw").startswith("{")
    keys = F.when(is_object, F.map_keys(F.from_json("raw", "map<string,string>")))
    texts = F.when(is_object, F.map_values(F.from_json("raw", "map<string,string>"))).otherwise(F.from_json("raw", "array<string>"))
    kinds = F.transform(F.when(is_object, F.map_values(F.from_json("raw", "map<string,variant>"))).otherwise(F.from_json("raw", "array<variant>")), lambda v: F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0))
    entries = rows.select("doc_id", "ord", "path", keys.alias("keys"), texts.alias("texts"), kinds.alias("kinds")).where("texts is not null and kinds is not null")
    entries = entries.select("doc_id", "ord", "path", "keys", F.posexplode(F.arrays_zip("texts", "kinds")).alias("i", "v"))
    key = F.get("keys", F.col("i"))
    step = F.when(key.isNull(), F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))).when(F.col("path") == "", key).otherwise(F.concat(F.lit("."), key))
    return entries.select("doc_id", F.concat("ord", F.array("i")).alias("ord"), F.concat("path", step).alias("path"), key.alias("key"), F.col("v.texts").alias("raw"), F.col("v.kinds").alias("kind"))


def scalar_text(raw: Column, kind: Column, null: str = "") -> Column:
    """A value as text: null as given, True and False by name, texts and numbers as they are, containers as JSON."""
    return F.when(kind == "VOID", null).when(kind == "BOOLEAN", F.initcap(raw)).otherwise(raw)


def _start(docs: DataFrame, text: str) -> DataFrame:
    raw = strip(F.col(text).cast("string"))
    return docs.select("doc_id", F.array().cast("array<int>").alias("ord"), F.lit("").alias("path"), raw.alias("raw")).where(F.col("raw").rlike(r"^[{\[]"))


def json_paths(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ord, path, value: every scalar of each text under its path like a.b[0]; ord sorts as the text does."""
    level, found = _start(docs, text), []
    while True:
        entries = saved(_level(level), "json")
        inner = F.col("kind").isin("OBJECT", "ARRAY")
        found.append(entries.where(~inner).select("doc_id", "ord", "path", scalar_text(F.col("raw"), F.col("kind"), "None").alias("value")))
        level = entries.where(inner).select("doc_id", "ord", "path", "raw")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def json_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text: path=value lines of each text that is a JSON container."""
    rows = json_paths(docs, text).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat("path", F.lit("="), "value").alias("line")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def is_object_list(raw: Column) -> Column:
    """A JSON array that isn't empty and holds objects only."""
    items = F.from_json(raw, "array<variant>")
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT")), F.lit(False))


def _object_table(raw: Column) -> Column:
    """Headers (the first object's keys) and rows of a list of objects."""
    cell = lambda t, v: scalar_text(t, F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0))
    parts = F.struct(F.from_json(raw, "array<map<string,string>>").alias("t"), F.from_json(raw, "array<map<string,variant>>").alias("v"))

    def shape(p: Column) -> Column:
        heads = F.map_keys(p["t"][0])
        return let(heads, lambda h: F.struct(h.alias("headers"), F.zip_with(p["t"], p["v"], lambda t, v: F.transform(h, lambda k: F.coalesce(cell(t[k], v[k]), F.lit("")))).alias("rows")))

    return let(parts, shape)


_BLOCK = ["doc_id", "ord", "block_type", "text", "heading_level", "section_path", "parser_block_id", "table_headers", "table_row_count"]


def _blocks(rows: DataFrame, kind: Column, text: Column, path: Column, table: bool = False) -> DataFrame:
    rows = rows.withColumn("section", path)
    rows = rows.withColumn("cells", _object_table(F.col("raw"))) if table else rows
    null = F.lit(None)
    heads, count = (F.array_join("cells.headers", ", "), F.size("cells.rows")) if table else (null.cast("string"), null.cast("int"))
    said = linearize_rows(F.col("cells.headers"), F.col("cells.rows")) if table else text
    level = F.when(kind == "section_header", F.size("section"))
    return rows.select("doc_id", "ord", kind.alias("block_type"), said.alias("text"), level.alias("heading_level"), F.col("section").alias("section_path"), F.coalesce(F.nullif("path", F.lit("")), F.lit("root")).alias("parser_block_id"), heads.alias("table_headers"), count.alias("table_row_count"))


def json_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, block_order, block_type, text, heading_level, section_path, parser_block_id, table_headers, table_row_count, title.

    A list of objects is one table; an object gives, in its order, a header and the blocks of each object in it, a table
    of each list of objects, a list of each other list that isn't empty, and a paragraph path=value of each scalar.  A
    text that is neither is one paragraph.
    """
    title = F.col("title").cast("string") if "title" in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", title.alias("title"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"))
    own = F.array_compact(F.array(F.nullif("title", F.lit(""))))
    parsed = F.schema_of_variant(F.try_parse_json("raw"))
    docs = docs.withColumn("kind", F.regexp_extract(F.coalesce(parsed, F.lit("STRING")), "^[A-Z]+", 0)).withColumn("raw", F.when(F.col("kind").isin("OBJECT", "ARRAY"), strip("raw")).otherwise(F.col("raw")))
    docs = saved(docs.select("doc_id", F.array().cast("array<int>").alias("ord"), F.lit("").alias("path"), own.alias("section_path"), "raw", "kind", is_object_list(F.col("raw")).alias("table")), "json")
    whole = docs.where("kind <> 'OBJECT' and not table")
    # a text that is one string, number or list is shown as it stands, a string without its quotes
    plain = F.when((F.col("kind") == "STRING") & F.ltrim("raw").startswith('"'), F.coalesce(F.expr("cast(try_parse_json(raw) as string)"), F.col("raw"))).otherwise(scalar_text(strip("raw"), F.col("kind")))
    found = [_blocks(docs.where("table"), F.lit("table"), F.col("raw"), F.col("section_path"), table=True), _blocks(whole, F.lit("paragraph"), plain, F.col("section_path"))]
    level = docs.where("kind = 'OBJECT'")
    while not level.isEmpty():
        sections = level.select("doc_id", F.col("ord").alias("above"), "section_path")
        entries = _level(level.select("doc_id", "ord", "path", "raw")).withColumn("above", F.slice("ord", 1, F.size("ord") - 1)).join(sections, ["doc_id", "above"])
        entries = saved(entries.withColumn("table", (F.col("kind") == "ARRAY") & is_object_list(F.col("raw"))), "json")
        below = F.concat("section_path", F.array("key"))
        items = F.zip_with(F.from_json("raw", "array<string>"), F.from_json("raw", "array<variant>"), lambda t, v: F.concat(F.lit("- "), scalar_text(t, F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0))))
        listed = entries.where("kind = 'ARRAY' and not table").where(F.size(F.from_json("raw", "array<variant>")) > 0)
        scalars = entries.where("kind not in ('OBJECT', 'ARRAY')")
        found += [
            _blocks(entries.where("kind = 'OBJECT'"), F.lit("section_header"), F.col("key"), below), _blocks(entries.where("table"), F.lit("table"), F.col("raw"), below, table=True),
            _blocks(listed, F.lit("list"), F.array_join(items, "\n"), below), _blocks(scalars, F.lit("paragraph"), F.concat("path", F.lit("="), scalar_text(F.col("raw"), F.col("kind"))), F.col("section_path")),
        ]
        level = entries.where("kind = 'OBJECT'").select("doc_id", "ord", "path", below.alias("section_path"), "raw")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return reduce(DataFrame.unionByName, found).withColumn("block_order", order).drop("ord")


def csv_rows(text) -> Column:
    """Rows of cells.  A line end inside quotes joins what it parts; a quote inside a plain cell stands for itself; an empty line is a row without cells."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    quoted = lambda c: F.concat(F.replace(F.replace(F.regexp_extract(c, r'^"((?:[^"]|"")*+)"', 1), F.lit('""'), F.lit('"')), F.lit("\n"), F.lit("")), F.regexp_replace(c, r'^"(?:[^"]|"")*+"', ""))
    plain = lambda c: F.when(c.startswith('"'), quoted(c)).otherwise(c)
    told = F.zip_with(F.regexp_extract_all(t, F.lit(CELL), F.lit(1)), F.regexp_extract_all(t, F.lit(CELL), F.lit(2)), lambda c, d: F.concat(F.translate(plain(c), _NEXT + _END, ""), F.when(d == ",", _NEXT).otherwise(_END)))
    rows = F.split(F.regexp_replace(F.array_join(told, ""), f"{_END}$", ""), _END)
    cells = F.transform(rows, lambda r: F.when(r == "", F.array().cast("array<string>")).otherwise(F.split(r, _NEXT)))
    return F.when(F.regexp_replace(text, r"[\r\n]", "") == "", F.array().cast("array<array<string>>")).otherwise(cells)


def csv_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One table block a text: its first row are the headers.  A null or blank text has no block."""
    title = F.col("title").cast("string") if "title" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", title.alias("title"), csv_rows(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("rows")).where(F.size("rows") > 0)
    heads, data = F.get("rows", F.lit(0)), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    rows = rows.select("doc_id", "title", heads.alias("headers"), data.alias("data"))
    return rows.select("doc_id", F.lit(0).alias("block_order"), F.lit("table").alias("block_type"), linearize_rows(F.col("headers"), F.col("data")).alias("text"), F.array_compact(F.array(F.nullif("title", F.lit("")))).alias("section_path"), F.array_join("headers", ", ").alias("table_headers"), F.size("data").alias("table_row_count"))


def document_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts of any type: doc_id, source_type, block_order, block_type, text, heading_level, section_path, table_headers, table_row_count, parser.

    docs: doc_id, source_type, text, and title where there is one.  csv and json go to their parsers; web, markdown and
    word texts with markup are read as HTML, and line by line if that finds no block; all others line by line.
    """
    title = F.col("title").cast("string") if "title" in docs.columns else F.lit(None).cast("string")
    docs = saved(docs.select("doc_id", "source_type", title.alias("title"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "sources")
    kind = F.col("source_type")
    markup = kind.isin("web", "markdown", "word") & F.contains("text", F.lit("<")) & F.contains("text", F.lit(">"))
    from_html = saved(html_blocks(docs.where(markup).withColumnRenamed("text", "html")), "html")
    told = docs.where(~kind.isin("csv", "json") & ~markup).unionByName(docs.where(markup).join(from_html.select("doc_id").distinct(), "doc_id", "left_anti"))
    from_lines = lines.blocks(told.select("doc_id", clean_ingest("text").alias("text")))
    every = [(csv_blocks(docs.where(kind == "csv")), "csv"), (json_blocks(docs.where(kind == "json")), "json"), (from_html, "html"), (from_lines, "text")]
    names = {"heading_level": "int", "section_path": "array<string>", "table_headers": "string", "table_row_count": "int"}
    same = [d.select("doc_id", F.col("block_order").cast("int"), "block_type", "text", *(F.col(n).cast(t).alias(n) if n in d.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()), F.lit(p).alias("parser")) for d, p in every]
    return reduce(DataFrame.unionByName, same).join(docs.select("doc_id", "source_type"), "doc_id")

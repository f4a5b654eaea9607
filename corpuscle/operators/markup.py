"""HTML into typed blocks.

A small parser task turns each page into its strings and its elements, in document order: an element knows its parent,
its last descendant and the strings inside it.  All that follows - texts, types, lists, tables, section paths - is column
work on those arrays.  An element within another is a block of its own, and its strings are in both.

Pages: doc_id, html, and title where there is one.  Null or empty html has no blocks.  Unclosed elements end with the one
around them, end tags without an open element are passed over; no stack is searched and nothing recurses, so deep and
broken pages take time in proportion to what they hold.  Strings of scripts, styles and templates are left out.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import clean_ingest, let, strip

# The elements that are blocks, and what a caption or a formula looks like.
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "code", "ul", "ol", "table", "img", "figure", "figcaption", "math")
CAPTION_LINE = r"(?iU)^(?:(?:caption:\s*)?(figure|fig\.|table|image|equation|formula|eq\.|图|图片|表|公式)\s*(\d+)?)\s*[:.\-]\s*(.+)$"
FORMULA_START = r"^(?:\$\$|\\\[|\\\()"
FORMULA_SYMBOL = r"\\sum|\\int|\\frac|\\sqrt|<=|>=|==|!=|=|\^|_|\+|-"
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT, KEPT_SPACE = frozenset({"script", "style", "template"}), frozenset({"pre", "textarea"})
PARTS = frozenset({*BLOCK_TAGS, "li", "tr", "td", "th", "body"})
ELEMENTS = "array<struct<tag:string,parent:int,last:int,first:int,size:int,alt:string,src:string,title:string>>"


class Elements(HTMLParser):
    """Strings of a page, and its elements as [tag, parent, last, first, size, alt, src, title]; numbers from 0."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.elements: list[list] = []
        self.stack: list[tuple[str, int]] = []  # tag, number of the element or -1
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        while self.stack:
            self._pop()

    def _flush(self) -> None:
        if self.text:
            s, self.text = "".join(self.text), []
            if any(self.open[t] for t in SILENT):
                return
            if not s.strip(" \t\n\r\f\v") and not any(self.open[t] for t in KEPT_SPACE):
                s = "\n" if "\n" in s else " "
            self.strings.append(s)

    def _pop(self) -> None:
        tag, i = self.stack.pop()
        self.open[tag] -= 1
        if i >= 0:
            e = self.elements[i]
            e[2], e[4] = len(self.elements) - 1, len(self.strings) - e[3]

    def handle_starttag(self, tag, attrs):
        self._flush()
        i = -1
        if tag in PARTS:
            i = len(self.elements)
            found = {}
            for k, v in attrs:
                found[k] = v or ""
            self.elements.append([tag, self.stack[-1][1] if self.stack else -1, i, len(self.strings), 0, *(found.get(k) if tag == "img" else None for k in ("alt", "src", "title"))])
        self.stack.append((tag, i))
        self.open[tag] += 1
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def page_elements(html: str | None) -> tuple[list[str], list[dict]]:
    """Strings and elements of the page's body, or of all of it where there is none."""
    page = Elements(html or "")
    body = next((i for i, e in enumerate(page.elements) if e[0] == "body"), -1)
    end = page.elements[body][2] + 1 if body >= 0 else len(page.elements)
    names = ("tag", "parent", "last", "first", "size", "alt", "src", "title")
    return page.strings, [dict(zip(names, e if i > body else [None, *e[1:]], strict=True)) for i, e in enumerate(page.elements[:end])]


def dom(pages: DataFrame) -> DataFrame:
    """doc_id, title, strings, elements; elements before and of the body have a tag that no block has."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                batch = whole.slice(at, 32)
                found = [page_elements(h) for h in batch.column(2).to_pylist()]
                kind = pa.list_(pa.struct([("tag", pa.string()), *((n, pa.int32()) for n in ("parent", "last", "first", "size")), *((n, pa.string()) for n in ("alt", "src", "title"))]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], kind)], ["doc_id", "title", "strings", "elements"])

    title = F.col("title").cast("string") if "title" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("doc_id", title.alias("title"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, title string, strings array<string>, elements {ELEMENTS}")


def looks_like_formula(c: Column) -> Column:
    """Starts as a formula does, or has two symbols or more and few words beside them."""
    symbols, words = F.regexp_count(c, F.lit(FORMULA_SYMBOL)), F.regexp_count(c, F.lit("[A-Za-z一-鿿]+"))
    return (c != "") & (c.rlike(FORMULA_START) | ((symbols >= 2) & (words <= F.greatest(F.lit(2), F.floor(symbols / 2)))))


def linearize_rows(headers: Column, rows: Column) -> Column:
    """Table columns: a, b / Row i: a=x; b=y - blank cells and headers go, rows without any as well; cells beyond the headers aren't shown."""
    pair = lambda h, v: F.when((strip(h) != "") & (strip(F.coalesce(v, F.lit(""))) != ""), F.concat(h, F.lit("="), strip(v)))
    cells = lambda r: F.array_join(F.array_compact(F.zip_with(headers, F.slice(r, 1, F.size(headers)), pair)), "; ")
    lines = F.transform(rows, lambda r, i: F.when(cells(r) != "", F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), cells(r))))
    top = F.when(F.size(headers) > 0, F.concat(F.lit("Table columns: "), F.array_join(headers, ", "))).otherwise("Table")
    return F.array_join(F.concat(F.array(top), F.array_compact(lines)), "\n")


def image_text(alt: Column, source: Column, title: Column) -> Column:
    line = lambda label, v: F.when(v != "", F.concat(F.lit(f"{label}: "), v))
    return F.concat_ws("\n", F.lit("Image block"), line("Alt", alt), line("Source", source), line("Title", title))


def update_path(path: Column, level: Column, title: Column) -> Column:
    """The headings in force after one: level 1 starts anew, others keep the first level - 1."""
    return F.when(level <= 1, F.array(title)).otherwise(F.concat(F.slice(path, 1, F.least(level - 1, F.size(path))), F.array(title)))


def _said(e: Column, between: str) -> Column:
    return clean_ingest(F.array_join(F.slice(F.col("strings"), e["first"] + 1, e["size"]), between))


def _inside(e: Column, i: Column) -> Column:
    """The descendants of element i, which follow it."""
    return F.slice(F.col("elements"), i + 2, e["last"] - i)


def _list_text(e: Column, i: Column) -> Column:
    items = F.filter(_inside(e, i), lambda x: (x["tag"] == "li") & (x["parent"] == i))
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), _said(x, " "))), "\n")


def _table(e: Column, i: Column) -> Column:
    """Headers and rows of a table: its th cells, and the cells of each tr; the first row goes if it is the headers."""
    cell = lambda x: _said(x, " ")
    rows = F.transform(_inside(e, i), lambda x, k: F.when(x["tag"] == "tr", F.transform(F.filter(_inside(x, i + 1 + k), lambda y: y["tag"].isin("td", "th")), cell)))
    heads = F.transform(F.filter(_inside(e, i), lambda x: x["tag"] == "th"), cell)

    def shape(s: Column) -> Column:
        h, r = s["h"], s["r"]
        named = F.when((F.size(h) == 0) & (F.size(r) > 0), F.transform(r[0], lambda _, k: F.concat(F.lit("column_"), (k + 1).cast("string")))).otherwise(h)
        return F.struct(named.alias("headers"), F.when((F.size(h) > 0) & (F.size(r) > 0) & (F.try_element_at(r, F.lit(1)) == h), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r).alias("rows"))

    return let(F.struct(heads.alias("h"), F.filter(rows, lambda r: r.isNotNull() & (F.size(r) > 0)).alias("r")), shape)


def html_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, block_order, block_type, text, heading_level, section_path, layout_role, title, caption_text, image_alt_text, image_source, image_title, table_headers, table_row_count."""
    tag = lambda e: e["tag"]
    rows = dom(pages)
    # each block's own text first; what a list, a table or an image says instead is found where it is one
    numbered = F.transform("elements", lambda e, i: F.when(tag(e).isin(*BLOCK_TAGS), F.struct(i.alias("i"), e.alias("e"), _said(e, "\n").alias("said"))))
    rows = rows.select("doc_id", "title", "strings", "elements", F.filter(F.array_compact(numbered), lambda b: (b["said"] != "") | (b["e"]["tag"] == "img")).alias("b"))
    level = lambda e: F.when(tag(e).rlike("^h[1-6]$"), F.substring(tag(e), 2, 1).cast("int"))
    heads = F.array_compact(F.transform("b", lambda b, k: F.when(level(b["e"]).isNotNull(), F.struct(k.alias("at"), level(b["e"]).alias("level"), b["said"].alias("said")))))
    root = F.array_compact(F.array(F.nullif("title", F.lit(""))))
    last = lambda a: F.element_at(a, -1)
    paths = F.aggregate("heads", F.array(root), lambda a, h: F.concat(a, F.array(update_path(last(a), h["level"], h["said"]))))
    # each path holds from its heading to the next
    ends = F.concat(F.transform("heads", lambda h: h["at"]), F.array(F.size("b")))
    spread = let(ends, lambda at: F.flatten(F.transform("paths", lambda p, k: F.array_repeat(p, at[k] - F.when(k > 0, F.get(at, k - 1)).otherwise(0)))))
    rows = rows.withColumn("heads", heads).withColumn("paths", paths).withColumn("paths", spread)

    def kind(b: Column) -> Column:
        t, said = b["e"]["tag"], b["said"]
        return (
            F.when(level(b["e"]).isNotNull(), "section_header").when(t.isin("pre", "code"), "code").when(t.isin("ul", "ol"), "list").when(t == "table", "table").when(t == "img", "image").when(t == "figcaption", "caption")
            .when((t == "math") | looks_like_formula(said), "formula").when(said.rlike(CAPTION_LINE), "caption").otherwise("paragraph")
        )

    def typed(b: Column, path: Column) -> Column:
        e, i = b["e"], b["i"]

        def told(x: Column) -> Column:
            text = F.when(x["kind"] == "list", _list_text(e, i)).when(x["kind"] == "table", linearize_rows(x["cells"]["headers"], x["cells"]["rows"])).when(x["kind"] == "image", image_text(e["alt"], e["src"], e["title"])).otherwise(b["said"])
            named = {n: e[n] for n in ("alt", "src", "title")} | {"said": b["said"], "level": level(e), "path": path, "headers": F.array_join(x["cells"]["headers"], ", "), "n_rows": F.size(x["cells"]["rows"])}
            return F.struct(x["kind"].alias("kind"), text.alias("text"), *(c.alias(n) for n, c in named.items()))

        return let(F.struct(kind(b).alias("kind"), F.when(tag(e) == "table", _table(e, i)).alias("cells")), told)

    # arrays of a page stay in one row until its blocks are whole, so no block carries its page and none is shuffled
    blocks = F.filter(F.zip_with("b", "paths", typed), lambda x: x["text"] != "")
    rows = rows.select("doc_id", F.col("title").alias("page_title"), F.posexplode(blocks).alias("block_order", "block")).select("doc_id", "page_title", "block_order", "block.*")
    caption, table = F.col("kind") == "caption", F.col("kind") == "table"
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "doc_id", "block_order", F.col("kind").alias("block_type"), "text", F.col("level").alias("heading_level"), F.col("path").alias("section_path"), F.when(caption, "caption").otherwise("body").alias("layout_role"), F.col("page_title").alias("title"),
        F.when(caption & F.col("said").rlike(CAPTION_LINE), F.col("said")).alias("caption_text"), filled("alt").alias("image_alt_text"), filled("src").alias("image_source"), filled("title").alias("image_title"),
        F.when(table, F.col("headers")).alias("table_headers"), F.when(table, F.col("n_rows")).alias("table_row_count"),
    )

"""Blocks of HTML, JSON and CSV against plain versions."""

import csv
import json
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions.text import clean_ingest
from corpuscle.operators import assembly, graph, markup, structured

rng = np.random.default_rng(11)


def plain_clean(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"(?<=\w)-\n(?=\w)", "", t).replace(" ", " ").replace("\t", "    ")
    out, blank, code = [], 0, False
    for line in t.split("\n"):
        line, s = line.rstrip(), line.strip()
        if s.startswith(("```", "~~~")):
            code, blank = not code, 0
            out.append(s)
        elif not s:
            blank += 1
            if blank <= 2:
                out.append("")
        else:
            blank = 0
            lead = line[: len(line) - len(line.lstrip())]
            out.append(line if code or re.match(r"^\|.*\|$", s) else lead + re.sub(" {2,}", " ", line[len(lead) :]))
    return "\n".join(out).strip()


def test_clean_ingest(spark):
    bits = ["a", "  ", "\n", "\t", "-\n", "```", "~~~", "|", "| x   y |", " ", "é", "\r\n", " ", " b", "\n\n\n\n", "word"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(600)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).sortWithinPartitions("i").select(clean_ingest("t")).collect()]
    for t, g in zip(texts, got, strict=True):
        assert g == plain_clean(t), repr(t)


class Node:
    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.up, self.kids = tag, dict(attrs), up, []


class Tree(HTMLParser):
    """A tree of nodes and strings, as a reader that closes what is open at an end tag builds it."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.said = ""
        self.feed(html)
        self.close()
        self.end()

    def end(self):
        if self.said:
            around, n = set(), self.at
            while n:
                around.add(n.tag)
                n = n.up
            if not around & {"script", "style", "template"}:
                blank = not self.said.strip(" \t\n\r\f\v") and not around & {"pre", "textarea"}
                self.at.kids.append(("\n" if "\n" in self.said else " ") if blank else self.said)
        self.said = ""

    def handle_starttag(self, tag, attrs):
        self.end()
        node = Node(tag, [(k, v or "") for k, v in attrs], self.at)
        self.at.kids.append(node)
        if tag not in markup.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in markup.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end()
        n = self.at
        while n and n.tag != tag:
            n = n.up
        if n and n.tag:
            self.at = n.up

    def handle_data(self, data):
        self.said += data

    def handle_comment(self, data):
        self.end()

    handle_decl = handle_pi = unknown_decl = handle_comment


def walk(n):
    for k in n.kids:
        if isinstance(k, Node):
            yield k
            yield from walk(k)


def strings(n):
    for k in n.kids:
        if isinstance(k, Node):
            yield from strings(k)
        else:
            yield k


def rows_text(heads, rows):
    out = ["Table columns: " + ", ".join(heads)] if heads else ["Table"]
    for i, r in enumerate(rows, 1):
        cells = [f"{h}={v.strip()}" for h, v in zip(heads, r + [""] * (len(heads) - len(r))) if h.strip() and v.strip()]
        if cells:
            out.append(f"Row {i}: " + "; ".join(cells))
    return "\n".join(out)


def formula(t):
    n, w = len(re.findall(markup.FORMULA_SYMBOL, t)), len(re.findall("[A-Za-z一-鿿]+", t))
    return bool(t) and (t.startswith(("$$", "\\[", "\\(")) or n >= 2 and w <= max(2, n // 2))


def plain_html(html, title=None):
    root = Tree(html or "").root
    body = next((n for n in walk(root) if n.tag == "body"), root)
    said = lambda n, between="\n": plain_clean(between.join(strings(n)))
    path, out = [title] if title else [], []
    for n in walk(body):
        if n.tag not in markup.BLOCK_TAGS or not (text := said(n)) and n.tag != "img":
            continue
        kind, level = "paragraph", None
        if re.match("h[1-6]$", n.tag):
            kind, level = "section_header", int(n.tag[1])
            path = [text] if level <= 1 else [*path[: level - 1], text]
        elif n.tag in ("pre", "code"):
            kind = "code"
        elif n.tag in ("ul", "ol"):
            kind, text = "list", "\n".join("- " + said(k, " ") for k in n.kids if isinstance(k, Node) and k.tag == "li")
        elif n.tag == "table":
            heads = [said(x, " ") for x in walk(n) if x.tag == "th"]
            rows = [r for r in ([said(x, " ") for x in walk(t) if x.tag in ("td", "th")] for t in walk(n) if t.tag == "tr") if r]
            if heads and rows and rows[0] == heads:
                rows = rows[1:]
            elif not heads and rows:
                heads = [f"column_{i + 1}" for i in range(len(rows[0]))]
            kind, text = "table", rows_text(heads, rows)
        elif n.tag == "img":
            kind, text = "image", "\n".join(["Image block", *(f"{a}: {n.attrs[k]}" for a, k in (("Alt", "alt"), ("Source", "src"), ("Title", "title")) if n.attrs.get(k))])
        elif n.tag == "figcaption":
            kind = "caption"
        elif n.tag == "math" or formula(text):
            kind = "formula"
        elif re.match(markup.CAPTION_LINE.replace("(?iU)", "(?i)"), text):
            kind = "caption"
        if text:
            out.append((len(out), kind, text, level, path))
    return out


def html_rows(df):
    out = {}
    for r in df.orderBy("doc_id", "block_order").collect():
        out.setdefault(r.doc_id, []).append((r.block_order, r.block_type, r.text, r.heading_level, r.section_path))
    return out


PAGES = [
    "<html><body><h1>Guide</h1><p>Figure 1 shows the flow.</p><img src='arch.png' alt='Architecture'/><figcaption>Figure 1. Request flow</figcaption><math>E = mc^2</math></body></html>",
    None, "", "no tags", "<p>", "<h2>a</h2><h4>b</h4><h3>c</h3><p>x</p><h1>d</h1><p>y<p>z</p>", "<ul><li>a<li>b<ul><li>c</li></ul></li></ul><ol></ol><ol>text only</ol>",
    "<table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td></td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table><table></table><table><tr><td>p</td><td>q</td></tr></table>",
    "<body><pre>  a\n   b  c</pre><p>a &amp; b &lt;c&gt; &nbsp; &#233;</p><script>var x='<p>no</p>';</script><style>p{}</style><template><p>t</p></template><!-- <p>c</p> --><p>Table 2: sizes</p><p>x = y + z</p></body><p>after</p>",
    "</p></div><p>a<br>b<br/>c</p><p/>d<figure><img title=t><p>in</p></figure><IMG ALT=''>", "<h1></h1><h7>x</h7><p>  \n </p>", "<p a='" + "x" * 1000 + "'>long</p>",
]


def test_html_blocks(spark):
    bits = ["<p>", "</p>", "<h1>", "</h1>", "<h3>", "</h3>", "<ul>", "</ul>", "<li>", "</li>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "text", " more  words", "\n", "<b>", "</b>", "<br>", "<img src=a>", "x=1+2", "<pre>", "</pre>", "<body>", "</body>", "<div>", "</div>", "Figure 3: cap"]
    pages = PAGES + ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(300)]
    rows = [(i, h, "Root" if i % 2 else None) for i, h in enumerate(pages)]
    got = html_rows(markup.html_blocks(spark.createDataFrame(rows, "doc_id long, html string, title string")))
    for i, h, title in rows:
        assert got.get(i, []) == plain_html(h, title), h
    assert markup.html_blocks(spark.createDataFrame([], "doc_id long, html string")).count() == 0


def test_html_blocks_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), "html", F.parse_url("url", F.lit("HOST")).alias("title"))
    got = html_rows(markup.html_blocks(pages))
    for r in pages.collect():
        assert got.get(r.doc_id, []) == plain_html(r.html, r.title)


def test_deep_and_broken_pages():
    deep = markup.page_elements("<div>" * 300_000 + "<p>x" + "</span>" * 100_000)
    assert deep[0] == ["x"] and [e["tag"] for e in deep[1]] == ["p"]


JSONS = [
    '{"a": {"b": [1, 2, {"c": null}], "z": true}, "t": "x\\ny", "e": {}, "l": [], "u": "é", "": "blank"}', "[]", "{}", '[{"name":"top_k","value":4},{"value":"x","more":1}]', '[1, [2, {"k": [false]}]]', '"just text"', "12", "not json {", None, "", " \n{\"s\": \"{\\\"a\\\": 1}\"}",
    '{"rows": [{"a": 1, "b": null}, {"a": true}], "tags": ["x", null, 3, {"k": [1]}], "deep": {"er": {"est": 0.5}}, "m": [{"a": 1}, 2]}', "[" * 30 + "7" + "]" * 30,
]


def flat(v, at=""):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in flat(w, f"{at}.{k}" if at else k)]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in flat(w, f"{at}[{i}]")]
    return [(at, str(v))]


def parsed(t):
    try:
        return json.loads(t or "")
    except ValueError:
        return t or ""


def test_json_paths(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(JSONS)], "doc_id long, text string, path string")
    got = {}
    for r in structured.json_paths(docs).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.path, r.value))
    assert got == {i: f for i, t in enumerate(JSONS) if isinstance(v := parsed(t), dict | list) and (f := flat(v))}
    lines = {r.doc_id: r.text for r in structured.json_lines(docs).collect()}
    assert lines[0].startswith("a.b[0]=1\na.b[1]=2\na.b[2].c=None\na.z=True\nt=x\ny")
    assert structured.json_paths(docs.limit(0)).count() == 0


def test_json_blocks(spark):
    docs = spark.createDataFrame([(i, t, "T" if i % 2 else None) for i, t in enumerate(JSONS)], "doc_id long, text string, title string")
    show = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, dict | list) else "" if v is None else str(v)
    table = lambda v: ("table", rows_text(list(v[0]), [[show(x.get(h)) for h in v[0]] for x in v]))
    objects = lambda v: isinstance(v, list) and v and all(isinstance(x, dict) for x in v)

    def walk(v, at, path):
        for k, w in v.items():
            here = f"{at}.{k}" if at else k
            if isinstance(w, dict):
                yield "section_header", k, [*path, k]
                yield from walk(w, here, [*path, k])
            elif objects(w):
                yield *table(w), [*path, k]
            elif isinstance(w, list):
                if w:
                    yield "list", "\n".join(f"- {show(x)}" for x in w), [*path, k]
            else:
                yield "paragraph", f"{here}={show(w)}", path

    got = {}
    for r in structured.json_blocks(docs).orderBy("doc_id", "block_order").collect():
        got.setdefault(r.doc_id, []).append((r.block_type, r.text, r.section_path))
    for i, t in enumerate(JSONS):
        path, v = ["T"] if i % 2 else [], parsed(t)
        want = [(*table(v), path)] if objects(v) else list(walk(v, "", path)) if isinstance(v, dict) else [("paragraph", re.sub(r",(?! )", ",", show(v)), path)]
        have = got.get(i, [])
        if isinstance(v, list) and not objects(v):
            have = [(k, json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":")), p) for k, x, p in have]
        assert have == want, t


CSVS = ["metric,value\ntop_k,4\n", "", None, "\n\n", "a,b", 'a,"b\nc",d\n1,"x ""q"" y",3\n,,\n\n"z"w,2\n', 'x"y,2\r\n"",3\r\n', "h1,h2,h3\n1\n1,2,3,4\n", 'a\n"' + "x" * 100_000 + '""' * 3000 + '"\n']


def test_csv_blocks(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(CSVS)], "doc_id long, text string, rows string")
    got = {r.doc_id: (r.text, r.table_row_count) for r in structured.csv_blocks(docs).collect()}
    for i, t in enumerate(CSVS):
        rows = list(csv.reader((t or "").splitlines()))
        if any(rows):
            assert got[i] == (rows_text(rows[0], rows[1:]), len(rows) - 1), t
        else:
            assert i not in got


def test_document_blocks(spark):
    rows = [(1, "csv", "a,b\n1,2", "C"), (2, "json", '{"k": 1}', None), (3, "web", "<p>hi</p>", "W"), (4, "markdown", "# T\n1 < 2 > 0\n\n- a\n- b", None), (5, "txt", "plain   text", None), (6, "web", None, None), (7, "word", "<b>x</b>", None)]
    got = {}
    for r in structured.document_blocks(spark.createDataFrame(rows, "doc_id long, source_type string, text string, title string")).orderBy("doc_id", "block_order").collect():
        got.setdefault(r.doc_id, []).append((r.parser, r.block_type, r.text))
    assert got == {
        1: [("csv", "table", "Table columns: a, b\nRow 1: a=1; b=2")], 2: [("json", "paragraph", "k=1")], 3: [("html", "paragraph", "hi")], 4: [("text", "section_header", "T"), ("text", "paragraph", "1 < 2 > 0"), ("text", "list", "- a\n- b")],
        5: [("text", "paragraph", "plain text")], 7: [("text", "paragraph", "<b>x</b>")],
    }


def test_blocks_of_a_page_need_no_shuffle(spark, sf_dir):
    plan = markup.html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("page_id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_children_carry_no_text_of_their_block(spark):
    rows = [(1, 0, "list", "\n".join(f"clause 1.{i} " + "w " * 30 for i in range(40)))]
    found = assembly.chunks(spark.createDataFrame(rows, "doc_id long, block_order int, block_type string, text string"), spark.createDataFrame([], "doc_id long, source int, target int, edge_type string, weight double"), 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode(children")[0]
    # only the child's own text meets the patterns of anchors above the rows of children
    assert "child_text#" in plan and not re.search(r"\b(text|content)#", plan)
    got = found.orderBy("child_index").collect()
    assert len(got) == 40 and [r.anchors.clause_id for r in got] == [f"1.{i}" for i in range(40)] and all(r.parent_content is None for r in got)


def test_captions_meet_blocks_once(spark):
    rows = [(1, 0, 1, "table", "Table 1 | a", ["T"]), (1, 1, 1, "caption", "Table 1: sizes", ["T"]), (1, 2, 1, "paragraph", "clause 3.2.1 as in Table 1", ["T"])]
    blocks = spark.createDataFrame(rows, "doc_id long, block_order int, page int, block_type string, text string, section_path array<string>")
    edges = graph.relations(blocks)
    show = lambda df: sorted((r.block_order, r.caption_text, r.retrieval_text, r.chunk_id) for r in df.collect())
    got = show(assembly.chunks(blocks, edges, captions=graph.captions(blocks)))
    assert got == show(assembly.chunks(graph.captioned(blocks), edges)) and got[0][1] == "Table 1: sizes"

"""The corpus operators on awkward rows and against brute force."""

import collections
import functools
import hashlib
import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm import bpe, license_scan, queries, substring_dedup, token_output
from corpuscle.llm.ann import nearest
from corpuscle.llm.components import connected_components
from corpuscle.llm.html_extract import extract, html_extract, infer, slim
from corpuscle.llm.language_id import accepted, identified, language_id
from corpuscle.llm.mixing import MIX_SQL, mix_schedule, mixed
from corpuscle.llm.ngram_join import ngram_jaccard_join, one_of_each, tree_join
from corpuscle.llm.perfect_hash import PerfectHash
from corpuscle.llm.quality_rules import POLICIES, ablations, apply_policy, rule_ledger
from corpuscle.llm.sketch import maybe_repeated, repeated_bits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(5)
WORDS = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
PASSAGE = " ".join(rng.choice(WORDS, 60))


def prose(n):
    return " ".join(rng.choice(WORDS, n))


@functools.cache
def awkward():
    base = prose(120)
    near = base.split()
    near[50] = "changed"
    rows = [
        (0, base, "en", "a", 1), (1, " ".join(near), "en", "a", 1), (2, base, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, base, "en", None, 3),
        (5, "  \t\n ", "de", "b", 1), (6, "Été à la plage\n" + PASSAGE, "fr", "c", 1), (7, prose(40) + "\n" + PASSAGE + "\n" + prose(30), "en", "c", 1), (8, "word " * 90, "en", "c", 1),
        (9, "x" * 5000, "en", "a", 1), (10, prose(6000), "en", "a", 1), (11, "one two", "en", "a", 1), (11, "one two", "en", "a", 1), (12, "12 34 !! ##", "en", "a", 1), (13, "ONE two", "de", "a", 1), (14, "日本語 テキスト", "ja", "d", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *(T.StructField(n, T.StringType()) for n in ("row", "score", "place", "d1", "gone_id", "starts", "key"))])
    return spark.createDataFrame([(*r, *["z"] * 7) for r in awkward()], schema)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    n = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window", [3, 35])
def test_substring_dedup(docs, window):
    want = [(r[0], *b) for r, b in zip(awkward(), brute_repeats([r[1] for r in awkward()], window))]
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs, window).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_without_repeats_keeps_rows_and_columns(docs, none):
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    r = got.where("doc_id = 7").first()
    assert PASSAGE not in r.text and r.n_chars == len(r.text)
    assert substring_dedup.without_repeats(none).count() == 0


def brute_links(rows, n, num, den):
    sets = {}
    for i, text in rows:
        if i is not None:
            w = (text or "").encode().lower().split()
            sets.setdefault(i, []).append(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(s and t and den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_ngram_join(spark, docs, n, num, den):
    rows = [(r[0], r[1]) for r in awkward()]
    got = ngram_jaccard_join(docs, n, (num, den)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_links(rows, n, num, den)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_ngram_join_near_copies(spark):
    local = np.random.default_rng(1)
    base = [str(x) for x in local.integers(0, 5000, 150)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in local.integers(0, 150, local.integers(0, 6)):
            w[at] = f"n{local.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_links(rows, 3, 9, 10)


def test_ngram_join_cuts_crowded_keys(spark, monkeypatch):
    from corpuscle.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CELL", 3)
    local = np.random.default_rng(4)
    base = [f"w{x}" for x in local.integers(0, 5000, 60)]
    rows = []
    for i in range(80):
        w = list(base)
        for at in local.integers(0, 60, local.integers(0, 5)):
            w[at] = f"v{at}x{local.integers(3)}"
        rows.append((i, " ".join(w)))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 2, (9, 10)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_links(rows, 2, 9, 10)


def test_one_of_each(docs, none):
    kept = [r.doc_id for r in one_of_each(docs).collect()]
    assert 0 in kept and 2 not in kept and 1 not in kept and None in kept
    assert one_of_each(docs).columns == docs.columns and one_of_each(none).count() == 0
    assert ngram_jaccard_join(none).count() == 0


def test_tree_join_loses_nothing():
    local = np.random.default_rng(2)
    points = local.poisson(4, (500, 64)).astype(np.uint32)
    points[250:] = points[:250] + (local.random((250, 64)) < 0.05)
    n = points.sum(axis=1).astype(np.int64)
    place, comp = np.zeros(500, np.int64), np.arange(500)
    i, j = tree_join(points, n, place, comp, 9, 10)
    low = np.minimum(points[:, None], points[None]).sum(axis=2)
    need = -(-9 * (n[:, None] + n[None]) // 19)
    want = {(a, b) for a, b in zip(*np.nonzero(low >= need)) if a < b}
    assert {(min(a, b), max(a, b)) for a, b in zip(i, j)} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 40), (41, 50), (7, 7), (None, 3)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 50: 40}


def test_sketch_never_calls_a_repeated_key_single(spark):
    keys = np.arange(50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = repeated_bits(spark.range(0, 2, 1, 2), lambda batch: iter([keys[: 30_000] if batch.column(0)[0].as_py() else keys[20_000:]]), 1 << 18)
    assert maybe_repeated(bits, keys[20_000:30_000]).all() and maybe_repeated(bits, keys).mean() < 0.5


def test_perfect_hash():
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    h = PerfectHash.from_bytes(PerfectHash.build(np.unique(keys)).to_bytes())
    assert sorted(h.number(np.unique(keys))) == list(range(len(np.unique(keys))))
    assert len(PerfectHash.build(keys[:0]).number(keys[:3])) == 3


def test_mixing(spark, docs, none):
    import duckdb
    import pandas as pd

    rows = mix_schedule(docs).collect()
    assert len(rows) == docs.count() and all(r.release <= r.slot < r.deadline for r in rows)
    assert mixed(docs).columns == docs.columns and mixed(docs).count() == docs.count()
    assert mixed(none).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mix_schedule(many, weights={"hot": 0.5, "s1": 0.25, "s2": 0.25}, block=4).toPandas()
    slots = got.where(got.in_mix).dropna().drop_duplicates(["source", "block"]).sort_values("slot")
    taken = collections.Counter()
    q = {s: (g.deadline.max(), g.block.max()) for s, g in got.groupby("source")}
    for s in slots.source:
        taken[s] += 1
    assert q and abs(taken["hot"] / len(slots) - 0.5) < 0.02
    frame = pd.DataFrame(many.toPandas())
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(MIX_SQL).df()
    mine = mix_schedule(many).toPandas()
    key = ["doc_id", "source", "block", "slot", "place"]
    assert mine[key].sort_values("doc_id").values.tolist() == want[key].sort_values("doc_id").values.tolist()


def test_mixing_deviation(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    weights = {"s0": 0.4, "s1": 0.3, "s2": 0.15, "s3": 0.1, "s4": 0.05}
    got = mix_schedule(many, weights, block=1).where("in_mix").toPandas().sort_values("slot")
    share = {s: (g.block.max() + 1) for s, g in got.groupby("source")}
    n, total = collections.Counter(), len(got)
    for i, s in enumerate(got.source, 1):
        n[s] += 1
        for k in weights:
            assert abs(n[k] - i * share[k] / total) < 1.01
    assert total > 1000


def test_language_id(spark, docs, none):
    rows = [(i, t, lang, "s", 1) for i in range(150) for lang, t in [("xx", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)))]]
    rows += [(1000 + i, " ".join(rng.choice(["ñandú", "größe", "çava", "øre"], 40)), "yy", "s", 1) for i in range(150)]
    got = language_id(spark.createDataFrame(rows, DOCS), per_language=60).collect()
    want = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    found = {(r.row.doc_id, r.row.text): (r.lang_pred, r.score) for r in identified(docs, 5).collect()}
    assert found[3, None] == found[4, ""] == found[12, "12 34 !! ##"] == ("und", 0.0) and len(found) == docs.count() - 1
    assert accepted(docs, per_language=5).columns == docs.columns
    assert language_id(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id(unlabelled).collect()} == {"und"}


def test_html_extract(spark):
    page = lambda body, n: f'<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href=/>Home {n}</a><li>b</ul></nav><div class="ad">buy {n}</div><article><h1>Title {n}</h1>{body}</article><div id="comments"><p>nice {n}</div><footer>&copy; host</footer></body></html>'
    rows = [(i, f"http://h.example/{i}", page(f"<p><b>First &amp; {i}<br><p>Second\n  line {i}</p>" + "<ul><li>x<li>y</ul>" * (i % 2), i)) for i in range(6)]
    rows += [(10, None, None), (11, "http://h.example/x", ""), (None, "http://other.example/", "just text"), (12, "bad url", "<p>a<p>b"), (12, "bad url", "<p>a<p>b")]
    got = html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].text == "Title 0\nFirst & 0\nSecond line 0" and by[1].text == "Title 1\nFirst & 1\nSecond line 1\nx\ny"
    assert by[10].text == by[11].text == "" and by[None].text == "just text" and by[12].text == "a\nb" and by[12].n_chars == 3
    body = "<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><div id='content'><h2>Head</h2><p>First para that is long enough to be the text.<p>Second para<div class='comments'><p>nice!</p></div><form>sub</form></div><div class='sidebar'><p>side</p></div></body>"
    assert extract(body, slim(infer(iter([body])))) == "Head\nFirst para that is long enough to be the text.\nSecond para"


def test_html_extract_reads_every_layout_of_a_host(spark):
    body = [f"Body {i} has a text of its own, which is long enough to be the main part." for i in range(400)]
    usual = [(i, "http://h.example/a", f"<body><div id=content><h1>Usual {i}</h1><p>{body[i]}<p>more {i}</div></body>") for i in range(300)]
    rare = [(i, "http://h.example/b", f"<body><div id=content><h1>Rare {i}</h1></div><div id=story><p>{body[i]}<p>more {i}</div></body>") for i in range(300, 303)]
    alone = [(310, "http://h.example/c", f"<body><div id=content><h1>Alone</h1></div><div id=tale><p>{body[310]}<p>more</div></body>")]
    copies = [(i, f"http://copies.example/{i}", f"<body><nav>{i}</nav><div id=content><h2>One</h2><div><p>{body[0]}</p></div></div></body>") for i in range(320, 340)]
    fixed = [(i, f"http://fixed.example/{i}", f"<body><div id=content><h2>One</h2><div><p>{body[i]}<p>more</div><div class=rights>All pages say this.</div></div></body>") for i in range(340, 343)]
    got = {r.page_id: r.text for r in html_extract(spark.createDataFrame([*usual, *rare, *alone, *copies, *fixed], "page_id long, url string, html string").repartition(5)).collect()}
    assert all(body[i] in got[i] and f"more {i}" in got[i] for i in range(303)) and body[310] in got[310]
    assert all(body[0] in got[i] for i in range(320, 340))
    assert all(body[i] in got[i] and "All pages" not in got[i] for i in range(340, 343))


@pytest.fixture(scope="module")
def multi():
    return queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.token_pattern()


def test_bpe_round_trip(docs, none, multi):
    import base64

    import tiktoken

    with open(multi[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=multi[1], mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(docs, *multi).where("doc_id IS NOT NULL").collect())
    want = []
    for i, text, *_ in awkward():
        if i is not None:
            ids = enc.encode_ordinary(text or "")
            want.append((False, i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_round_trip(none, *multi).count() == 0
    odd = ["a  b", " a\n\n b ", "don't\t\tx\r\n", "a b \n", "<|endoftext|>", "　x y"]
    assert bpe.codec(*multi).encode(odd) == [enc.encode_ordinary(t) for t in odd]


def test_token_output(spark, docs, none):
    from corpuscle.llm.common import new_path
    from tokenizers import Tokenizer

    file = queries.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    path = new_path(spark, "t")
    token_output.write_tokens(docs, path, file)
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_output.read_tokens(spark, path).collect()), key=lambda r: r[1]) == want
    got = {r.doc_id: r.ids for r in token_output.fetch(spark, path, [0, 14, 999, -5]).collect()}
    assert set(got) == {0, 14} and got[0][:-1] == tok.encode(awkward()[0][1]).ids
    empty = new_path(spark, "t")
    token_output.write_tokens(none, empty, file)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_quality_rules(docs, none):
    ledger = rule_ledger(docs)
    got = {(r.doc_id, r.n_words): r for r in apply_policy(ledger, 2).collect()}
    assert got[3, 0].kept is False and got[0, 120].kept is True
    r = got[8, 90]
    assert r.n_repeat_words == 90 and not r.kept and r.n_dup_lines == 0
    assert got[12, 4].n_symbols == 2 and got[14, 2].word_chars == 7
    for a in ablations(ledger, 2).collect():
        kept = apply_policy(ledger, 2).where("kept").count()
        assert a.n_kept_without == kept + a.n_only and a.n_failed >= a.n_only
    assert rule_ledger(none).count() == 0 and set(POLICIES) == {1, 2}


def test_nearest(spark):
    local = np.random.default_rng(3)
    x = local.normal(size=(400, 8)).astype(np.float32)
    x[:50] = x[0]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(400, None, "z"), (401, [0.0] * 8, "z"), (402, [float("nan")] + [1.0] * 7, "z"), (403, [None] + [1.0] * 7, "z"), (404, [float("inf")] * 8, "z"), (None, [1.0] * 8, "z"), (406, [1.0] * 3, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=5).collect()
    y = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 400, 20):
        s = y @ y[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 5
        hit, total = hit + len(set(best) & set(mine)), total + 5
    assert hit / total >= 0.95
    few = nearest(frame.where("vec_id in (0, 60, 100)"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(few) == 6
    assert nearest(frame.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_counts_repeated_rows_once(spark):
    local = np.random.default_rng(8)
    one, other = local.normal(size=(2, 8)).tolist()
    rows = [(i, one) for i in range(1, 31)] * 2 + [(40 + i, other) for i in range(8) for _ in range(1 if i else 30)] + [(0, [9.0, 9.0])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(nearest(frame, F.col("vec_id").isin(0, 3, 20, 40), k=5).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    assert got == {3: [1, 2, 4, 5, 6], 20: [1, 2, 3, 4, 5], 40: [41, 42, 43, 44, 45]}
    few = frame.where("vec_id > 30").union(spark.createDataFrame([(i, [1.0]) for i in (100, 101)], frame.schema))
    assert nearest(few, F.col("vec_id").isin(40, 100, 101), k=5).count() == 5


def test_license_scan(spark, docs, none):
    gpl = dict((n, t) for n, t in license_scan.TEMPLATES if "2 of" in t)["GPL-2.0"]
    rows = [(1, "Words here.\nReleased under the MIT License. More words."), (2, gpl), (3, gpl.replace("version 2 of", "version 3 of")), (4, "No license is needed to fish here."), (5, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (6, "Licensed under CC BY 4.0.")]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "GPL-2.0", 3: "GPL-3.0", 4: "", 5: "Apache-2.0,CC-BY-NC-4.0", 6: "CC-BY-4.0"}
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(none).count() == 0


def test_license_scan_within_sentences():
    named = lambda text: [f[0] for f in license_scan.scan(text)]
    assert named("These tools were written by Jane Doe in 2019 and are released under the MIT License.") == ["MIT"]
    assert named("Copyright (c) 2019 the authors of the parser, Released under the MIT License.") == ["MIT"]
    assert named("This project is licensed under the MIT License - see the LICENSE file for details.") == ["MIT"]
    assert named("All of the code in this folder that we wrote ourselves is licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert named("All of it is released under\nthe MIT License. Parts are Licensed under CC BY-SA 4.0. The rest: licensed under\nCC BY 4.0, or not.") == ["MIT", "CC-BY-SA-4.0", "CC-BY-4.0"]
    for k, (name, template) in enumerate(license_scan.TEMPLATES):
        broken = template.replace(" ", "\n", 3)
        text = f"Some words go before it here, {broken} and some other words follow, {template} The end"
        got = license_scan.scan(text)
        assert [f[0] for f in got] == [name] * 2 and [text[f[1] : f[1] + f[2]] for f in got] == [broken, template], k
    assert not named("It isn't released under the GPL License, nor any license of version 7.")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == documents.columns, name
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= documents.count() and os.path.exists(queries.tokenizer_file("byte_bpe_50k.json"))


def test_pipeline_returns_the_mixture(spark):
    import corpus_pipeline
    from corpuscle.llm.common import saved

    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    want = [r.doc_id for r in mix_schedule(many).orderBy("place").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        written = saved(corpus_pipeline.mix(spark, many, ""), "mixing")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(written.inputFiles()) > 1
    got = corpus_pipeline.encode(spark, written, "").orderBy("place").collect()
    assert [r.place for r in got] == list(range(3000)) and [r.doc_id for r in got] == want


@pytest.mark.parametrize("window", [3, 35])
def test_substring_dedup_with_counters_as_a_table(docs, monkeypatch, window):
    from corpuscle.llm import sketch

    monkeypatch.setattr(sketch, "MAX_WIDTH", 1)
    test_substring_dedup(docs, window)


def test_ngram_join_with_counted_keys(spark, docs, monkeypatch):
    from corpuscle.llm import ngram_join

    monkeypatch.setattr(ngram_join, "fits", lambda keys: False)
    monkeypatch.setattr(ngram_join, "MAX_WIDTH", 64)
    test_ngram_join(spark, docs, 3, 9, 10)


def test_encoders_on_odd_texts(spark, multi):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    from corpuscle.llm.common import new_path

    odd = ["", " ", "\n\n", "a  b", "a　\n b", "a　　 b", "  x", "x\u0085\n\ny", "hi <|endoftext|> there", "<|endoftext|>", "a\tb\r\nc  ", "  lead", "don't stop", "x" * 3000, "ẞß 日本 語\n" * 50, "same same\nsame"]
    with open(multi[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=multi[1], mergeable_ranks=ranks, special_tokens={})
    assert bpe.Codec(*multi).encode(odd) == [enc.encode_ordinary(t) for t in odd]
    file = queries.tokenizer_file("byte_bpe_50k.json")
    tok, path = Tokenizer.from_file(file), new_path(spark, "odd")
    token_output.write_tokens(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path, file)
    got = {r.doc_id: r.ids for r in token_output.fetch(spark, path, list(range(len(odd)))).collect()}
    assert [got[i][:-1] for i in range(len(odd))] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_html_keeps_what_only_sounds_like_a_notice(spark):
    from corpuscle.llm.html_extract import _page_text

    page = lambda body: f"<body><nav>menu</nav><article><h1>T</h1>{body}</article><footer>f</footer></body>"
    alone = lambda kind: None
    assert _page_text(page("<div class='notice-of-law'>law</div><p class='side-effects'>effects</p><p class=x'y>stray</p><div class='cookie-notice'>gone</div>"), alone) == "T\nlaw\neffects\nstray"
    assert _page_text(page("<div>" * 3000 + "<nav>leak</nav><p>inner</p>" + "</div>" * 3000), alone) == "T\ninner"
    many = slim(infer(iter([page(f"<p>Standard opening sentence.</p><p>para {i}</p>") for i in range(5)])))
    assert _page_text(page("<p>Standard opening sentence.</p><p>para 9</p>"), lambda kind: many) == "T\nStandard opening sentence.\npara 9"
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, host string, wrapper string, layout string")
    assert html_extract(empty).count() == 0
    clash = spark.createDataFrame([(1, "http://a/1", page("<p>x"), "t", "h", "w", "l")], empty.schema)
    assert [r.text for r in html_extract(clash).collect()] == ["T\nx"]

"""Long words that agree in every polynomial modulo 2**64, in the operators that tell words by hashes; copies in the language sample; odd pages."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import language_id, queries, substring_dedup
from corpuscle.llm.bpe import bpe_round_trip
from corpuscle.llm.html_extract import extract, html_extract, infer, parse, slim
from corpuscle.llm.ngram_join import ngram_jaccard_join
from corpuscle.llm.quality_rules import measure
from corpuscle.llm.token_output import Encoder
from corpuscle.llm.words import words_of


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (64, 512, 1024, 2048, 4096)]


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(len(p[0])))
def test_hashes_differ(pair):
    for lower in (False, True):
        h = words_of(pa.array([" ".join(pair), f"{'x ' * 40}{pair[0]} {pair[1].upper()}"]), lower).hashes
        assert h[0] != h[1] and h[-2] == h[0] and (h[-1] == h[1]) == lower
    at = np.random.default_rng(1)
    # wherever a word lies, also across the bytes hashed together
    for lead in at.integers(1 << 18, (1 << 18) + 100, 5).tolist():
        h = words_of(pa.array(["y" * (lead - 70) + " " + pair[0] + " " + pair[1]])).hashes
        assert h[1] == words_of(pa.array([pair[0]])).hashes[0] and h[2] == words_of(pa.array([pair[1]])).hashes[0]


def test_substring_dedup_and_join_tell_them_apart(spark):
    a, b = PAIRS[3]
    lead = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*lead, a])), (2, " ".join([*lead, b])), (3, a), (4, b), (5, " ".join([*lead, a]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, 35).collect()} == {1: 35, 2: 0, 3: 0, 4: 0, 5: 35}
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs, 3, (99, 100)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_quality_measures_tell_them_apart():
    a, b = PAIRS[3]
    text = f"one two three four {a} one two three four {b}"
    words, k = text.split(), 5
    n = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    assert measure(text.encode())[4] == 0 == sum(c > 1 for c in n.values())
    assert measure(f"{a} {b} {a}".encode())[7] == 0 and measure(f"{a} {a}".encode())[7] == 1


def test_encoders_tell_them_apart(spark):
    import tiktoken
    from tokenizers import Tokenizer

    a, b = PAIRS[2]
    texts = [f"{a} {b}", f"{b} {a}", f"x {a}", f"x {b}"]
    path = queries.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids, begin = Encoder(path).encode(pa.array(texts))
    for t, i, j in zip(texts, begin, begin[1:]):
        assert ids[i:j].tolist() == tok.encode(t, add_special_tokens=False).ids
    import base64
    import hashlib

    file = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(file, "rb"))}
    e = tiktoken.Encoding("own", pat_str=queries.token_pattern(), mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids_sha256 for r in bpe_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), file, queries.token_pattern()).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, e.encode_ordinary(t))).encode()).hexdigest() for i, t in enumerate(texts)}


def test_a_language_of_copies_is_learned(spark):
    local = np.random.default_rng(2)
    english = ["".join(local.choice(list("thewordsofand "), 200)) for _ in range(500)]
    rows = [(i, "été à la plage où naît le goût " * 9, "fr") for i in range(20_000)] + [(100_000 + i, t, "en") for i, t in enumerate(english)]
    pieces, labels = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    n = collections.Counter(labels)
    assert set(n) == {"en", "fr"} and n["en"] >= 50 and len(pieces) == len(labels)


def test_gradients_against_differences():
    local = np.random.default_rng(0)
    n, h = 3, language_id.HIDDEN
    draw = lambda *s: local.normal(0, 0.3, s)
    cell = lambda: language_id.Direction(draw(256, 3 * h), draw(h, 2 * h), draw(h, h))
    net = language_id.Network(["a", "b", "c"], cell(), cell(), draw(2 * h, n), draw(n))
    x, label = local.integers(97, 101, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        p = net.positions(x)
        return -np.mean(np.log(p[:, np.arange(4), label]))

    worst = 0.0
    for p, g in zip(net.params(), net.step(x, label), strict=True):
        for _ in range(12):
            at = tuple(local.integers(0, s) for s in p.shape)
            if p.shape[0] == 256:
                at = (int(local.integers(97, 101)), at[1])
            old, e = p[at], 1e-2
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            worst = max(worst, abs((up - down) / (2 * e) - g[at]) / (abs(g[at]) + 1e-2))
    assert worst < 0.02


def one(page):
    return extract(page, slim(infer([page])))


def test_links_and_formulas_in_articles_stay():
    head = "<nav><ul><li><a href=x>Menu one</a></li><li><a href=y>Menu two</a></li></ul></nav>"
    ref = "<p class='ref'>See <a>the long long reference text</a></p><ul><li><a>Reference number one</a></li><li><a>Reference number two</a></li></ul>"
    assert one(f"<body>{head}<article><h1>T</h1><p>Some text of it.</p>{ref}</article></body>") == "T\nSome text of it.\nSee the long long reference text\nReference number one\nReference number two"
    assert one(f"<body>{head}<article><p><a>all of this is one long link</a></p></article></body>") == "all of this is one long link"
    assert one("<body><article><p>Energy <math><mi>E</mi>=<mi>m</mi></math> it is.</p></article></body>") == "Energy E=m it is."
    # outside articles a list of links is a menu, a paragraph of them isn't
    page = "<body><ul><li><a>First menu entry here</a></li><li><a>Second menu entry here</a></li></ul><div><p>Text of the page, which is long enough.</p><p>See <a>the long long reference text</a></p><p>More text of the page.</p></div></body>"
    assert one(page) == "Text of the page, which is long enough.\nSee the long long reference text\nMore text of the page."


def test_deep_and_broken_pages(spark):
    began = time.time()
    deep = "<div>" * 300_000 + "<p>core</p><nav>menu</nav>tail" + "</div>" * 300_000
    assert parse(deep).depth > 2000 and one(deep) == "core\ntail"
    stray = "<p>a" + "</section>" * 200_000 + "</p><div>b"
    assert one(stray) == "a\nb"
    forms = "<center>" * 20_000 + "<li>x</li>" * 20_000
    assert one(forms).count("x") == 20_000
    assert time.time() - began < 60
    pages = spark.createDataFrame([(1, "http://a/x", deep, "z", 1), (2, None, None, "z", 1), (3, "http://a/x", "", "z", 1), (None, "u", "<p>x", "z", 1), (4, "http://a/x", "<article>" + "<div>" * 5000 + "y", "z", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract(pages).collect()}
    assert got == {1: ("core\ntail", 9), 2: ("", 0), 3: ("", 0), None: ("x", 1), 4: ("y", 1)}
    assert html_extract(pages.limit(0)).count() == 0

"""Spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest

from corpuscle.llm import queries, spelling
from corpuscle.llm.spelling import near_pairs, near_words, spelling_variants, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def brute_counts(rows, every=199, least_chars=6, least=5):
    n = collections.Counter()
    for i, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_chars and c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, times=5):
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= times * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def corpus(seed=0, docs=300):
    local = np.random.default_rng(seed)
    stems = ["".join(local.choice(list("abcdé"), local.integers(5, 9))) for _ in range(25)]
    rows = []
    for i in range(docs):
        words = []
        for s in local.choice(stems, 60, p=np.arange(1, 26) / 325):
            if local.random() < 0.3:
                k = local.integers(0, len(s))
                s = [s[:k] + s[k + 1 :], s[:k] + "b" + s[k:], s[:k] + "c" + s[k + 1 :], s.upper(), s.title()][local.integers(0, 5)]
            words.append(s)
        rows.append((i, " ,\n-1"[i % 5].join(words) + ("×÷" * 4 if i % 3 else "")))
    return rows


AWKWARD = [(None, "nullid " * 7), (5, None), (6, ""), (7, "x" * 3000 + " " + "x" * 2999), (7, "x" * 3000), (7, "x" * 3000), (7, "x" * 3000), (7, "x" * 3000), (8, ("x" * 2999 + " ") * 30), (9, "×××××× ÀBCDEF àbcdef " * 9), (9, "×××××× ÀBCDEF àbcdef " * 9)]


@pytest.mark.parametrize("every", [199, 3])
def test_counts_and_variants(spark, every):
    rows = corpus() + AWKWARD
    docs = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, text string, word string, n long, m int")
    n = brute_counts(rows, every)
    assert {r.word: r.n for r in word_counts(docs, every).collect()} == n
    want = brute(n)
    assert len(want) > 50 and sum(w[1] is not None for w in want) > 5
    assert {tuple(r) for r in spelling_variants(docs, every).collect()} == want
    none = spelling_variants(docs.limit(0))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_and_ties(spark):
    # abcdef 5, abcdeg 30 -> abcdxg 200 -> abcyxg 1100; two equal candidates at the end
    n = {"abcdef": 5, "abcdeg": 30, "abcdxg": 200, "abcyxg": 1100, "zzzzzz": 9, "zzzzza": 60, "zzzzzb": 60, "zzzzz": 70, "lonely": 5}
    text = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(n.items())]
    kept = {w: c for w, c in n.items() if len(w) >= 6}
    got = {tuple(r) for r in spelling_variants(spark.createDataFrame(text, "doc_id long, text string"), every=1 << 40).collect()}
    assert got == brute(kept)
    assert ("abcdef", "abcdeg", "abcyxg", 5, 1, 30) in got and ("zzzzzz", "zzzzza", "zzzzza", 9, 2, 60) in got


@pytest.mark.parametrize(("cell", "rows"), [(2048, 256), (3, 4), (7, 2)])
def test_crowded_halves(spark, monkeypatch, cell, rows):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "ROWS", rows)
    local = np.random.default_rng(7)
    words = sorted({"abc" + "".join(local.choice(list("xyz"), local.integers(3, 6))) for _ in range(300)} | {"".join(local.choice(list("pq"), local.integers(6, 9))) for _ in range(300)})
    n = {w: int(local.integers(5, 40)) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    links = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    pairs = [tuple(r) for r in near_pairs(table).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == links
    got = {r.word: (r.n_near, r.near, r.near_n) for r in near_words(table).collect()}
    near = {w: [x for p in links if w in p for x in p if x != w] for w in words}
    assert got == {w: (len(x), b := min(x, key=lambda y: (-n[y], y)), n[b]) for w, x in near.items() if x}


def test_runs_are_never_cut(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 5)
    text = "abcdefghij klmnopq éééééééé,x 12 yz"
    assert [r for some in spelling.runs(text.encode()) for r in some] == RUN.findall(text)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op12_spelling_variants(spark, sf_dir).collect()} == brute(brute_counts(rows))

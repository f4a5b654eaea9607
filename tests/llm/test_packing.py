"""Packing: every id in one piece, full sequences, even steps; encodings against the library."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import packing, queries
from corpuscle.llm.packing import SpacedEncoder, Pool, pack, packed, step_groups, tail

rng = np.random.default_rng(9)
VOCABULARY = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]
ODD = [
    None, "", "   ", "\n\t ", "It's we'll 'S don’t", "ÀÉ́ é ﬁ Σας ΣΑΣ İstanbul K", "a b c \u0085 d", "x\u0001y \u0001 z \u0001\u0001", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "日本語 テキスト ☃️ 👩‍👩‍👧 12 345 ½",
    "  ́combining first", "tab\tthen\x0bvt\x0cff\r\nend", "9" * 300, "w" * 5000, "\u0000 nul", " ",
]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_encoder(path, library):
    e = SpacedEncoder(path)
    ids, begin = e.encode(pa.array(ODD))
    for t, a, b in zip(ODD, begin, begin[1:]):
        assert ids[a:b].tolist() == library(t)[:-1], t


def rows_of(n=400):
    sizes = rng.integers(1, 900, n)
    rows = [(i, " ".join(rng.choice(VOCABULARY, k))) for i, k in enumerate(sizes)]
    return rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, " ".join(rng.choice(VOCABULARY, 9000))), (None, "no id"), (7, "again"), (7, "again")]


def check(pieces, rows, library, most=2048):
    """pieces: rows with ids as arrays or their checksum."""
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for some in by.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == some[0].context_size <= most and at & (at - 1) == 0
    want = collections.Counter()
    for i, t in rows:
        ids = library(t)
        want[i, len(ids)] += len(ids)
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == want
    return by


@pytest.mark.parametrize("pool", [1 << 19, 3000])
def test_pack(spark, path, library, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    monkeypatch.setattr(packing, "BATCH", 5000)
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, start string, ids string").repartition(3)
    found = pack(docs, path).collect()
    by = check(found, rows, library)
    parts = collections.defaultdict(list)
    for p in found:
        parts[p.doc_id].append(p)
    for i, t in rows:
        if i not in (None, 7):
            one = sorted(parts[i], key=lambda p: p.start)
            assert [p.start for p in one] == [0, *np.cumsum([p.length for p in one])[:-1].tolist()]
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in one]).tolist() == library(t)
    sizes = collections.Counter(some[0].context_size for some in by.values())
    assert sum(n for s, n in sizes.items() if s < 256) <= 3 * 8
    # few documents are cut but those longer than a window: at most one for each window
    assert len(found) <= len(rows) + len(by)
    assert pack(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        pack(docs, path, sizes=(1000, 500))


def test_pool_fills_long_windows_from_shorter_sizes():
    pool = Pool()
    for i, n in enumerate([1500, 500, 48, 700, 300, 24, 200, 56]):
        pool.add((i, 0, np.zeros(n, "<u4"), n))
    out = [(size, [len(p[2]) for p in w]) for size, w in packed(pool, (2048, 1024, 512, 256))]
    assert out == [(2048, [1500, 500, 48]), (1024, [700, 300, 24]), (256, [200, 56])] and not pool.have
    pool.add((9, 0, np.zeros(1337, "<u4"), 1337))
    assert [size for size, _ in tail(pool, 2048)] == [1024, 256, 32, 16, 8, 1] and not pool.have


def test_step_groups(spark, path):
    rows = rows_of(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pack(docs, path).drop("ids")
    from corpuscle.llm.common import saved

    found = step_groups(saved(found, "pieces"), 8192).collect()
    size, held, of = {}, collections.Counter(), collections.defaultdict(list)
    for r in found:
        assert size.setdefault(r.step, r.context_size) == r.context_size
        held[r.step] += r.length
    assert sorted(held) == list(range(len(held)))
    for step in sorted(held):
        of[size[step]].append(step)
    for s, steps in of.items():
        assert all(held[x] == 8192 for x in steps[:-1]) and held[steps[-1]] <= 8192
        # spread evenly: the i-th of n lies within one place for each size of (i + 1/2) / n of all
        assert all(abs(x - (i + 0.5) / len(steps) * len(held)) <= len(of) for i, x in enumerate(steps))
    empty = spark.createDataFrame([], spark.createDataFrame(rows[:1], "doc_id long, text string").schema)
    assert step_groups(saved(pack(empty, path), "pieces")).count() == 0


def test_query(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_pack_sequences(spark, sf_dir).collect()
    check(found, rows, library)
    text = dict(rows)
    for r in found:
        ids = np.array(library(text[r.doc_id])[r.start : r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length

"""BM25 and dense recall over crowded batches, filters and awkward rows, against plain versions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuscle.operators import dense, lexical

rng = np.random.default_rng(4)
WORDS = [f"w{i}" for i in range(60)]


def plain_bm25(docs, queries, k, allowed=lambda d: True):
    sets = {i: set((t or "").lower().split()) for i, t, _ in docs}
    n, avg = len(docs), sum(map(len, sets.values())) / len(docs)
    out = {}
    for q, text, only in queries:
        asked, scores = set(text.lower().split()), []
        for i, _, kind in docs:
            if allowed(i) and (only is None or kind in only):
                s = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(sets[i]) / avg)) for t in asked & sets[i] if (df := sum(t in x for x in sets.values())))
                if s > 0:
                    scores.append((-round(s, 9), i))
        out[q] = [(i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:k])]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize(("small", "at_once"), [(1 << 18, 1 << 22), (1 << 18, 40), (0, 1 << 22)])
def test_bm25(spark, monkeypatch, small, at_once):
    monkeypatch.setattr(lexical, "SMALL_BATCH", small)
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "HELD", 50)
    docs = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 12))) if i % 11 else None, "ab"[i % 2]) for i in range(120)] + [(500, "", "a"), (501, "w1 w1 w2", None)]
    queries = [(f"q{i}", " ".join(rng.choice(WORDS, 4)), [None, ["a"], ["a", "b"], []][i % 4]) for i in range(15)] + [("none", "unheard", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, block_type string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, query string, only array<string>")
    show = lambda df: {q: sorted(v, key=lambda x: x[1]) for q, v in grouped(df).items()}

    def grouped(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.query_id, []).append((r.chunk_id, r.lexical_rank))
        return out

    assert show(lexical.bm25(frame, asked, 5)) == plain_bm25(docs, queries, 5)
    free = [(q, t, None) for q, t, _ in queries]
    assert show(lexical.bm25(frame, asked.drop("only"), 7, where=F.col("doc_id") % 3 == 0)) == plain_bm25(docs, free, 7, lambda i: i % 3 == 0)
    assert lexical.bm25(frame.limit(0), asked, 5).count() == 0 == lexical.bm25(frame, asked.limit(0), 5).count()


def scores_of_both_orders():
    """Scores of 40,000 lengths of a document, its 60 tokens in two orders, and the sum of its parts without error."""
    tokens, n, lengths = [f"t{i}" for i in range(60)], 100000, np.arange(60, 40060)
    df = {i: 3 + 71 * i for i in range(60)}
    w = lexical.Weights([Row(query_id=1, token=t) for t in tokens], tokens, df, n, 30000 * n)
    orders = np.random.default_rng(1).permuted(np.tile(np.arange(60, dtype=np.int32), (80000, 1)), axis=1)
    places = pa.ListArray.from_arrays(pa.array(np.arange(0, 60 * 80001, 60), pa.int32()), pa.array(orders.ravel()))
    exact = [math.fsum(w.idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * x / 30000))) for x in lengths.tolist()]
    return w.scores(places, np.repeat(lengths, 2), None).reshape(-1, 2), np.array(exact)


def test_scores_do_not_follow_the_order_of_words():
    s, exact = scores_of_both_orders()
    assert (s[:, 0] == s[:, 1]).all()
    # halves go up, as SQL rounds
    assert (s[:, 0] == np.floor(exact * 1e9 + 0.5) / 1e9).all()


@pytest.mark.parametrize("block", [4096, 3])
def test_dense(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "AT_ONCE", 200)
    monkeypatch.setattr(dense, "HELD", 40)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[50:] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0] * 3), (102, [None] * 8)]
    asked = [(f"q{i}", (v[i] + 0.1).tolist()) for i in range(8)] + [("gone", None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, query_vector array<float>")
    got = {}
    for r in dense.dense_topk(frame, queries, 12, where=F.col("vec_id") % 2 == 0).collect():
        got.setdefault(r.query_id, []).append((r.dense_rank, r.chunk_id))
    for q, x in asked[:-1]:
        d = np.round(((v.astype(float) - np.array(x, np.float32).astype(float)) ** 2).sum(axis=1), 9)
        best = [i for i in sorted(range(60), key=lambda i: (d[i], i))[:12] if i % 2 == 0]
        assert sorted(got[q]) == [(n + 1, i) for n, i in enumerate(best)]
    assert "gone" not in got and dense.dense_topk(frame, queries.limit(0), 3).count() == 0

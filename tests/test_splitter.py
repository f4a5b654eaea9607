"""The recursive splitter against a plain version."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators.splitter import recursive_chunks, recursive_split

rng = np.random.default_rng(5)


def pieces(t):
    return max(1, len(re.findall(r"[\w一-鿿]+", t)))


def join(parts, budget, overlap):
    out, cur, total = [], [], 0
    for p in parts:
        n = pieces(p)
        if cur and total + n + 1 > budget:
            out.append("".join(cur).strip())
            while cur and (total > overlap or total + n + 1 > budget and total > 0):
                total -= pieces(cur[0]) + (len(cur) > 1)
                cur = cur[1:]
        cur.append(p)
        total += n + (len(cur) > 1)
    if cur:
        out.append("".join(cur).strip())
    return [x for x in out if x]


def plain(text, budget, overlap, separators=("\n\n", "\n", " ", "")):
    sep, rest = separators[0], separators[1:]
    parts = list(text) if not sep else [s for i, x in enumerate(text.split(sep)) if (s := (sep if i else "") + x)]
    out, run = [], []
    for p in parts:
        if pieces(p) < budget or not sep:
            run.append(p)
        else:
            out += [*join(run, budget, overlap), *plain(p, budget, overlap, rest)]
            run = []
    return out + join(run, budget, overlap)


@pytest.mark.parametrize(("budget", "overlap"), [(24, 4), (7, 3), (2, 0), (220, 40)])
def test_split(spark, budget, overlap):
    bits = ["word ", "a-b-c", "\n", "\n\n", " ", "日本", "x", "é. ", "long-" * 30, "### ", "\t", "\n\n\n"]
    texts = ["", " ", "x" * 500, "a-" * 400, " ".join(f"token{i}" for i in range(300)), *("".join(rng.choice(bits, rng.integers(1, 90))) for _ in range(150))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", recursive_split("t", budget, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t, budget, overlap), t
        assert all(pieces(c) <= budget for c in got[i])


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None), (3, "  "), (4, " ".join(f"t{i}" for i in range(80)))], "doc_id long, text string").withColumn("c", F.lit("z"))
    got = recursive_chunks(docs, 24, 4).collect()
    assert {r.doc_id for r in got} == {1, 4} and all(pieces(r.text) <= 24 for r in got)
    four = sorted(((r.chunk_index, r.text) for r in got if r.doc_id == 4))
    assert len(four) == [r.chunk_count for r in got if r.doc_id == 4][0] > 3 and {w for _, t in four for w in t.split()} == {f"t{i}" for i in range(80)}

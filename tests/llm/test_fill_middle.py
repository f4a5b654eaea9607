"""Fill-in-middle against a plain version, on awkward rows, and round trips of every cut."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import queries
from corpuscle.llm.fill_middle import BLOCK, FILL_MIDDLE_SQL, Scan, draws, exchange, fill_in_middle, restore, restored, transform

rng = np.random.default_rng(3)
ODD = ["", "a", "é", "日本語 text", "has <M> inside", "<S>", "<P", "ends in <", "><M", "x" * 7, "\U0001f600 mixed é\n\ttext", "<<P><", "S>"]


def plain(text, h):
    n = len(text)
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else (n, "psm", i, j - i, f"<P>{a}<S>{c}<M>{b}")


def test_exchange():
    for a, b, c in [(0, 0, 0), (0, 3, 10), (2, 2, 10), (2, 10, 10), (1, 7, 9)]:
        data = bytearray(range(10))
        want = data[:a] + data[b:c] + data[a:b] + data[c:]
        exchange(data, a, b, c)
        assert data == want
    data = bytearray(rng.integers(0, 256, 5 * BLOCK + 17, np.uint8).tobytes())
    want = data[BLOCK + 5 :] + data[: BLOCK + 5]
    exchange(data, 0, BLOCK + 5, len(data))
    assert data == want


def test_scan():
    text = "".join(rng.choice(list("aé日\U0001f600"), 60_000))
    scan = Scan(text.encode())
    assert scan.n == len(text)
    for k in [0, 1, 29_999, 59_999, 60_000, 70_000, *rng.integers(0, 60_000, 30).tolist()]:
        assert scan.place(k) == len(text[:k].encode())


@pytest.mark.parametrize("text", ODD)
def test_every_cut_comes_back(text):
    for i in range(len(text) + 1):
        for j in range(len(text) + 1):
            for last in (5, 50):
                h = [i, j, 0, last]
                n, form, a, b, out = transform(text.encode(), h)
                assert (n, form, a, b, out.decode()) == plain(text, h)
                assert restore(out, form).decode() == text


def test_rows(spark):
    rows = [(i, t, "z", "z", "z") for i, t in enumerate([*ODD, *ODD, *ODD, None, "".join(rng.choice(list("ab é\n"), 300_000))])] + [(None, "no id", *"zzz"), (7, "again", *"zzz"), (7, "again", *"zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, restored string")
    got = restored(fill_in_middle(docs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = [(i, *plain(t or "", draws(1, i)), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0 == restored(fill_in_middle(docs.limit(0))).count()
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_query_matches_sql(spark, sf_dir):
    documents = duckdb.read_parquet(f"{sf_dir}/documents.parquet")  # noqa: F841
    want = {tuple(r) for r in duckdb.sql(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({FILL_MIDDLE_SQL})").fetchall()}
    got = queries.op13_fill_in_middle(spark, sf_dir)
    assert {tuple(r) for r in got.collect()} == want
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    assert got.join(texts, "doc_id").where("sha <> restored_sha256").count() == 0

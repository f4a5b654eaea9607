"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from corpuscle.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f[: -len('.parquet')]} as select * from '{sf_dir}/{f}'")
    return c


def rows(df: pd.DataFrame):
    show = lambda v: "~" if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert set(got.columns) == set(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_answers_with_any_citation_are_judged(spark, tmp_path):
    import re

    texts = ["plain", "See [5] and [1].", "Twice [12] [12] here [3]", "[0] first", "no number [x] [2]"]
    rows = [(i, turn, "assistant", text) for i, text in enumerate(texts) for turn in (1, 2)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sanitized = {(r.conv_id, r.turn): r.answer for r in QUERIES["citation_sanitize"](spark, str(tmp_path)).collect()}
    correct = {(r.conv_id, r.turn): r.correct for r in QUERIES["citation_correctness"](spark, str(tmp_path)).collect()}
    for i, turn, _, text in rows:
        answer = text + " [1] [7]  [2]"
        kept = re.sub(r"\[(\d+)\]", lambda m: m[0] if 1 <= int(m[1]) <= 3 else "", answer)
        assert sanitized[i, turn] == re.sub(" {2,}", " ", kept).strip()
        n = 3 if turn % 2 == 0 else 7
        assert correct[i, turn] == float(all(1 <= int(x) <= n for x in re.findall(r"\[(\d+)\]", answer)))

"""Files of a folder up to their stored blocks."""

from __future__ import annotations

import json

import pytest

from corpuscle.sources import sinks, store
from corpuscle.streaming.ingest import ingest_folder


def _stored(spark, path):
    rows = [json.loads(r.snapshot) for r in store.documents(spark, path, sinks.SNAPSHOT).collect()]
    return sorted((r["source_name"], r["block_order"], r["block_type"], r["title"], r["content"], r["loader"]) for r in rows)


def test_ingest_folder(spark, tmp_path):
    folder, path = tmp_path / "in", f"file://{tmp_path}/store"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("# Top\n\nfirst line\n\n## Part\n\nsec-\nond")
    (folder / "sub" / "b.TXT").write_text("plain words")
    (folder / "empty.txt").write_text("")
    (folder / "blank.txt").write_text(" \n\t\n")
    (folder / "c.csv").write_text("a,b\n1,2")
    log = ingest_folder(spark, f"file://{folder}", path).collect()
    assert sorted((r.run_type, r.chunk_count, r.status) for r in log) == [("append", 1, "completed"), ("append", 4, "completed"), ("noop", 0, "skipped"), ("noop", 0, "skipped")]
    whole = _stored(spark, path)
    markdown, text = "unstructured_markdown_loader", "text_loader"
    assert [(n, t, c, k) for n, _, _, t, c, k in whole] == [("a.md", "Top", "Top", markdown), ("a.md", "Top", "first line", markdown), ("a.md", "Top", "Part", markdown), ("a.md", "Top", "second", markdown), ("b.TXT", "b", "plain words", text)]
    again = ingest_folder(spark, f"file://{folder}", path).collect()
    assert sorted(r.run_type for r in again) == ["noop", "noop", "update", "update"] and _stored(spark, path) == whole

    (folder / "a.md").write_text("only this")
    ingest_folder(spark, f"file://{folder}", path)
    assert [(n, c) for n, _, _, _, c, _ in _stored(spark, path)] == [("a.md", "only this"), ("b.TXT", "plain words")]

    (folder / "odd.exe").write_text("x")
    with pytest.raises(Exception, match="unsupported file type"):
        ingest_folder(spark, f"file://{folder}", path)
    assert len(_stored(spark, path)) == 2

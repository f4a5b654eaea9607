"""Session files as a stream, and the store of documents in buckets."""

import os

import numpy as np
from pyspark.sql import functions as F

from corpuscle.sources import store
from corpuscle.streaming import session_files as sf
from corpuscle.streaming.ingest import ingest


def action(session, file, seq, kind, **more):
    return {"session_id": session, "file_id": file, "seq": seq, "action": kind, **{c.split()[0]: None for c in sf.ACTION.split(", ")[4:]}, **more}


def run(spark, tmp_path, batches):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for rows in batches:
        spark.createDataFrame([tuple(r[c.split()[0]] for c in sf.ACTION.split(", ")) for r in rows], sf.ACTION).repartition(2).write.mode("append").parquet(src)
        sf.follow(spark, src, out, ck).awaitTermination()
    return spark.read.parquet(out)


def test_life_of_a_file(spark, tmp_path):
    first = [
        action(1, 1, 1, "upload", source_name="a.pdf", source_uri="/u/a"), action(1, 1, 2, "update", status="parsed", page_count=3), action(1, 1, 3, "update", status="failed", error_code="x", error_message="bad"),
        action(1, 2, 1, "register", doc_id="d", doc_type="txt", source_name="b.txt", source_uri="/u/b"), action(1, 2, 2, "register", doc_id="e"), action(1, 2, 3, "recover"), action(1, 3, 1, "update", status="indexed"), action(1, 3, 2, "recover"),
    ]
    second = [
        action(1, 1, 3, "delete"), action(1, 1, 4, "update", status="indexed", doc_id="d1", doc_type="pdf"), action(1, 2, 4, "delete", cleanup_error=" disk full ", cleanup_step="upload_file_delete"), action(1, 2, 5, "delete"),
        action(1, 2, 6, "recover", cleanup_error="[step=index] " + "y" * 600), action(1, 4, 1, "upload", source_name="c"), action(1, 4, 2, "delete"), action(1, 4, 3, "delete"), action(1, 4, 4, "recover"), action(1, 4, 5, "upload", source_name="again"),
    ]
    found = run(spark, tmp_path, [first, first, second])
    got = {(r.file_id, r.seq): (r.action, r.outcome) for r in found.collect()}
    assert len(got) == found.count() == 17
    assert [got[1, s] for s in (1, 2, 3, 4)] == [("upload", "ok"), ("update", "ok"), ("update", "ok"), ("update", "ok")]
    assert [got[2, s][1] for s in range(1, 7)] == ["ok", "exists", "skipped", "failed", "conflict", "failed"]
    assert [got[3, s][1] for s in (1, 2)] == ["missing", "already_deleted"] and [got[4, s][1] for s in range(1, 6)] == ["ok", "ok", "missing", "already_deleted", "ok"]
    files = {r.file_id: r for r in sf.files(found).collect()}
    assert set(files) == {1, 2, 4} and (files[1].status, files[1].error_code, files[1].page_count, files[1].doc_id, files[1].source_name) == ("indexed", None, 3, "d1", "a.pdf")
    assert files[2].status == "recover_pending" and files[2].error_message == ("[step=index] " + "y" * 600)[:500] and files[2].doc_id == "d"
    assert files[4].source_name == "again" and files[4].created_seq == 5
    waiting = sf.pending_outcomes(sf.files(found), spark.createDataFrame([(1, 9)], "session_id long, file_id long")).collect()
    assert [tuple(r) for r in waiting] == [(1, 2, "ok")]
    assert [r.outcome for r in sf.pending_outcomes(sf.files(found), spark.createDataFrame([(1, 2)], "session_id long, file_id long")).collect()] == ["failed"]


def test_stream_equals_fold(spark, tmp_path):
    local, rows, seq = np.random.default_rng(3), [], {}
    for _ in range(600):
        key = (int(local.integers(3)), int(local.integers(5)))
        seq[key] = seq.get(key, 0) + 1
        kind = str(local.choice(["upload", "register", "update", "update", "delete", "recover"]))
        rows.append(action(*key, seq[key], kind, status=str(local.choice(["parsed", "failed", "indexed"])) if kind == "update" else None, doc_id=str(local.choice(["d", "e"])) if local.random() < 0.3 else None, error_code="c" if local.random() < 0.5 else None, cleanup_error="no" if local.random() < 0.4 else None))
    state = {}
    for r in rows:
        key = (r["session_id"], r["file_id"])
        state[key], _ = sf.transition(state.get(key), r)
    got = {(r.session_id, r.file_id): tuple(r)[2:] for r in sf.files(run(spark, tmp_path, [rows[:250], rows[200:400], rows[400:]])).collect()}
    assert got == {k: tuple(v[f] for f in sf.FIELDS) for k, v in state.items() if v}


def test_deletable(spark):
    rows = [(1, 1, "d", "/a"), (1, 2, "d", "/b"), (2, 1, "e", "/b"), (2, 2, "e", "/c"), (2, 3, None, "/d"), (3, 1, None, None)]
    files = spark.createDataFrame(rows, "session_id long, file_id long, doc_id string, source_uri string")
    gone = lambda cond: {tuple(r) for r in sf.deletable(files, files.where(cond)).collect()}
    assert gone("session_id = 1") == {("snapshot", "d"), ("upload", "/a")}
    assert gone("session_id = 2") == {("snapshot", "e"), ("upload", "/c"), ("upload", "/d")}
    assert gone("session_id = 1 and file_id = 1") == {("upload", "/a")} and gone("session_id = 3") == set()
    assert gone("session_id in (1, 2)") == {("snapshot", "d"), ("snapshot", "e"), ("upload", "/a"), ("upload", "/b"), ("upload", "/c"), ("upload", "/d")}


def listing(path):
    return {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}


SCHEMA = "doc_id long, chunk int, text string"


def test_replacing_reads_and_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(400).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk")).selectExpr("id as doc_id", "chunk", "concat('old ', id) as text")
    assert len(store.replace_documents(path, rows, 32)) == 32
    before = listing(path)
    new = spark.createDataFrame([(7, 0, "new"), (7, 1, "new"), (7, 2, "new"), (1000, 0, "fresh"), (None, 0, "x")], SCHEMA)
    written = store.replace_documents(path, new, 32)
    after = listing(path)
    changed = {int(d.split("=")[1]) for d in after if after[d] != before.get(d)}
    assert changed == set(written) and 1 <= len(written) <= 2
    read = store.read(spark, path, SCHEMA, written)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in {r[0] for r in read.select(F.input_file_name()).distinct().collect()}} == set(written)
    assert "PartitionFilters: [bucket" in read._jdf.queryExecution().toString() or "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()
    have = sorted(map(tuple, store.documents(spark, path, SCHEMA).collect()))
    assert len(have) == 798 + 3 + 1 and [t for d, _, t in have if d == 7] == ["new"] * 3
    # the same change again gives the same rows
    store.replace_documents(path, new, 32)
    assert sorted(map(tuple, store.documents(spark, path, SCHEMA).collect())) == have


def test_deleting(spark, tmp_path):
    path = str(tmp_path / "store")
    store.replace_documents(path, spark.createDataFrame([(i, 0, f"t{i}") for i in range(6)], SCHEMA), 8)
    before = listing(path)
    gone = spark.createDataFrame([(2,), (99,), (None,)], "doc_id long")
    written = store.delete_documents(path, SCHEMA, gone, 8)
    changed = {int(d.split("=")[1]) for d, f in listing(path).items() if f != before[d]}
    assert len(written) == 1 and changed == set(written)
    assert {r.doc_id for r in store.documents(spark, path, SCHEMA).collect()} == {0, 1, 3, 4, 5}
    assert store.delete_documents(path, SCHEMA, gone, 8) == []
    store.delete_documents(path, SCHEMA, spark.range(6).withColumnRenamed("id", "doc_id"), 8)
    assert store.documents(spark, path, SCHEMA).count() == 0


def test_ingest_replaces_by_fingerprint(spark, tmp_path):
    src, path, ck = (str(tmp_path / n) for n in ("src", "store", "ck"))
    schema = "doc_id long, text string"
    for rows in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, None)], [(3, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        before = listing(path) if os.path.exists(path) else {}
        ingest(spark, src, path, ck).awaitTermination()
    assert before == listing(path)  # the last batch had nothing new
    from corpuscle.streaming.ingest import SCHEMA as held

    assert {(r.doc_id, r.text) for r in store.documents(spark, path, held).collect()} == {(1, "a"), (2, "c"), (3, None)}

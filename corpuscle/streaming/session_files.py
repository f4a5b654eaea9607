"""Files of sessions as a stream of actions with keyed state: upload, register, update, delete, recover.

Actions: session_id, file_id, seq, action, and what an action carries: status, doc_id, doc_type, page_count, source_name,
source_uri, error_code, error_message; and cleanup_error with cleanup_step, what went wrong while a delete or recover
cleaned up, null if nothing did.  seq orders the actions of a file.

Each file's state is its row, or a mark that it is gone, with the last seq: an action at or below it was seen before and
changes nothing, so a batch that runs again, or a log that repeats itself, is safe.  Every other action gives one row with
its outcome and the file as it is afterwards; files() folds those rows to the files there are.

Outcomes: ok; exists (upload or register of a file there is); missing (update or delete of none); already_deleted (recover
of none); conflict (delete of a file that waits for recovery); skipped (recover of a file that doesn't); failed (the cleanup
failed: the file waits for recovery, with the step and the message).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ACTION = "session_id long, file_id long, seq long, action string, status string, doc_id string, doc_type string, page_count long, source_name string, source_uri string, error_code string, error_message string, cleanup_error string, cleanup_step string"
FIELDS = ("status", "doc_id", "doc_type", "page_count", "source_name", "source_uri", "error_code", "error_message", "created_seq", "updated_seq")
FILE = "status string, doc_id string, doc_type string, page_count long, source_name string, source_uri string, error_code string, error_message string, created_seq long, updated_seq long"
OUTCOME = f"session_id long, file_id long, seq long, action string, outcome string, {FILE}"
#: States in which an error stays, and the most characters of a message.
TROUBLED, MOST = ("failed", "recover_pending"), 500
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transition(file: dict | None, a: dict) -> tuple[dict | None, str]:
    """The file after an action, and the outcome."""
    kind, seq = a["action"], a["seq"]
    if kind in ("upload", "register"):
        if file:
            return file, "exists"
        own = dict.fromkeys(FIELDS) | {"source_name": a["source_name"], "source_uri": a["source_uri"], "created_seq": seq, "updated_seq": seq}
        return own | ({"status": "uploaded"} if kind == "upload" else {"status": "indexed", "doc_id": a["doc_id"], "doc_type": a["doc_type"]}), "ok"
    if not file:
        return None, "already_deleted" if kind == "recover" else "missing"
    if kind == "update":
        kept = {k: a[k] if a[k] is not None else file[k] for k in ("doc_id", "doc_type", "page_count", "source_name", "source_uri")}
        error = {k: a[k] if a["status"] in TROUBLED else None for k in ("error_code", "error_message")}
        return file | kept | error | {"status": a["status"], "updated_seq": seq}, "ok"
    waits = file["status"] == "recover_pending"
    if kind == "delete" and waits:
        return file, "conflict"
    if kind == "recover" and not waits:
        return file, "skipped"
    if a["cleanup_error"] is None:
        return None, "ok"
    said = a["cleanup_error"].strip()
    said = said if said.startswith("[step=") else f"[step={a['cleanup_step'] or ''}] {said}"
    return file | {"status": "recover_pending", "error_code": "delete_cleanup_failed", "error_message": said[:MOST], "updated_seq": seq}, "failed"


class SessionFiles(StatefulProcessor):
    def init(self, handle) -> None:
        self.file = handle.getValueState("file", f"last long, {FILE}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.file.get() if self.file.exists() else None
        last, file = (held[0], dict(zip(FIELDS, held[1:], strict=True))) if held else (-(1 << 63), None)
        file = file if file and file["status"] is not None else None
        actions = pd.concat(list(rows)).astype(object).sort_values("seq", kind="stable")
        out = []
        for a in actions.where(actions.notna(), None).to_dict("records"):
            if a["seq"] > last:
                a["page_count"] = None if a["page_count"] is None else int(a["page_count"])
                file, outcome = transition(file, a)
                last = int(a["seq"])
                out.append((int(key[0]), int(key[1]), last, a["action"], outcome, *(file or dict.fromkeys(FIELDS)).values()))
        self.file.update((last, *(file or dict.fromkeys(FIELDS)).values()))
        names = ["session_id", "file_id", "seq", "action", "outcome", *FIELDS]
        frame = pd.DataFrame(out, columns=names, dtype=object)
        yield frame.astype({n: "Int64" for n in ("session_id", "file_id", "seq", "page_count", "created_seq", "updated_seq")})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, actions: str, outcomes: str, checkpoint: str) -> StreamingQuery:
    """Read what is new in a folder of actions, and append an outcome for each action to another; state lives in the checkpoint.

    A batch's outcomes are a partition of their own, replaced if the batch runs again.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = spark.readStream.schema(ACTION).parquet(actions)
    found = stream.groupBy("session_id", "file_id").transformWithStateInPandas(SessionFiles(), OUTCOME, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(outcomes)

    return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(outcomes: DataFrame) -> DataFrame:
    """The files there are, from the outcomes of all actions: each file's last row, if it isn't gone."""
    last = Window.partitionBy("session_id", "file_id").orderBy(F.col("seq").desc())
    rows = outcomes.withColumn("n", F.row_number().over(last)).where("n = 1 and status is not null")
    return rows.select("session_id", "file_id", *FIELDS)


def deletable(files: DataFrame, gone: DataFrame) -> DataFrame:
    """What may be removed with the files of `gone`: kind (snapshot or upload) and its name, once.

    A document's snapshot goes if no other file has the document, an upload if no other file has the path; rows of `gone`
    don't count as references to each other.  A file without a document leaves no snapshot.
    """
    left = files.join(gone.select("session_id", "file_id"), ["session_id", "file_id"], "left_anti")
    docs = gone.where("doc_id is not null").select("doc_id").distinct().join(left.select("doc_id").distinct(), "doc_id", "left_anti")
    paths = gone.where("source_uri is not null").select("source_uri").distinct().join(left.select("source_uri").distinct(), "source_uri", "left_anti")
    return docs.select(F.lit("snapshot").alias("kind"), F.col("doc_id").alias("name")).union(paths.select(F.lit("upload"), "source_uri"))


def pending_outcomes(files: DataFrame, failing: DataFrame) -> DataFrame:
    """session_id, file_id, outcome of recovering every file that waits: failed where `failing` (session_id, file_id) says the cleanup fails again, else ok."""
    waits = files.where("status = 'recover_pending'").select("session_id", "file_id")
    return waits.join(failing.select("session_id", "file_id").distinct().withColumn("again", F.lit(True)), ["session_id", "file_id"], "left").select("session_id", "file_id", F.when(F.col("again"), "failed").otherwise("ok").alias("outcome"))

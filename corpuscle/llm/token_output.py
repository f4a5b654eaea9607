"""Token ids in binary shards, with a minimal perfect hash index from document keys to offsets.

A shard is one row of a Parquet table: raw little-endian ids (16 bits where the vocabulary allows, else 32), the
document bounds, and an index: a minimal perfect hash over the document keys, whose numbers lead to a 32-bit
fingerprint and the document's place.  A lookup hashes, compares one fingerprint and reads one slice.  Parquet keeps
the shards in any store Spark reaches, and its statistics on the first and last key let a reader skip whole files.

Documents are dealt to tasks by ranges of doc_id, null first, rows of equal doc_id by a hash of their texts, and sorted
there; a hot doc_id falls into several ranges, and shards are written whenever SHARD_IDS ids are gathered.

Nulls: a null text is an empty one and consists of its end id; a row with null doc_id is stored, and has no key.
Rows repeat freely; the index leads to the first of those with equal keys.  Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, mix64
from .perfect_hash import PerfectHash
from .units import UnitTable
from .words import slices

SHARD_IDS = 1 << 20
SCHEMA = "shard long, n_docs long, n_tokens long, first_key long, last_key long, width int, doc_ids array<long>, payload binary, bounds binary, hash binary, fingerprints binary, places binary"


def keys_of(doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash keys and 32-bit fingerprints of int64 ids."""
    k = doc_ids.astype(np.int64).view(np.uint64)
    return mix64(k + np.uint64(0x9E3779B97F4A7C15)), (mix64(k ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


class Encoder:
    """The tokenizers library behind a table of units; new units are encoded together, as one text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.dtype = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.sizes[i] = len(t)  # a byte-level token has one character a byte
        added = self.tok.get_added_tokens_decoder().values()
        self.encode = UnitTable(self._units, whole=tuple(t.content.encode() for t in added))  # texts with an added token are encoded whole

    def _units(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        joined = [i for i, u in enumerate(units) if u[0] in " \n" and not u[1:2].isspace() and not u[-1].isspace()]
        for at in range(0, len(joined), 2000):
            some = joined[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast(["".join(units[i] for i in some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(units[i].encode()) for i in some])) + 1
            ids = ids.astype(np.uint32)
            for i, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = ids[a:b]
        done = set(joined)
        rest = [i for i in range(len(units)) if i not in done]
        for i, e in zip(rest, self.tok.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out


@kept_by_worker
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def _shard(number: int, doc_ids: list, parts: list[bytes], dtype: str) -> pa.RecordBatch:
    width = np.dtype(dtype).itemsize
    bounds = np.concatenate([[0], np.cumsum([len(p) // width for p in parts])]).astype("<u8")
    known = [i for i in doc_ids if i is not None]
    ids, first = np.unique(np.array(known, np.int64), return_index=True)
    keys, prints = keys_of(ids)
    table = PerfectHash.build(keys)
    order = np.argsort(table.number(keys))
    row = [number, len(parts), int(bounds[-1]), known[0] if known else None, known[-1] if known else None, width, doc_ids, b"".join(parts), bounds.tobytes(), table.to_bytes(), prints[order].tobytes(), (first[order] + len(doc_ids) - len(known)).astype("<u4").tobytes()]
    types = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64())] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every text, add end_id, and write shards in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]):
        e = encoder(tokenizer)
        end = np.array([end_id], e.dtype).tobytes()
        number, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for whole in batches:
            for batch in slices(whole, 1):
                found, begin = e.encode(batch.column(1))
                found = found.astype(e.dtype)
                for doc_id, a, b in zip(batch.column(0).to_pylist(), begin, begin[1:], strict=False):
                    ids.append(doc_id)
                    parts.append(found[a:b].tobytes() + end)
                    size += len(parts[-1])
                    if size >= SHARD_IDS * len(end):
                        yield _shard(number, ids, parts, e.dtype)
                        number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield _shard(number, ids, parts, e.dtype)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit numbers), from the files."""
    shards = spark.read.schema(SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype("<u4")
                bounds = np.frombuffer(r["bounds"], "<u8").astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * n, pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    # one short row for each million ids
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    docs = shards.select("shard", "width", "payload", "bounds", "doc_ids").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(row, doc_id: int) -> np.ndarray | None:
    """A document's ids from its shard's row, by hash, fingerprint and slice; None if the shard hasn't got it."""
    key, mark = keys_of(np.array([doc_id], np.int64))
    at = int(PerfectHash.from_bytes(bytes(row["hash"])).number(key)[0])
    if at < 0 or np.frombuffer(row["fingerprints"], "<u4", 1, 4 * at)[0] != mark[0]:
        return None
    place = int(np.frombuffer(row["places"], "<u4", 1, 4 * at)[0])
    a, b = np.frombuffer(row["bounds"], "<u8", 2, 8 * place).tolist()
    return np.frombuffer(row["payload"], f"<u{row['width']}", b - a, a * row["width"])


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents asked for; files that hold none of their range are skipped."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    wanted = np.unique(np.array(doc_ids, np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<long>")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                some = wanted[(wanted >= r["first_key"]) & (wanted <= r["last_key"])].tolist()
                got = [(k, ids.tolist()) for k in some if (ids := lookup(r, k)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([i for _, i in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return shards.where((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0]))).mapInArrow(run, "doc_id long, ids array<long>")

"""Fill-in-middle: texts cut in prefix, middle and suffix, and rearranged so that the middle comes last.

A text's bytes are scanned for the two cuts (counted in code points), sentinels are inserted in a bytearray, and the
segments change places by one rotation made of three reversals, in place: beside the bytearray it takes one block.  The
inverse rotation gives the text back exactly, from output and form alone.  Where the cuts lie and which form a text takes
follows from a hash of seed and doc_id, so a lost task makes the same rows again.

Forms, for sentinels P, S, M: psm is P prefix S suffix M middle, spm is S suffix P prefix M middle, plain is the text.
A text that is empty or holds a sentinel is plain.  No sentinel can overlap another one, so the first S or M found in an
output is the one put in.

Nulls: a null text is empty; a null doc_id hashes as an empty string.  Repeated rows give repeated rows.  Other columns of
the input are ignored.  Each row is its own work: nothing is shuffled, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy
from .words import slices

SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Bytes scanned or moved at a time.
BLOCK = 1 << 16


def _leads(part: np.ndarray) -> np.ndarray:
    return (part & 0xC0) != 0x80


class Scan:
    """Code points of UTF-8 bytes: how many there are, and the byte where the k-th begins."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        self.upto = np.cumsum([0, *(np.count_nonzero(_leads(self.bytes[i : i + BLOCK])) for i in range(0, len(data), BLOCK))])
        self.n = int(self.upto[-1])

    def place(self, k: int) -> int:
        if k >= self.n:
            return len(self.bytes)
        block = int(np.searchsorted(self.upto, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(_leads(self.bytes[block * BLOCK : (block + 1) * BLOCK]))[k - self.upto[block]])


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """view[a:b] turned round in place, two blocks at a time."""
    while b - a > 1:
        k = min(BLOCK, (b - a) // 2)
        head = view[a : a + k][::-1].copy()
        view[a : a + k] = view[b - k : b][::-1]
        view[b - k : b] = head
        a, b = a + k, b - k


def exchange(buffer: bytearray, a: int, b: int, c: int) -> None:
    """The segments a..b and b..c change places: each is reversed, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, a, b)
    reverse(view, b, c)
    reverse(view, a, c)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from the first hex digits of a hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(data: bytes, draw: list[int], rate: int = 90, spm: int = 20, sentinels=SENTINELS) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output of one text."""
    scan = Scan(data)
    n = scan.n
    if not n or draw[2] % 100 >= rate or any(s in data for s in sentinels):
        return n, "plain", None, None, data
    first, last = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    i, j = scan.place(first), scan.place(last)
    p, s, m = sentinels
    out = bytearray(data)
    out[j:j], out[i:i], out[0:0] = s, m, p  # P prefix M middle S suffix
    i += len(p)
    j += len(p) + len(m)
    form = "spm" if draw[3] % 100 < spm else "psm"
    exchange(out, i if form == "psm" else 0, j, len(out))
    return n, form, first, last - first, bytes(out)


def restore(output: bytes, form: str, sentinels=SENTINELS) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    p, s, m = sentinels
    out = bytearray(output)
    middle = out.find(m)
    if form == "psm":
        i = out.find(s)
        exchange(out, i, middle, len(out))
        j = i + len(output) - middle
    else:
        at = out.find(p)
        exchange(out, 0, at, len(out))
        i, j = middle - at, len(output) - at
    del out[j : j + len(s)], out[i : i + len(m)], out[: len(p)]
    return bytes(out)


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, sentinels=SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output.  rate: per cent of texts that are cut; spm: per cent of those in that form."""

    @tidy
    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                ids = batch.column(0).to_pylist()
                n, form, prefix, middle, out = zip(*(transform(b or b"", draws(seed, i), rate, spm, sentinels) for i, b in zip(ids, texts(batch.column(1)), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """Rows of fill_in_middle with the text of each, from its output and form, as `restored`."""

    @tidy
    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index("output")
            for batch in slices(whole, at):
                out = [restore(b, f, sentinels) for b, f in zip(texts(batch.column(at)), batch.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    rows = rows.drop("restored")
    return rows.mapInArrow(run, rows.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", restored string")


#: The query's rows, with the parameters of the contract.
FILL_MIDDLE_SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS x FROM documents),
g AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS c1, ('0x' || x[9:16])::BIGINT % (n + 1) AS c2, ('0x' || x[17:24])::BIGINT % 100 AS c3, ('0x' || x[25:32])::BIGINT % 100 AS c4 FROM h),
f AS (SELECT doc_id, t, n, least(c1, c2) AS i, greatest(c1, c2) AS j, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, i) AS prefix, substring(t, i + 1, j - i) AS middle, substring(t, j + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p"""

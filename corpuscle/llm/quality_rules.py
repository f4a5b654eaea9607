"""Quality rules kept as a ledger: every rule is evaluated once, its failure is a bit and its measurement stays.

A policy is a version and a mask of rules; a document passes if it fails none of them.  Policies and ablations (what
would be kept without one rule, what one rule alone removes) are bit operations and sums over the ledger: no text is
read again.

Nulls: a null text has no words and fails the rule on their number.  Rows repeat freely.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .words import grams, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_stacked")
_SYMBOLS = b"#*$%&|<>"
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_BLANK = b" \t\n\r\x0b\x0c"

#: name, failure as a condition on the measures; the place in this list is the bit and never changes.
RULES: list[tuple[str, Column]] = [
    ("too_few_words", lambda: F.col("n_words") < 10),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("mean_word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    ("symbol_share", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    ("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
    ("few_letters", lambda: 10 * F.col("n_letters") < 3 * F.col("word_chars")),
    ("stacked_words", lambda: 100 * F.col("n_stacked") > 20 * F.col("n_words")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]
#: Versions of the policy.
POLICIES = {1: BASE, 2: (1 << len(RULES)) - 1}


def measure(b: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    words = (b or b"").split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    a = np.frombuffer(b, np.uint8)
    chars = int(((a & 0xC0) != 0x80).sum()) - (len(b) - len(b.translate(None, _BLANK)))
    letters = int(_ASCII_LETTERS[a].sum()) + int((a >= 0xC3).sum())  # beyond ASCII, each lead byte counts as a letter
    lines = [x for x in b.split(b"\n") if x.strip(_BLANK)]
    h = words_of(pa.array([b], pa.binary())).hashes
    repeat = 0
    if n >= 5:
        _, at, count = np.unique(grams(h, 5), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        many = np.flatnonzero(count[at] > 1)
        edge[many] += 1
        edge[many + 5] -= 1
        repeat = int((np.cumsum(edge[:n]) > 0).sum())
    return n, chars, len(b) - len(b.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), letters, int((h[1:] == h[:-1]).sum())


def rule_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, and failures: one bit for each rule."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = np.array([measure(b) for b in texts(batch.column(1))], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return found.withColumn("failures", failures)


def passes(mask: int) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(ledger: DataFrame, version: int) -> DataFrame:
    """The ledger with policy_version and kept."""
    return ledger.withColumns({"policy_version": F.lit(version), "kept": passes(POLICIES[version])})


def ablations(ledger: DataFrame, version: int) -> DataFrame:
    """For each rule of the policy: documents that fail it, fail only it, and are kept without it; one pass over the ledger."""
    mask = POLICIES[version]
    rules = [(name, bit) for name, bit in BIT.items() if mask & bit]
    f = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    counts = [F.struct(F.lit(name).alias("rule"), F.sum(((f.bitwiseAND(F.lit(bit).cast("long"))) != 0).cast("long")).alias("n_failed"), F.sum((f == bit).cast("long")).alias("n_only"), F.sum(passes(mask & ~bit).cast("long")).alias("n_kept_without")) for name, bit in rules]
    return ledger.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")

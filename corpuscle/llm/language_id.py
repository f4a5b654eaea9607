"""Language identification by a bidirectional gated recurrent network over bytes, trained here.

The network reads windows of WINDOW bytes of the text (runs of ASCII blanks, digits and punctuation become one blank), forwards and
backwards, and labels every position; a document's probabilities are the mean over all its positions.  Training is
backpropagation through time in numpy on the driver, over a bounded sample: at most `per_language` different texts of each
of at most LANGUAGES languages, chosen by a hash, and PIECES pieces of each, spread over the whole text.  Prediction reads every byte.

Nulls: a null text, or one without a letter, is `und` with score 0.  Rows with null lang are never learned from; without any
labelled row every prediction is `und`.  Rows repeat freely.  Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, tidy

WINDOW = 96
HIDDEN = 6
PIECES = 6
#: Labels that are learned, those with the most different texts: a bound for tables whose labels are no languages.
LANGUAGES = 1000
_FILL = re.compile(rb"[\x00-@\[-`{-\x7f]+")
_LETTER = regex.compile(r"\p{L}")


def clean(text: bytes) -> np.ndarray:
    return np.frombuffer(_FILL.sub(b" ", text), np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Piecewise linear, so that a step costs no exponentials."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1, out=x)


@dataclass
class Direction:
    """Gated recurrent cell: a table of inputs by byte and a recurrent matrix, for the update, reset and candidate parts."""

    table: np.ndarray  # 256 x 3H
    gates: np.ndarray  # H x 2H
    cand: np.ndarray  # H x H

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: T x B bytes.  States T x B x H; with keep also what the backward pass needs."""
        hidden = self.cand.shape[0]
        h = np.zeros((x.shape[1], hidden), np.float32)
        out, kept = np.empty((*x.shape, hidden), np.float32), []
        for t in range(len(x)):
            a = self.table[x[t]]
            g = _sigmoid(h @ self.gates + a[:, : 2 * hidden])
            z, r = g[:, :hidden], g[:, hidden:]
            c = np.tanh((r * h) @ self.cand + a[:, 2 * hidden :])
            if keep:
                kept.append((h, z, r, c))
            h = out[t] = h + z * (c - h)
        return out, kept

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        hidden = self.cand.shape[0]
        d_table, d_gates, d_cand = (np.zeros_like(p) for p in (self.table, self.gates, self.cand))
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + d_out[t]
            dz, dc, d_prev = dh * (c - h), dh * z * (1 - c * c), dh * (1 - z)
            drh = dc @ self.cand.T
            d_cand += (r * h).T @ dc
            dg = np.concatenate((dz, drh * h), axis=1)
            g = np.concatenate((z, r), axis=1)
            dg *= np.float32(0.25) * ((g > 0) & (g < 1))
            d_gates += h.T @ dg
            dh = d_prev + drh * r + dg @ self.gates.T
            np.add.at(d_table, x[t], np.concatenate((dg, dc), axis=1))
        return [d_table, d_gates, d_cand]


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # 2H x L
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.gates, self.ahead.cand, self.back.table, self.back.gates, self.back.cand, self.out, self.bias]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """T x B x L probabilities of every position."""
        f, _ = self.ahead.forward(x)
        b, _ = self.back.forward(x[::-1])
        n = self.out.shape[0] // 2
        y = f.reshape(-1, n) @ self.out[:n] + b[::-1].reshape(-1, n) @ self.out[n:] + self.bias
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y.reshape(*x.shape, -1)

    def step(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all positions."""
        f, kf = self.ahead.forward(x, True)
        b, kb = self.back.forward(x[::-1], True)
        both = np.concatenate((f, b[::-1]), axis=2)
        y = both @ self.out + self.bias
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        y[:, np.arange(x.shape[1]), label] -= 1
        y /= y.shape[0] * y.shape[1]
        d_both = y @ self.out.T
        n = f.shape[2]
        return [*self.ahead.backward(x, kf, d_both[:, :, :n]), *self.back.backward(x[::-1], kb, np.ascontiguousarray(d_both[::-1, :, n:])), both.reshape(-1, 2 * n).T @ y.reshape(-1, y.shape[2]), y.sum(axis=(0, 1))]


def train(pieces: list[np.ndarray], labels: list[str], steps: int = 300, batch: int = 128, seed: int = 7) -> Network:
    """Adam over random batches of windows, languages drawn alike."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    cell = lambda: Direction(draw(256, 3 * HIDDEN), draw(HIDDEN, 2 * HIDDEN), draw(HIDDEN, HIDDEN))
    net = Network(languages, cell(), cell(), draw(2 * HIDDEN, len(languages)), np.zeros(len(languages), np.float32))
    by = [[p for p, x in zip(pieces, labels, strict=True) if x == lang] for lang in languages]
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for i in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        x = np.full((WINDOW, batch), 32, np.uint8)
        for j, lang in enumerate(label):
            p = by[lang][rng.integers(len(by[lang]))]
            at = rng.integers(0, max(1, len(p) - WINDOW + 1))
            p = p[at : at + WINDOW]
            x[: len(p), j] = p
        rate = 0.02 * min(1.0, 2 * (1 - i / (steps + 1)))
        for k, (p, g) in enumerate(zip(net.params(), net.step(x, label), strict=True)):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


def sample(labelled: DataFrame, per_language: int) -> tuple[list[np.ndarray], list[str]]:
    """Pieces of at most per_language documents of each language; the bound holds whatever the table's size."""
    n = F.greatest(F.octet_length("text") - 4 * WINDOW, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.col("b").substr((n * i / F.lit(max(1, PIECES - 1))).cast("int") + 1, F.lit(4 * WINDOW)))
    order = Window.partitionBy("lang").orderBy("h")
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # of each language the share of different texts that holds about eight times the sample: few rows reach the window, however
    # many parts.  Copies share their hash, so different hashes are counted, not rows
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("c")).orderBy(F.col("c").desc(), "lang").limit(LANGUAGES).collect()
    shares = [x for r in sizes for x in (F.lit(r.lang), F.lit(int(min(1.0, 8 * per_language / max(r.c, 1)) * 2**62)))]
    rows = (
        labelled.where(F.col("h").bitwiseAND(F.lit(2**62 - 1)) <= F.create_map(*shares)[F.col("lang")] if shares else F.lit(False))
        .select("lang", "h", F.col("text").cast("binary").alias("b"), "text")
        .select("lang", "h", pieces.alias("p"))
        .groupBy("lang", "h")
        .agg(F.first("p").alias("p"))  # copies count once
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= per_language)
        .orderBy("lang", "k")
        .select("lang", "p")
        .toArrow()
    )
    found = [(clean(bytes(b)), lang) for lang, p in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for b in dict.fromkeys(p)]
    found = [(p, lang) for p, lang in found if len(p) > 1]
    return [p for p, _ in found], [lang for _, lang in found]


def predict(net: Network, batch: list[bytes | None], at_once: int = 2048) -> tuple[list[str], list[float]]:
    """Most probable language and its probability for each text, reading all of it in windows."""
    letters = [b is not None and bool(_LETTER.search(b.decode("utf-8", "replace"))) for b in batch]
    cleaned = [clean(b) if ok else np.zeros(0, np.uint8) for b, ok in zip(batch, letters, strict=True)]
    sizes = np.array([len(c) for c in cleaned])
    windows = -(-sizes // WINDOW)
    x = np.full((int(windows.sum()), WINDOW), 32, np.uint8)
    for c, end, w in zip(cleaned, np.cumsum(windows), windows, strict=True):
        x[end - w : end].reshape(-1)[: len(c)] = c
    owner = np.repeat(np.arange(len(batch)), windows)
    used = np.full(len(x), WINDOW)
    used[np.cumsum(windows)[windows > 0] - 1] = (sizes - (windows - 1) * WINDOW)[windows > 0]
    total = np.zeros((len(batch), len(net.languages)))
    for at in range(0, len(x), at_once):
        part = np.ascontiguousarray(x[at : at + at_once].T)
        p = net.positions(part)
        if (used[at : at + at_once] < WINDOW).any():
            p *= (np.arange(WINDOW)[:, None] < used[at : at + at_once])[:, :, None]
        np.add.at(total, owner[at : at + at_once], p.sum(axis=0))
    total /= np.maximum(sizes, 1)[:, None]
    best = total.argmax(axis=1)
    return [net.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [min(1.0, float(total[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]


def held_out():
    """Rows never learned from: the remainder of their id's checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """row (the document as it came), lang_pred, score.

    Where nothing is labelled, lang_pred is `und` and score 0.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    pieces, labels = sample(docs.where(~held_out()).select(text.alias("text"), lang.alias("lang")), per_language)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = docs.columns.index("text")
    as_it_is = isinstance(docs.schema["text"].dataType, T.StringType)
    if not as_it_is:
        rows = rows.withColumn("text", text)
    if not pieces:
        return rows.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    net = docs.sparkSession.sparkContext.broadcast(train(pieces, labels))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                lang, score = predict(net.value, texts(batch.column(0).field(at) if as_it_is else batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.  A row without doc_id counts as not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identified(docs, per_language).select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, languages: list[str] | None = None, min_score: float = 0.3, per_language: int = 400) -> DataFrame:
    """The documents in a known language (or one of those given), with their own columns.

    Rejected: `und`, and scores below min_score, which no text that is mostly one language has.
    """
    fine = (F.col("lang_pred") != "und") & (F.col("score") >= min_score)
    if languages is not None:
        fine &= F.col("lang_pred").isin(languages)
    return identified(docs, per_language).where(fine).select("row.*")

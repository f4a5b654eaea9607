"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, with count-vector R-trees.

Tokens (64-bit hashes of n-grams) fall into `GROUPS` groups; a document's token counts by group are a point, and the
overlap of two documents, or of two boxes of points, is at most the sum of the coordinate-wise minima.  R-trees over
such points find the pairs that may reach the threshold; the token sets then decide.

So that trees stay small and separate, points meet only where they must: two sets of similarity t or more share a
token among the first n - ceil(t n) + 1 of each, in any order common to all documents.  The order used puts tokens
that occur once first and frequent ones last, so documents that only share passages have no key in common.

1. Equal sets become one class; a star of links to its smallest doc_id stands for it.
2. Frequent tokens are those whose summed counts reach `max(32, tokens / 2**20)`: at most 2**20 of them, broadcast.
3. A sketch over a fixed share of all tokens (those with low hashes, enough to fill the keys) tells tokens that occur
   once.  Of a corpus too large for it, it counts every k-th different text; any order is right, and passages of more than
   about k texts still come late in it.  A second sketch, or beyond its size a grouped count, over the keys tells
   documents that share none with any other: these are finished.
4. Every document is checked against the centre with which it shares most keys: one verified link for each member of a
   dense group, not all its pairs.  What these links connect is a group.
5. Keys whose documents are not all linked already go to the R-trees, in cells of at most about 2 * CELL points: the
   dominant group of a key is cut into parts that need not meet each other.  Trees join node by node, passing over
   boxes of the same group, of sizes that can't match, and of too little summed minima.  Pairs found are verified.
6. Components of all links.

A document in very many pairs meets them in parts of about PART, each with its own copy of the set.

Nothing is capped: each pair that shares a key and lies in different groups is compared.  Nulls: a null text, or one
without words, has an empty set and links with nothing.  Rows with the same doc_id are one vertex.  Rows with null
doc_id are returned with a null component and link with nothing.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, mix64, saved, tidy
from .components import connected_components
from .sketch import MAX_WIDTH, counted, fits, maybe_repeated, merged_bits, repeated_bits, width_for
from .words import grams, ranges, slices, words_of

GROUPS = 64
LEAF = 32
CELL = 2048
#: Tokens of which a task counts repeats at a time.
TALLY = 1 << 19
#: Different sets a task remembers.
SEEN = 1 << 16
#: Pairs of one document that meet its set together.
PART = 512


def token_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; fewer words than n make one."""
    words = words_of(column, lower=True)
    h, g = words.hashes, grams(words.hashes, n)
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        else:
            yield mix64(grams(h[a:b], b - a) + np.uint64(b - a)) if b > a else h[:0]


def _ceil(n, num: int, den: int):
    return (num * n + den - 1) // den


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


class _Order:
    """The common order of tokens: by frequency class, then by hash.

    Classes: 0 low tokens that occur once, 1 tokens that aren't low, 2 other low tokens, from 3 frequent tokens.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, low: np.uint64, bits: np.ndarray, every: int):
        at = np.argsort(tokens)
        self.every = every  # beyond 1, a token that isn't met twice among the counted texts may still occur in others
        self.tokens, self.rank, self.low, self.bits = tokens[at], np.log2(counts[at]).astype(np.int64) + 2, low, bits
        size = max(8, min(24, int(np.ceil(np.log2(16 * len(tokens) + 1)))))
        self.shift = np.uint64(64 - size)
        self.mark = np.zeros(1 << size, bool)  # spares most tokens the search
        self.mark[(tokens >> self.shift).astype(np.int64)] = True

    def prefix(self, tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The document's keys, in order, which of them another document may have, and its number of tokens that aren't frequent."""
        n = len(tokens)
        if not n or n * den // num == n:  # only an equal set can link with it
            return tokens[:0], np.zeros(0, bool), 0
        p = n - _ceil(n, num, den) + 1
        rank = np.ones(n, np.int64)
        low = np.searchsorted(tokens, self.low)
        rank[:low] = 2 * maybe_repeated(self.bits, tokens[:low])
        some = np.flatnonzero(self.mark[(tokens >> self.shift).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.tokens, tokens[some]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[some]
            rank[some[hit]] = self.rank[at[hit]]
        first = np.argsort(rank, kind="stable")[:p]
        return tokens[first], (rank[first] > 0) | (self.every > 1), int((rank < 3).sum())


def _unseen(batches: Iterator[pa.RecordBatch], n: int):
    """(doc_id, digest, tokens) of each document whose set this task doesn't remember."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for batch in slices(whole, 1):
            for doc_id, t in zip(batch.column(0).to_pylist(), token_sets(batch.column(1), n), strict=True):
                if doc_id is not None and len(t) and (d := _digest(t)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    yield doc_id, d, t


def _classes_and_counts(docs: DataFrame, n: int, low: np.uint64, width: int, every: int) -> DataFrame:
    """kind 0: doc_id, set size, digest; kind 1: a token and how often a task met it (twice or more); kind 2: counters of low tokens, in every k-th text."""

    def run(batches):
        held, some, size, seen = [], [], 0, set()

        def batch_of(kind: int, *cols):
            n = len(cols[0])
            types = [pa.int64()] * 4 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8))] + [pa.array(c, t) if c is not None else pa.nulls(n, t) for c, t in zip([*cols, *[None] * (6 - len(cols))], types, strict=True)], ["kind", "id", "n", "d1", "d2", "one", "more"])

        def tally():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            yield batch_of(1, t[c > 1].view(np.int64), c[c > 1].astype(np.int64))
            if some:
                found = counted([x[: np.searchsorted(x, low)] for x in some], width, 1)
                for at in range(0, len(found), 512):
                    b, one, more = zip(*found[at : at + 512], strict=True)
                    yield batch_of(2, np.array(b, np.int64), None, None, None, one, more)

        for whole in batches:
            for batch in slices(whole, 1):
                out: list[list] = [[], [], [], []]
                for doc_id, t in zip(batch.column(0).to_pylist(), token_sets(batch.column(1), n), strict=True):
                    d = _digest(t)
                    for col, v in zip(out, (doc_id, len(t), *d), strict=True):
                        col.append(v)
                    if d not in seen and len(t):
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        held.append(t)
                        if d[0] % every == 0:
                            some.append(t)
                        size += len(t)
                yield batch_of(0, *out)
                if size >= TALLY:
                    yield from tally()
                    held, some, size = [], [], 0
        if held:
            yield from tally()

    return saved(docs.mapInArrow(tidy(run), "kind byte, id long, n long, d1 long, d2 long, one binary, more binary"), "sets")


def _join_rows(docs: DataFrame, n: int, order, bits, num: int, den: int) -> DataFrame:
    """For each document with a key that may be shared: keys, their places, the point, the whole set."""

    def run(batches):
        cols: list[list] = [[] for _ in range(9)]

        def out():
            types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc", "d1", "d2", "n", "rare", "keys", "places", "point", "tokens"])

        size = 0
        for doc_id, d, t in _unseen(batches, n):
            keys, shared, rare = order.value.prefix(t, num, den)
            at = np.flatnonzero(shared)
            if bits is not None:
                at = at[maybe_repeated(bits.value, keys[at])]
            if len(at):
                point = np.bincount((mix64(t) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.uint32)
                for c, v in zip(cols, (doc_id, *d, len(t), rare, keys[at].view(np.int64), at.astype(np.int32), point.tobytes(), t.tobytes()), strict=True):
                    c.append(v)
                size += len(t)
                if size >= 1 << 17:
                    yield out()
                    cols, size = [[] for _ in range(9)], 0
        if cols[0]:
            yield out()

    return docs.mapInArrow(tidy(run), "doc long, d1 long, d2 long, n long, rare long, keys array<long>, places array<int>, point binary, tokens binary")


def _near_enough(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs a, b whose points allow the threshold."""
    points = rows.select("doc", "point")

    def run(batches):
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, GROUPS).astype(np.int64) for i in (2, 3))
            both = np.minimum(p, q).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array((num + den) * both >= num * (p + q).sum(axis=1)))

    both = pairs.join(points.toDF("a", "p"), "a").join(points.toDF("b", "q"), "b")
    return both.select("a", "b", "p", "q").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs a, b whose sets reach the threshold; a document of many pairs meets them in parts."""
    pairs = saved(pairs, "pairs")
    dealt, sets = pairs, {}
    for side, other in (("a", "b"), ("b", "a")):
        many = saved(pairs.groupBy(side).agg(F.count("*").alias("c")).where(F.col("c") > PART).select(side, F.ceil(F.col("c") / PART).cast("int").alias("parts")), "many")
        parts = F.coalesce("parts", F.lit(1))
        dealt = dealt.join(if_small(many), side, "left").withColumn(f"part_{side}", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        named = if_small(saved(pairs.select(side).distinct(), "named"))
        some = rows.select(F.col("doc").alias(side), F.col("tokens").alias(f"set_{side}")).join(named, side, "left_semi").join(if_small(many), side, "left")
        sets[side] = some.select(side, f"set_{side}", F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"part_{side}"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                keep = []
                for s, t in zip(batch.column(2), batch.column(3), strict=True):
                    s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                    both = np.concatenate((s, t))
                    both.sort()
                    both = int((both[1:] == both[:-1]).sum())
                    keep.append(den * both >= num * (len(s) + len(t) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = dealt.join(sets["a"], ["a", "part_a"]).join(sets["b"], ["b", "part_b"])
    return both.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


class _Node:
    __slots__ = ("comp", "hi", "kids", "max_n", "min_n", "rows")


def _tree(rows: np.ndarray, points: np.ndarray, n: np.ndarray, comp: np.ndarray) -> _Node:
    """A packed R-tree: halves along the widest side of the box until a leaf is left."""
    x = _Node()
    x.rows, x.kids = rows, ()
    x.hi, x.min_n, x.max_n = points[rows].max(axis=0), int(n[rows].min()), int(n[rows].max())
    x.comp = int(comp[rows[0]]) if (comp[rows] == comp[rows[0]]).all() else None
    if len(rows) > LEAF:
        wide = x.hi.astype(np.int64) - points[rows].min(axis=0)
        by = n[rows] if x.max_n - x.min_n >= wide.max() else points[rows, wide.argmax()]
        at = np.argsort(by, kind="stable")
        half = len(rows) // 2
        x.kids = (_tree(rows[at[:half]], points, n, comp), _tree(rows[at[half:]], points, n, comp))
    return x


def tree_join(points: np.ndarray, n: np.ndarray, place: np.ndarray, comp: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different groups whose summed coordinate minima, sizes and key places allow the threshold."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    need = lambda total: -(-num * total // (num + den))  # noqa: E731  least overlap of two sets of that size together

    def leaves(a: np.ndarray, b: np.ndarray, same: bool):
        total = n[a][:, None] + n[b][None, :]
        least = need(total)
        ok = comp[a][:, None] != comp[b][None, :]
        ok &= np.minimum((n[a] - place[a])[:, None], (n[b] - place[b])[None, :]) >= least
        ok &= np.minimum(n[a][:, None], n[b][None, :]) >= least
        if same:
            ok &= np.tri(len(a), len(b), -1, dtype=bool)
        i, j = np.nonzero(ok)
        for at in range(0, len(i), 8192):
            p, q = a[i[at : at + 8192]], b[j[at : at + 8192]]
            good = np.minimum(points[p], points[q]).sum(axis=1) >= least[i[at : at + 8192], j[at : at + 8192]]
            found.append((p[good], q[good]))

    todo = [(root := _tree(np.arange(len(n)), points, n, comp), root)]
    while todo:
        x, y = todo.pop()
        if x.comp is not None and x.comp == y.comp or x is y and x.comp is not None:
            continue
        if x is not y and (den * min(x.max_n, y.max_n) < num * max(x.min_n, y.min_n) or int(np.minimum(x.hi, y.hi).sum()) < need(x.min_n + y.min_n)):
            continue
        if x is y:
            if x.kids:
                todo += [(x.kids[0], x.kids[0]), (x.kids[1], x.kids[1]), (x.kids[0], x.kids[1])]
            else:
                leaves(x.rows, x.rows, True)
        elif x.kids and (len(x.rows) >= len(y.rows) or not y.kids):
            todo += [(k, y) for k in x.kids]
        elif y.kids:
            todo += [(x, k) for k in y.kids]
        else:
            leaves(x.rows, y.rows, False)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stars(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: each document and, of the centres of its keys with a size within reach, the one it shares most with.

    A key has two centres: one with few rare tokens, as copies with few changes have, and one by a hash.
    """
    keyed = rows.select("doc", "n", "rare", F.explode("keys").alias("key"))
    who = F.struct("doc", "n")
    centres = keyed.groupBy("key").agg(F.min_by(who, F.struct("rare", "doc")).alias("x"), F.min_by(who, F.xxhash64("doc")).alias("y"), F.max("doc").alias("most"), F.min("doc").alias("least")).where("most <> least")
    pairs = keyed.select("key", F.col("doc").alias("a"), "n").join(centres.select("key", "x", "y"), "key").select("a", "n", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
    pairs = pairs.where((F.col("a") != F.col("b.doc")) & (den * F.least("n", "b.n") >= num * F.greatest("n", "b.n"))).select("a", F.col("b.doc").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def leaf_join(first: np.ndarray, size: np.ndarray, points: np.ndarray, n: np.ndarray, place: np.ndarray, comp: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """tree_join for many sets of rows first[i], ... of size[i], each of at most a leaf's size, all at once."""
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    rows = ranges(first, size)
    i, j = np.repeat(rows, inside), ranges(rows - inside, inside)
    least = -(-num * (n[i] + n[j]) // (num + den))
    ok = (comp[i] != comp[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= least) & (np.minimum(n[i], n[j]) >= least)
    i, j, least = i[ok], j[ok], least[ok]
    good = [np.minimum(points[i[at : at + 8192]], points[j[at : at + 8192]]).sum(axis=1) >= least[at : at + 8192] for at in range(0, len(i), 8192)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def _candidates(cells: DataFrame, num: int, den: int) -> DataFrame:
    """cells: key, cell, doc, n, place, comp, point; rows of one cell stand together in a partition."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def search(t: pa.Table, cuts: np.ndarray):
            doc, n, place, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "n", "place", "comp"))
            points = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint32).reshape(-1, GROUPS)
            size = np.diff(cuts)
            small = size <= LEAF
            found = [leaf_join(cuts[:-1][small], size[small], points, n, place, comp, num, den)]
            for at, end in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist(), strict=True):
                i, j = tree_join(points[at:end], n[at:end], place[at:end], comp[at:end], num, den)
                found.append((i + at, j + at))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            p = np.unique(np.stack((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])), axis=1), axis=0)  # what several keys find goes out once
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            key, cell = (t.column(c).to_numpy() for c in ("key", "cell"))
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1))
            if len(cuts) > 1:  # the last cell may go on
                yield search(t.slice(0, cuts[-1]), cuts)
                held = t.slice(cuts[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield search(t, np.array([0, t.num_rows]))

    return cells.mapInArrow(tidy(run), "a long, b long").distinct()


def _cells(rows: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of every key that still has documents of different groups, dealt to cells."""
    keyed = rows.join(groups, "doc", "left").select("doc", "n", "d1", F.coalesce("comp", "doc").alias("comp"), F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.places").alias("place"), "doc", "n", "d1", "comp")
    by_group = keyed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    keys = by_group.groupBy("key").agg(F.sum("c").alias("total"), F.max("c").alias("top"), F.max_by("comp", "c").alias("dominant"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("groups")).where("groups > 1")
    r = keyed.join(keys, "key")
    # some partner's size must be within reach, given the key's place
    r = r.where((F.floor((F.col("n") - F.col("place")) * den / F.lit(num)) - F.col("place") >= F.col("lo")) & (F.ceil(F.col("n") * num / F.lit(den)) <= F.col("hi")))
    inside = F.when(F.col("total") <= CELL, F.lit(0)).otherwise(F.ceil(F.col("top") / CELL).cast("int"))
    rest = F.when(F.col("total") <= CELL, F.lit(1)).otherwise(F.ceil((F.col("total") - F.col("top")) / CELL).cast("int"))
    r = r.withColumns({"parts": inside, "others": rest, "deal": F.xxhash64("doc", "key")})
    cell = lambda i, j: F.shiftleft(i.cast("long"), 40).bitwiseOR(j.cast("long"))  # noqa: E731  i 0: among the others
    i, j = F.pmod("deal", F.greatest("parts", F.lit(1))).cast("int") + 1, F.pmod("deal", "others").cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda k: cell(F.lit(0), F.shiftleft(F.least(j, k).cast("long"), 20) + F.greatest(j, k))
    dominant = F.transform(span(F.col("others")), lambda k: cell(i, k))
    other = F.concat(F.transform(F.filter(F.sequence(F.lit(0), F.col("parts")), lambda k: k > 0), lambda k: cell(k, j)), F.transform(span(F.col("others")), pair))
    lone = F.array(F.lit(0).cast("long"))
    r = r.withColumn("cell", F.explode(F.when(F.col("total") <= CELL, lone).when(F.col("comp") == F.col("dominant"), dominant).otherwise(other)))
    r = saved(r.select("key", "cell", "doc", "d1", "n", "place", "comp"), "cells")
    return r.join(rows.select("doc", "d1", "point"), ["doc", "d1"]).select("key", "cell", "doc", "n", "place", "comp", "point").repartition("key", "cell").sortWithinPartitions("key", "cell")


def ngram_links(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(documents: id, n, d1, d2; links: a, b) - the links connect exactly the documents the similarity connects."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, 2.5 * (den - num) / den)  # more than the keys, so that tokens that occur once can fill them
    low, tokens = np.uint64(min(int(share * 2**64), 2**64 - 1)), share * size / 6  # about six bytes a word
    every = max(1, int(np.ceil(2 * tokens / MAX_WIDTH)))
    width = width_for(tokens / every, 1.5)
    found = _classes_and_counts(docs, n, low, width, every)
    sets = found.where("kind = 0").select("id", "n", "d1", "d2")
    total, keys = sets.agg(F.sum("n"), F.sum(F.col("n") * (den - num) / F.lit(den) + 1)).first()
    floor = max(32, (total or 0) // (1 << 20))
    hot = found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()  # at most 2**20 rows: their counts sum to no more than the total
    once = merged_bits(found.where("kind = 2").select(F.col("id").cast("int").alias("block"), "one", "more"), width, 1)
    order = spark.sparkContext.broadcast(_Order(hot.column("id").to_numpy().view(np.uint64), hot.column("n").to_numpy(), low, once, every))

    def keys_of(batch):
        for _, _, t in _unseen(iter([batch]), n):
            keys, shared, _ = order.value.prefix(t, num, den)
            yield keys[shared]

    bits = None
    if fits(keys or 0):
        bits = spark.sparkContext.broadcast(repeated_bits(docs, keys_of, width_for((keys or 0) / 4)))
        rows = _join_rows(docs, n, order, bits, num, den)
    else:
        rows = _join_rows(_sharing(docs, n, order, num, den), n, order, None, num, den)
    copies = sets.where("n > 0 AND id IS NOT NULL")
    first = copies.groupBy("d1", "d2").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    same = saved(copies.join(first, ["d1", "d2"]).where("id <> b").select("id", "b", "d1", "d2"), "same")
    rows = saved(rows.join(if_small(same.select(F.col("id").alias("doc"), "d1", "d2")), ["doc", "d1", "d2"], "left_anti"), "points")  # one document of each set
    order.destroy()  # all that needs it is written
    if bits is not None:
        bits.destroy()

    star_links = saved(_verified(_near_enough(saved(_stars(rows, num, den), "centres"), rows, num, den), rows, num, den), "stars")
    groups = connected_components(star_links, "groups").select(F.col("vertex").alias("doc"), F.col("component").alias("comp"))
    pairs = _candidates(_cells(rows.drop("tokens"), groups, num, den), num, den)
    links = saved(_verified(pairs, rows, num, den), "links")
    return sets, groups.select(F.col("doc").alias("a"), F.col("comp").alias("b")).union(links).union(same.select(F.col("id").alias("a"), "b"))


def _sharing(docs: DataFrame, n: int, order, num: int, den: int) -> DataFrame:
    """The documents that have a key another one has, by a grouped count of all keys."""

    def run(batches):
        for doc_id, _, t in _unseen(batches, n):
            keys, shared, _ = order.value.prefix(t, num, den)
            if shared.any():
                keys = keys[shared].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), doc_id)), pa.array(keys)], ["doc_id", "key"])

    keyed = saved(docs.mapInArrow(tidy(run), "doc_id long, key long"), "keys")
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("c")).where("c > 1").select("key")
    return docs.join(saved(keyed.join(shared, "key", "left_semi").select("doc_id").distinct(), "sharing"), "doc_id", "left_semi")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked, directly or not, by a similarity of num / den or more."""
    sets, links = ngram_links(docs, n, *threshold)
    found = connected_components(links)
    return (
        sets.join(found, F.col("id") == F.col("vertex"), "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents with their own columns, less all but the smallest doc_id of each group of linked documents.

    Rows without doc_id stay; rows of one doc_id stay or go together.
    """
    gone = saved(ngram_jaccard_join(docs, n, threshold).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

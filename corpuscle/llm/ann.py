"""Approximate nearest neighbours by largest inner product, with a forest of hash-prefix trees.

A tree writes each vector as a string of BITS signs of random projections (inner products become angles by one more
coordinate, as long as the longest vector requires; it is 0 for a query).  Trees are sorted arrays of these strings,
cut by their first bits into buckets of about BUCKET vectors, each sorted and searched in one task.

1. Descent: in every tree a query takes the longest prefix that at least NEAR vectors of its bucket share.  The best
   `k` over all trees give a similarity s that the true k-th neighbour has at least.
2. Ascent, in step over all trees: up to the prefix length x at which a vector of similarity s is missed by every
   tree with probability of at most MISS, (1 - p**x) ** trees with p = 1 - angle / pi.  Queries in a dense place stop deep;
   where all vectors are about equally far they climb to the top, and one tree's buckets, all of them, do.
3. All candidates under that prefix are scored in double precision; no number of candidates is capped.

Vectors travel as the bytes of their own numbers, and are read as matrices.

Equal vectors are one entry that lists the smallest k + 1 of their ids: more can never be among k neighbours.  A bucket
that many vectors crowd is cut into parts of about BUCKET, each met by the same queries.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose length isn't the most
frequent one.  Rows with null vec_id take no part.  Rows repeating a vec_id count as one with each of its vectors;
fewer than k candidates give fewer rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

TREES = 10
BITS = 64
BUCKET = 4096
NEAR = 64
MISS = 0.02


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors of any length: id, v, and h1, h2 for an equal v."""
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: v, ids (the smallest k + 1 different ones)."""
    first = Window.partitionBy("h1", "h2").orderBy("id")
    rows = rows.dropDuplicates(["h1", "h2", "id"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    return rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids")


def _strings(x: np.ndarray, longest: float, query: bool, trees: int, seed: int) -> np.ndarray:
    """trees x rows of 64-bit strings, first sign in the highest bit."""
    spare = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    planes = np.random.default_rng(seed).normal(size=(x.shape[1] + 1, trees * BITS))
    bits = (np.concatenate((x, spare[:, None]), axis=1) @ planes > 0).reshape(len(x), trees, BITS)
    return np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64).T


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, and of all that tie with the last but for rounding."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return scores >= kth[:, None] - 1e-9 * (1 + np.abs(kth[:, None]))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors packed as bytes, as a matrix of doubles."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), -1).astype(np.float64)


def _search(batches, k: int, deep: bool, cut: int, kind: str):
    """Rows of one (tree, bucket, part), base rows (kind 0) before queries (1): query, ids and score of the best.

    deep: descend to the longest prefix that NEAR vectors share; else take the query's own prefix length.
    """

    def answer(base: dict, asked: pa.Table):
        keys, x, ids = base["keys"], base["x"], base["ids"]
        q_key, q, level = asked.column("key").to_numpy().view(np.uint64), _matrix(asked.column("v"), kind), asked.column("level").to_numpy()
        who_asks = asked.column("ids").combine_chunks().flatten().to_numpy()
        if deep:
            level = np.full(len(q), cut)
            for bits in range(cut + 1, BITS + 1):  # a longer prefix while enough vectors share it
                lo, hi = _range(keys, q_key, np.full(len(q), bits))
                level[hi - lo >= NEAR] = bits
        lo, hi = _range(keys, q_key, np.where(level <= cut, 0, level))
        slices, same = np.unique(np.stack((lo, hi), axis=1), axis=0, return_inverse=True)
        order = np.argsort(same.reshape(-1), kind="stable")
        ends = np.cumsum(np.bincount(same.reshape(-1), minlength=len(slices)))
        for (a, b), start, end in zip(slices.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            for at in range(start, end if b > a else start, 256):
                some = order[at : min(at + 256, end)]
                i, j = np.nonzero(_top(q[some] @ x[a:b].T, k + 1))
                exact = (q[some[i]] * x[a + j]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(who_asks[some[i]]), ids.take(pa.array(a + j)), pa.array(exact)], ["query_id", "ids", "score"])

    def groups():
        """The rows of one place, in pieces of a bounded number of queries."""
        here, held, n = None, [], 0
        for batch in batches:
            names = [batch.column(i).to_numpy() for i in range(3)]
            change = np.any([np.diff(x) != 0 for x in names], axis=0) if batch.num_rows else np.zeros(0, bool)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if end <= at:
                    continue
                place = tuple(int(x[at]) for x in names)
                if place != here or n >= 4096:
                    if held:
                        yield here, pa.Table.from_batches(held)
                    here, held, n = place, [], 0
                held.append(batch.slice(at, end - at))
                n += int((batch.column(3).slice(at, end - at).to_numpy() == 1).sum())
        if held:
            yield here, pa.Table.from_batches(held)

    here, rows, base = None, [], None
    for place, t in groups():
        if place != here:
            here, rows, base = place, [], None
        is_base = t.column("kind").to_numpy() == 0
        if is_base.any():
            rows.append(t.filter(pa.array(is_base)))
        asked = t.filter(pa.array(~is_base))
        if asked.num_rows and rows:
            if base is None:
                all_rows = pa.concat_tables(rows).combine_chunks()
                order = np.argsort(all_rows.column("key").to_numpy().view(np.uint64), kind="stable")
                all_rows = all_rows.take(pa.array(order))
                base = {"keys": all_rows.column("key").to_numpy().view(np.uint64), "x": _matrix(all_rows.column("v"), kind), "ids": all_rows.column("ids").combine_chunks()}
            yield from answer(base, asked)


def _range(keys: np.ndarray, q: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice of sorted keys that share the first bits of each query."""
    free = (np.uint64(BITS) - bits.astype(np.uint64)) & np.uint64(63)
    mask = np.where(bits <= 0, ~np.uint64(0), (np.uint64(1) << free) - np.uint64(1))
    mask = np.where(bits >= BITS, np.uint64(0), mask)
    return np.searchsorted(keys, q & ~mask, "left"), np.searchsorted(keys, q | mask, "right")


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """v as the bytes of its numbers, the other columns as they are."""

    def run(batches):
        for batch in batches:
            v = batch.column(0)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(max(batch.num_rows, 1), -1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in flat[: batch.num_rows]], pa.binary()), *batch.columns[1:]], batch.schema.names)

    return rows.mapInArrow(run, "v binary, ids array<long>")


def _forest(vectors: DataFrame, longest: float, query: bool, trees: int, seed: int, kind: str, carry: str = "") -> DataFrame:
    """v, ids (and level) of each row once for every tree, with the tree's string."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                keys = _strings(_matrix(batch.column(0), kind), longest, query, trees, seed).view(np.int64)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(keys[t]), *batch.columns], ["tree", "key", *batch.schema.names])

    return vectors.mapInArrow(run, "tree int, key long, v binary, ids array<long>" + carry)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best different candidates of each query, without itself."""
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, miss: float = MISS, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found among all other rows, ties to the smaller id."""
    usable = _usable(vectors, id_col, vector_col)
    common = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    usual = F.size("v") == (common.n if common else 1)
    kind = "<f4" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), True) else "<f8"
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = usable.where(usual).agg(F.max(F.sqrt(squares))).first()[0]
    entries = saved(_packed(_entries(usable.where(usual), k), kind), "vectors")
    n = entries.count()
    cut = min(16, max(0, int(np.floor(np.log2(max(n, 1) / BUCKET)))))  # first bits that name a bucket
    asked = _usable(vectors.where(is_query), id_col, vector_col).where(usual).dropDuplicates(["h1", "h2", "id"])
    asked = asked.select("v", F.array("id").alias("ids"))
    lengths = asked.select(F.col("ids")[0].alias("query_id"), F.sqrt(squares).alias("length"))
    asked = saved(_packed(asked, kind), "queries")
    bucket = (F.shiftrightunsigned("key", BITS - cut) if cut else F.lit(0)).cast("int")
    base = _forest(entries, longest or 0.0, False, trees, seed, kind).withColumn("bucket", bucket)
    full = base.groupBy("tree", "bucket").agg(F.count("*").alias("c")).select("tree", "bucket", F.ceil(F.col("c") / (2 * BUCKET)).cast("int").alias("parts"))
    full = saved(full, "buckets")
    base = base.join(full, ["tree", "bucket"]).withColumn("part", F.pmod(F.xxhash64("ids"), "parts").cast("int"))
    base = base.select("tree", "bucket", "part", F.lit(0).alias("kind"), "key", "v", "ids", F.lit(0).alias("level"))

    def searched(queries: DataFrame, deep: bool) -> DataFrame:
        """queries: tree, bucket, key, v, ids, level."""
        q = queries.join(full, ["tree", "bucket"]).select("tree", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "key", "v", "ids", "level")
        rows = base.union(q).repartition("tree", "bucket", "part").sortWithinPartitions("tree", "bucket", "part", "kind")
        return rows.mapInArrow(lambda b: _search(b, k, deep, cut, kind), "query_id long, ids array<long>, score double")

    keyed = _forest(asked, longest or 0.0, True, trees, seed, kind).withColumn("bucket", bucket)
    first = saved(searched(keyed.withColumn("level", F.lit(cut)), True), "descent")
    # a query that found fewer than k climbs to the top
    near = _best(first, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("c")).select("query_id", F.when(F.col("c") >= k, F.col("s")).alias("s"))
    lengths = lengths.groupBy("query_id").agg(F.min("length").alias("length"))
    asked = asked.withColumn("query_id", F.col("ids")[0]).join(near, "query_id", "left").join(lengths, "query_id")
    p = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("s") / (F.col("length") * F.lit(longest or 1.0))))) / F.lit(float(np.pi))
    level = F.coalesce(F.floor(F.lit(float(np.log(1 - miss ** (1 / trees)))) / F.log(F.least(p, F.lit(1 - 1e-9)))), F.lit(0)).cast("int")
    # where the trees together would read more than everything, one tree's top does
    level = F.when(level < np.ceil(np.log2(trees)), F.lit(0)).otherwise(F.least(level, F.lit(BITS)))
    levelled = saved(asked.select("v", "ids", level.alias("level")), "levels")
    keyed = _forest(levelled, longest or 0.0, True, trees, seed, kind, ", level int").where((F.col("level") > 0) | (F.col("tree") == 0))
    own = (F.shiftrightunsigned("key", BITS - cut) if cut else F.lit(0)).cast("int")
    free = F.greatest(F.lit(cut) - F.col("level"), F.lit(0))
    low = F.pow(F.lit(2), free).cast("int")
    start = (F.floor(own / low) * low).cast("int")
    keyed = keyed.withColumn("bucket", F.explode(F.sequence(start, start + low - 1)))
    best = _best(first.union(searched(keyed, False)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""BM25 over distinct tokens, for whole batches of queries.

Texts are cut into tokens once.  A batch of at most SMALL_BATCH tokens (counted first) reaches every task; for each document
a task writes which of them it has, which is a fraction of the text.  Counts and scores come from that table: with all
weights at hand a task's scores are complete, so it adds them up by arrays and passes on the k best of each query.  No row
for a question and a document is shuffled.  Larger batches meet the tokens by joins, and cut texts twice.
Scores are sums of whole numbers (two for each weight), which are the same in any order, and are rounded to 9 places, halves
up, before they rank: documents with the same tokens tie whatever the order of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.functions.text import search_tokens
from corpuscle.sources.tables import saved

K1, B = 1.5, 0.75
#: Tokens of a batch of queries that every task may hold; scores a task works out at a time; candidates it holds.
SMALL_BATCH, AT_ONCE, HELD = 1 << 18, 1 << 22, 1 << 17
#: A weight is HIGH parts of a unit and LOW parts of one of those; sums of 2**17 of either are exact in a double.
HIGH, LOW = float(1 << 30), float(1 << 36)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("chunk_id"), F.explode(search_tokens(text_col)).alias("token"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, average number of distinct tokens."""
    return docs.select(F.size(search_tokens(text_col)).alias("dl")).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def token_df(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return postings(docs, id_col, text_col).groupBy("token").agg(F.count("*").alias("df"))


class Weights:
    """A batch of queries for scoring: for each of its tokens the weight, and the queries that ask it."""

    def __init__(self, asked: list, tokens: list[str], df: dict[int, int], n: int, length: int):
        """asked: rows of query_id, token and, where queries have it, only.  df: documents by the place of a token."""
        self.avg = length / n if n else 0.0
        self.queries = list(dict.fromkeys(r.query_id for r in asked))
        number, place = {q: i for i, q in enumerate(self.queries)}, {t: i for i, t in enumerate(tokens)}
        found = np.array(sorted({(place[r.token], number[r.query_id]) for r in asked}), np.int64).reshape(-1, 2)
        self.query, self.first = found[:, 1], np.searchsorted(found[:, 0], np.arange(len(tokens) + 1))
        seen = np.array([df.get(i, 0) for i in range(len(tokens))], float)
        self.idf = np.log(1 + (n - seen + 0.5) / (seen + 0.5))
        self.only = {number[r.query_id]: frozenset(r.only) for r in asked if "only" in r and r.only is not None}

    def scores(self, places: pa.ListArray, length: np.ndarray, kinds: list | None) -> np.ndarray:
        """Documents x queries, 0 where nothing is shared or the kind isn't wanted."""
        n, q = len(places), len(self.queries)
        doc, place = np.repeat(np.arange(n), pc.list_value_length(places).to_numpy()), places.flatten().to_numpy()
        many = self.first[place + 1] - self.first[place]
        start = np.repeat(self.first[place] - np.concatenate(([0], np.cumsum(many)[:-1])), many) if len(place) else np.zeros(0, np.int64)
        query = self.query[start + np.arange(len(start))]
        norm = 1 - B + B * length / self.avg if self.avg else np.ones(n)
        part = self.idf[place] * (K1 + 1) / (1 + K1 * norm)[doc]
        high = np.floor(part * HIGH)
        low = np.rint((part * HIGH - high) * LOW)
        cell = np.repeat(doc, many) * q + query
        total = (np.bincount(cell, np.repeat(high, many), n * q) / HIGH + np.bincount(cell, np.repeat(low, many), n * q) / (HIGH * LOW)).reshape(n, q)
        for i, wanted in self.only.items() if kinds is not None else ():
            total[[k not in wanted for k in kinds], i] = 0
        return np.floor(total * 1e9 + 0.5) / 1e9


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best of each query: largest score, then smallest id."""
    found = found.sort_by([("query", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
    query = found["query"].to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def _scored(tokens: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score: of each task the k best of each query.  asked has SMALL_BATCH rows at most."""
    spark, rows = tokens.sparkSession, asked.collect()
    known = sorted({r.token for r in rows})
    words = spark.sparkContext.broadcast(known)
    own = [f for f in tokens.schema.fields if f.name != "tokens"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(words.value, pa.string())
        for batch in batches:
            found = batch.column("tokens")
            place = pc.index_in(found.flatten(), value_set=values)
            hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
            length = pc.list_value_length(found).fill_null(0).to_numpy()
            ends = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(length)))]
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), place.drop_null())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(length, pa.int32()), places], [*(f.name for f in own), "dl", "places"])

    held = saved(tokens.mapInArrow(match, T.StructType([*own, T.StructField("dl", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType()))])), "matched")
    all_docs = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    df = {r.place: r.n for r in held.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()}
    weights = spark.sparkContext.broadcast(Weights(rows, known, df, all_docs.n, all_docs.length))
    kind, aimed = asked.schema["query_id"].dataType, "block_type" in tokens.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        found, size = [], 0
        for whole in batches if w.queries else ():
            step = max(1, AT_ONCE // len(w.queries))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                s = w.scores(batch.column("places"), batch.column("dl").to_numpy(), batch.column("block_type").to_pylist() if aimed else None)
                least = np.partition(s, -k, axis=0)[-k] if len(s) > k else np.zeros(s.shape[1])
                doc, query = np.nonzero((s > 0) & (s >= least))
                found.append(pa.table({"query": pa.array(query), "score": pa.array(s[doc, query]), "chunk_id": batch.column("chunk_id").take(pa.array(doc))}))
                size += len(doc)
                if size > HELD:
                    found, size = [_best(pa.concat_tables(found), k)], 0
        if found:
            best = _best(pa.concat_tables(found), k).combine_chunks()
            ids = pa.array([q.asDict() if isinstance(q, Row) else q for q in w.queries], to_arrow_type(kind))
            yield from pa.table({"query_id": ids.take(best["query"].combine_chunks()), "chunk_id": best["chunk_id"], "score": best["score"]}).to_batches(max_chunksize=1 << 16)

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", tokens.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    return held.where("allowed").drop("allowed").mapInArrow(score, schema)


def bm25(docs: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, chunk_id, score, lexical_rank of the k best of each query; queries: query_id, query.

    A filter limits what is ranked, never the corpus statistics.  Where queries have `only`, an array or null, the rows
    of a query are those whose block_type is in it.
    """
    aimed = "only" in queries.columns
    asked = queries.select("query_id", *(["only"] if aimed else []), F.explode(search_tokens("query")).alias("token"))
    tokens = docs.select(F.col(id_col).alias("chunk_id"), search_tokens(text_col).alias("tokens"), (where if where is not None else F.lit(True)).alias("allowed"), *(["block_type"] if aimed else []))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    if asked.count() <= SMALL_BATCH:
        return _scored(tokens, asked, k).withColumn("lexical_rank", F.row_number().over(order)).where(F.col("lexical_rank") <= k)
    # the empty token stands for the document, and sums lengths
    named = asked.select("token").distinct().union(docs.sparkSession.range(1).select(F.lit("").alias("token")))
    counts = tokens.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token")).join(named, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))
    stats = counts.where("token = ''").select(F.col("df").alias("n_docs"), (F.col("dl") / F.col("df")).alias("avg_dl"))
    idf = counts.where("token <> ''").join(stats, F.lit(True)).select("token", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_dl")
    hits = tokens.where("allowed").select("chunk_id", F.size("tokens").alias("dl"), *(["block_type"] if aimed else []), F.explode("tokens").alias("token")).join(asked.join(idf, "token"), "token")
    if aimed:
        hits = hits.where(F.col("only").isNull() | F.array_contains("only", F.col("block_type")))
    norm = F.when(F.col("avg_dl") == 0, F.lit(1.0)).otherwise(1 - B + B * F.col("dl") / F.col("avg_dl"))
    hits = hits.withColumn("part", F.col("idf") * (K1 + 1) / (1 + K1 * norm) * HIGH).withColumns({"high": F.floor("part"), "low": F.rint((F.col("part") - F.floor("part")) * LOW).cast("long")})
    total = F.sum("high") / F.lit(HIGH) + F.sum("low") / F.lit(HIGH * LOW)
    scored = hits.groupBy("query_id", "chunk_id").agg((F.floor(total * 1e9 + 0.5) / F.lit(1e9)).alias("score")).where("score > 0")
    return scored.withColumn("lexical_rank", F.row_number().over(order)).where(F.col("lexical_rank") <= k)

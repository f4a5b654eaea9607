"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source's documents, in an order fixed by a hash of their ids, are cut into blocks of `block` documents.  One block
is scheduled in each slot.  With q of every `period` slots due to a source, its block j (from 0) is released at slot
floor(j * period / q) and due by slot ceil((j + 1) * period / q); earliest deadline first over released blocks meets
every deadline, so after any number of slots a source is less than one block from its share.  The schedule of one
period is computed once, by a fold over its slots, and repeats; a block's slot is then plain arithmetic.

Targets are the given weights, or else the square roots of the sources' sizes.  A period has max(1000, 4 * sources)
slots; each source gets one, the rest goes by largest remainder.  No document is dropped: when a source has run out its
slots stay empty, and the others keep their order.  `in_mix` tells the slots before the first empty one, where the
deviation bound holds for every source.

A source of a third of all rows is ranked in parts: documents are counted by source and hash range, and numbered inside
a range only.  Nulls: a null source is the source ''; a null doc_id counts as ''.  Rows with equal ids are ordered by
text, equal rows arbitrarily.  A negative or missing weight is 0 (the source keeps one slot a period).  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents numbered together, about.
PART = 4000


def _quotas(sources: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """sources: source, n -> source, n, q, i (from 0), period."""
    if weights is None:
        w = F.round(F.sqrt("n") * 1000).cast("long")
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(int(round(max(v, 0.0) * 1e6))))]
        w = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0)).cast("long") if pairs else F.lit(0).cast("long")
    rows = sources.withColumn("w", w)
    one = rows.agg(F.sort_array(F.collect_list(F.struct("source", "n", "w"))).alias("s"))
    one = one.withColumn("period", F.greatest(F.lit(1000), 4 * F.size("s"))).withColumn("total", F.expr("greatest(1L, aggregate(s, 0L, (a, x) -> a + x.w))"))
    # one slot each, then by whole shares, then the largest remainders
    one = one.withColumn("r", F.expr("transform(s, (x, i) -> named_struct('i', i, 'source', x.source, 'n', x.n, 'whole', 1 + ((period - size(s)) * x.w) div total, 'rest', ((period - size(s)) * x.w) % total))"))
    one = one.withColumn("left", F.expr("period - aggregate(r, 0L, (a, x) -> a + x.whole)"))
    ranked = F.expr("array_sort(r, (x, y) -> CASE WHEN x.rest > y.rest THEN -1 WHEN x.rest < y.rest THEN 1 ELSE x.i - y.i END)")
    # with all weights 0 the first sources share what is left
    return one.select("period", "left", F.posexplode(ranked).alias("k", "x"), F.size("r").alias("m")).select(
        F.col("x.source").alias("source"), F.col("x.n").alias("n"), F.col("x.i").alias("i"), "period",
        (F.col("x.whole") + F.expr("left div m") + (F.col("k") < F.col("left") % F.col("m")).cast("int")).alias("q"),
    )


def _template(quotas: DataFrame) -> DataFrame:
    """Earliest deadline first over one period: source, q, j, slot, release, deadline."""
    one = quotas.agg(F.sort_array(F.collect_list(F.struct("i", "source", "q"))).alias("s"), F.first("period").alias("period")).where(F.size("s") > 0)
    due = """array_min(filter(transform(s, (x, i) -> CASE WHEN a.c[i] < x.q AND (a.c[i] * period) div x.q <= t
             THEN named_struct('d', ((a.c[i] + 1) * period + x.q - 1) div x.q, 'i', i) END), y -> y IS NOT NULL))"""
    fold = f"""aggregate(sequence(0, period - 1), named_struct('c', transform(s, x -> 0L), 'o', cast(array() AS array<int>)),
               (a, t) -> transform(array({due}), k -> named_struct('c', transform(a.c, (n, i) -> n + CASE WHEN i = k.i THEN 1L ELSE 0L END), 'o', concat(a.o, array(k.i))))[0], a -> a.o)"""
    slots = one.withColumn("o", F.expr(fold)).select("s", "period", F.posexplode("o").alias("slot", "i")).select("slot", "period", F.expr("s[i].source").alias("source"), F.expr("s[i].q").alias("q"))
    j = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    slots = slots.withColumn("j", j.cast("long"))
    return slots.select("source", "q", "period", "j", F.col("slot").cast("long").alias("slot"), F.expr("(j * period) div q").alias("release"), F.expr("((j + 1) * period + q - 1) div q").alias("deadline"))


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32) -> DataFrame:
    """row (the document as it came), source, rank, block, slot, release, deadline, place, in_mix."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumns({"source": F.coalesce(F.col("row.source").cast("string"), F.lit("")), "id": F.col("row.doc_id").cast("string")})
    rows = rows.withColumn("mark", F.md5(F.coalesce("id", F.lit("")).cast("binary")))
    narrow = rows.groupBy("source").agg(F.count("*").alias("n"))
    quotas = _quotas(narrow, weights)
    slots = _template(quotas)
    total, horizon = docs.count(), slots.join(narrow, "source").where((F.ceil(F.col("n") / block) % F.col("q")) == F.col("j")).agg(F.min(F.expr(f"(ceil(n / {block}) div q) * period + slot"))).first()[0]
    parts = max(1, total // PART)
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * parts / F.lit(2**32)).cast("int"))
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("mark", "id", F.col("row.text"))
    rows = rows.withColumn("k", F.row_number().over(inside)).join(base, ["source", "part"])
    rows = rows.withColumn("rank", F.col("base") + F.col("k") - 1).withColumn("block", F.expr(f"rank div {block}"))
    rows = rows.join(slots.select(F.col("source").alias("of"), "q", "period", F.col("j").alias("turn"), F.col("slot").alias("at"), F.col("release").alias("from"), F.col("deadline").alias("to")), (F.col("source") == F.col("of")) & (F.col("block") % F.col("q") == F.col("turn")))
    start = F.expr("(block div q) * period")
    return rows.select(
        "row", "source", "rank", "block",
        (start + F.col("at")).alias("slot"), (start + F.col("from")).alias("release"), (start + F.col("to")).alias("deadline"),
        ((start + F.col("at")) * block + F.col("rank") % block).alias("place"), ((start + F.col("at")) < F.lit(horizon)).alias("in_mix"),
    )


def mix_schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, place, in_mix for every document; place orders the mixture."""
    return scheduled(docs, weights, block).select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "release", "deadline", "place", "in_mix")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32) -> DataFrame:
    """The documents with their own columns, sorted into the mixture's order."""
    return scheduled(docs, weights, block).select("row", "place").orderBy("place").select("row.*")


def in_written_order(docs: DataFrame) -> DataFrame:
    """docs, read from Parquet files that Spark wrote, with place: from 0 in the order of the files' numbers and rows."""
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    counts = docs.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "file").select(*(F.col(f"`{c}`") for c in docs.columns), (F.col("base") + F.col("at")).alias("place"))


#: mix_schedule(documents) in DuckDB.
MIX_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, text, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
src AS (SELECT source, count(*) AS n, CAST(round(sqrt(count(*)) * 1000) AS BIGINT) AS w FROM d GROUP BY source),
tot AS (SELECT greatest(1, sum(w))::BIGINT AS total, count(*)::BIGINT AS m, greatest(1000, 4 * count(*))::BIGINT AS period FROM src),
sh AS (SELECT source, n, row_number() OVER (ORDER BY source) AS i, period, 1 + ((period - m) * w) // total AS whole, ((period - m) * w) % total AS rest, m FROM src, tot),
q AS (SELECT source, n, i, period, whole + (period - sum(whole) OVER ()) // m + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) - 1 < (period - sum(whole) OVER ()) % m THEN 1 ELSE 0 END AS q FROM sh),
ql AS (SELECT list(CAST(q AS BIGINT) ORDER BY i) AS q, any_value(period) AS period FROM q),
e(t, c, k) AS (
  SELECT CAST(0 AS BIGINT), list_transform(q, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM ql
  UNION ALL
  SELECT t + 1, list_transform(c, lambda n, i: n + CASE WHEN i = kk THEN 1 ELSE 0 END), kk FROM (
    SELECT e.t, e.c, list_min(list_filter(list_transform(ql.q, lambda x, i: CASE WHEN e.c[i] < x AND (e.c[i] * ql.period) // x <= e.t THEN ((((e.c[i] + 1) * ql.period + x - 1) // x) * 100000 + i)::BIGINT END), lambda y: y IS NOT NULL)) % 100000 AS kk
    FROM e, ql WHERE e.t < ql.period)
),
tpl AS (SELECT q.source, q.q, q.period, t - 1 AS slot, row_number() OVER (PARTITION BY q.source ORDER BY t) - 1 AS j FROM e JOIN q ON q.i = e.k WHERE t > 0),
hor AS (SELECT min((CAST(ceil(q.n / 32.0) AS BIGINT) // q.q) * q.period + tpl.slot) AS horizon FROM q JOIN tpl ON q.source = tpl.source AND CAST(ceil(q.n / 32.0) AS BIGINT) % q.q = tpl.j),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY mark, CAST(doc_id AS VARCHAR), text) - 1 AS rank FROM d),
b AS (SELECT r.*, rank // 32 AS block FROM r)
SELECT doc_id, b.source, CAST(block AS BIGINT) AS block, CAST((block // q) * period + slot AS BIGINT) AS slot,
  CAST((block // q) * period + (j * period) // q AS BIGINT) AS release, CAST((block // q) * period + ((j + 1) * period + q - 1) // q AS BIGINT) AS deadline,
  CAST(((block // q) * period + slot) * 32 + rank % 32 AS BIGINT) AS place, (block // q) * period + slot < (SELECT horizon FROM hor) AS in_mix
FROM b JOIN tpl ON b.source = tpl.source AND block % q = tpl.j
"""

"""What Python workers hold between tasks and are handed at a time, on which the pipeline's memory depends."""

import gc
import weakref

import pyarrow as pa

from corpuscle.llm import bpe, queries
from corpuscle.llm.common import forget_others, tidy

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CODEC = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.token_pattern()


def numbers_of_tasks():
    """Functions of no module that workers import: what a task's worker keeps, and rows of the largest batch it is handed."""

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.codec.cache_info().currsize])], ["n"])

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max((b.num_rows for b in batches), default=0)])], ["n"])

    return kept, largest


KEPT, LARGEST = numbers_of_tasks()


def test_a_task_forgets_what_another_operator_kept(spark):
    docs = spark.range(0, 80, 1, 8).selectExpr("id AS doc_id", "concat('a text ', id) AS text")
    assert bpe.bpe_round_trip(docs, *CODEC).count() == 80
    rows = spark.range(0, 8, 1, 8)
    assert max(r.n for r in rows.mapInArrow(KEPT, "n long").collect()) == 1
    assert {r.n for r in rows.mapInArrow(tidy(KEPT), "n long").collect()} == {0}


def test_forgotten_is_gone():
    c = weakref.ref(bpe.codec(*CODEC))
    gc.disable()
    try:
        forget_others(bpe.__name__)
        assert c() is bpe.codec(*CODEC)  # its own tasks keep it
        forget_others("another")
        assert c() is None
    finally:
        gc.enable()


def test_every_stage_is_handed_small_batches(spark, sf_dir):
    """Also what a stage returns, which runs when the caller writes it."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"text {i} " + "word " * i, None, "web", 9) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(BATCH)
    many = spark.range(0, 3000, 1, 1)
    try:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            spark.conf.set(BATCH, "10000")
            stage(spark, docs, sf_dir)
            assert many.mapInArrow(LARGEST, "n long").first().n <= 256, name
        spark.conf.set(BATCH, "1234")
        corpus_pipeline.run(spark, sf_dir)
        assert spark.conf.get(BATCH) == "1234"
    finally:
        spark.conf.set(BATCH, before)

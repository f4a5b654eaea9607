"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.bpe import bpe_round_trip
from corpuscle.llm.common import saved, set_small_batches, small_batches, table
from corpuscle.llm.language_id import accepted
from corpuscle.llm.mixing import in_written_order, mixed
from corpuscle.llm.ngram_join import one_of_each
from corpuscle.llm.queries import token_pattern, tokenizer_file
from corpuscle.llm.substring_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of a similarity of 0.8 or more stays."""
    return one_of_each(docs, n=5, threshold=(4, 5))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur again go from the texts."""
    return without_repeats(docs, window=35)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows take the order of the mixture."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the token ids and of the decoded bytes, and the document's place in the mixture."""
    return bpe_round_trip(in_written_order(docs), tokenizer_file("byte_bpe_multi_50k.tiktoken"), token_pattern(), "place")


def in_small_batches(stage):
    """The stage, in a session that hands Python small batches from then on: what it returns runs only when its caller writes it."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(name, in_small_batches(f)) for name, f in (("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("mixing", mix), ("bpe", encode))]
#: SQL can express neither the recurrent network nor the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of documents, each reading what the one before has written; the session's batches are then as before."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus queries of __spark_entry__.py: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import bpe_round_trip
from .common import new_path, saved, table
from .fill_middle import FILL_MIDDLE_SQL, fill_in_middle, restored
from .html_extract import html_extract
from .language_id import language_id
from .license_scan import license_scan
from .mixing import MIX_SQL, mix_schedule
from .ngram_join import ngram_jaccard_join
from .packing import pack, step_groups
from .quality_rules import BASE, apply_policy, rule_ledger
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_output import read_tokens, write_tokens


def tokenizer_file(name: str) -> str:
    """A file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and place of every document in the mixture of sources; an empty table gives no rows."""
    return mix_schedule(table(spark, sf_dir, "documents"), block=32)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; `und` for null texts and texts without a letter."""
    return language_id(table(spark, sf_dir, "documents"), per_language=400)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for null or empty pages."""
    return html_extract(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and those removed as parts of repeated windows; a null text has none."""
    return substring_dedup(table(spark, sf_dir, "documents"), window=35)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the ids of every document, read back from the shards; a null text is its end id."""
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return read_tokens(spark, path)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded bytes of every document; a null text is empty."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), token_pattern())


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; null texts and null ids link with nothing."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold=(9, 10))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, failures and verdict of policy 2 for every document; a null text has no words."""
    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents")), version=2)
    base = F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures", "policy_version")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20; unusable vectors take no part."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in every document; none in null texts."""
    return license_scan(table(spark, sf_dir, "documents"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences of at most 2048 ids, with their step; a null text is its end id."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    pieces = saved(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return step_groups(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context_size", "step")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the likelier spelling one edit away; null texts have no words."""
    return spelling_variants(table(spark, sf_dir, "documents"), every=199, least_chars=6, least=5, times=5)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's rearranged and restored text; a null text is empty and plain."""
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_schedule, op2_language_id, op3_html_extract, op4_substring_dedup, op5_token_output, op6_bpe_round_trip, op7_ngram_jaccard_join, op8_quality_rules, op9_nearest, op10_license_scan, op11_pack_sequences, op12_spelling_variants, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_schedule": MIX_SQL, "op13_fill_in_middle": FILL_MIDDLE_SQL}

"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_cleaning, near_dedup, neural_lm, packing, pii, quality_classifier, suffix_dedup, token_codec, token_count
from .common import documents, read_table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op2_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.digest(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_TOKENIZER, end_id=1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), WORD_TOKENIZER)


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.round_trip(documents(spark, sf_dir), BYTE_TOKENIZER, end_id=2)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.score_texts(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_rule_ensemble, op2_line_cleaning, op3_near_dedup, op4_pii, op5_suffix_dedup, op6_packing, op7_decontamination, op8_token_counts, op9_token_blocks, op10_lm_scores]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_cleaning": line_cleaning.ORACLE, "op3_near_dedup": near_dedup.ORACLE, "op5_suffix_dedup": suffix_dedup.ORACLE}

"""The registered queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundlens.llm import (chat_format, decontaminate, fim, hmm_lm, knn_join, language_id, licenses, near_dedup, packing,
                          simhash_index, substring_dedup, token_align, toxicity)
from fundlens.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.format_turns(chat_format.with_probe(table(spark, sf_dir, "conversations"))))


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_top_k, op3_decontaminate, op4_near_dedup, op5_packing,
                                    op6_substring_dedup, op7_chat_format, op8_hmm_score, op9_license_scan, op10_toxicity,
                                    op11_simhash_dedup, op12_fill_in_middle, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": knn_join.ORACLE, "op4_near_dedup": near_dedup.ORACLE, "op7_chat_format": chat_format.ORACLE,
            "op9_license_scan": licenses.oracle_sql(), "op12_fill_in_middle": fim.ORACLE}

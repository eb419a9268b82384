"""The corpus queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, decontaminate, hard_negatives, jaccard_join, lang_id, license_scan, line_dedup, media_jpeg, packing, pii, substring_dedup, suffix_dedup, toxicity,
)
from .common import table


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.carry_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.chronofold.pii.key", "change this key").encode()
    return pii.pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.drop("fuzzy_spans")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return hard_negatives.mine(vectors)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.drop("n_factors", "longest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_jpeg": op1_media_jpeg,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_lang_id": op8_lang_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
}

"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import load
from graphloom.llm import exact_dedup, license_scan, line_dedup, substring_dedup
from graphloom.llm.fingerprints import fingerprints
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.packing import best_fit_packing
from graphloom.llm.quality import quality_scores
from graphloom.llm.sentencepiece_codec import codec_report
from graphloom.llm.token_counts import token_counts


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(load(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(load(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(load(spark, sf_dir, "documents"))


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_report(load(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_near_dedup, op3_exact_dedup, op4_license_scan, op5_token_counts, op6_best_fit_packing, op7_document_fingerprints, op8_line_dedup, op9_sentencepiece_codec, op10_quality_classifier)}

#: Token counts and packing need the tokenizer libraries; tests hold them against those.
ORACLE_SQL: dict[str, str] = {"op1_suffix_array_dedup": substring_dedup.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op4_license_scan": license_scan.oracle(), "op8_line_dedup": line_dedup.ORACLE}

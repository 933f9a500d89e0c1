"""A corpus from documents to packed sequences, in stages that each call one operator.

Each stage reads all that its predecessor kept and returns the columns of ``documents`` (the last one returns pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import cut, load
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.near_dedup import near_dedup
from graphloom.llm.packing import best_fit_packing
from graphloom.llm.quality import quality_filter
from graphloom.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_filter(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents share stay in one of them."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar at 0.8 or more."""
    return near_dedup(docs, width=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more stay where they occur first."""
    return substring_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their sequence and place."""
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: A trained classifier and a tokenizer library stand in the way of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs

"""A pipeline over ``documents``: language ID, exact dedup, near-dedup, mixing, packing.

Each stage gets all rows that the one before it kept; a stage's result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.language_id import keep_identified
from tidemark.llm.mixing import take_mix
from tidemark.llm.packing import pack
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.sources.scratch import delete, scratch_path, scratch_scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found (the others have no letter)."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return pack(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: Language ID, SimHash, pivotal rounding and the BPE can't be written in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):  # what a stage leaves behind goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

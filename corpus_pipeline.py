"""A training corpus from documents: language, near-duplicates, personal data, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shapewright.llm import langid, mixing, packing, pii, simhash
from shapewright.llm.shared import removed, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of no language learned from the others go: those without a letter, and those unlike all landmarks."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; every document stays."""
    return pii.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources weigh alike, and shuffled."""
    return mixing.mix_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_dedup", near_dedup),
    ("personal_data", redact),
    ("mixture", mixture),
    ("packing", sequences),
]

ORACLE_SQL: str | None = None
"""Language scores, fingerprints and tokens have no SQL; the tests hold run() against a brute-force version of its stages."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over all others; what a stage returns is written to the shared folder and read by the next."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

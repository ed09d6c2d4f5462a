"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxloom.llm import decontam, line_dedup, near_dedup, packing, quality
from ctxloom.llm._common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs go. Documents that lose all their lines go too; n_chars follows the text."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the least id."""
    return near_dedup.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage fits a model: SQL cannot express it. tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None

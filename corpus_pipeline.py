"""A corpus pipeline over the documents table, of operators of tidewake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, line_dedup, packing, quality, simhash
from tidewake.llm.common import crc_fold, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 go."""
    learn = crc_fold(F.col("doc_id"), quality.FOLDS) != quality.HELD_OUT
    score = "_" * (1 + max(map(len, docs.columns))) + "score"  # no column has this name
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn)
    return quality.with_score(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; every document stays."""
    return line_dedup.cleaned(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return packing.packed(docs, digest=True, cached_chunks=PACKING_CHUNKS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None  # no stage but the dedup's last step can be said in SQL; tests/llm compares with brute force


PACKING_CHUNKS = 60_000
"""Chunks that packing remembers: fewer than alone, as the executors still hold what earlier stages left."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents to packed training sequences.

Stages, each over all documents its predecessor kept: the quality classifier
drops documents it rejects; near-duplicate removal leaves one document of each
group; personal data is redacted in the texts; packing cuts the documents into
pieces and places them in sequences. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactlens.llm import odd_sketch, packing, pii_weak, quality_crf
from impactlens.llm.common import materialise, read_table

#: Not expressible in SQL; tests/llm/test_pipeline.py checks it stage by stage.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.keep_good(docs, quality_crf.fit(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return odd_sketch.drop_copies(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_weak.redact(docs, pii_weak.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("private_data", private_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Each stage takes the session, the documents that the stage before has kept, and the folder of the other tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corollary.llm import linededup, packing, quality, secret_scan, simhash
from corollary.llm.common import table
from corollary.session import ensure_checkpoint_dir, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and score like trusted text."""
    ship_package(spark)
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line matches."""
    return linededup.remove_similar_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, offset, and the piece's place in the document."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and best fit have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each keeps is written to a folder of its own in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

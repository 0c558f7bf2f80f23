"""Cleaning a document corpus: five stages, each written as Parquet and read by the next.

quality rules -> SimHash near-dedup -> benchmark decontamination -> secret redaction ->
mixing to target weights. Every stage but the last returns the columns of ``documents``.
Intermediate tables are in the shared folder that the cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanmart.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from scanmart.llm.common import documents, table
from scanmart.llm.queries import QUALITY_POLICY, SIMHASH_BITS, SIMHASH_SHINGLE
from scanmart.session import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps.

    Null, empty and very short texts go; long texts are judged whole; repeated rows stay or go
    together; an empty table stays empty. Further columns are handed on, whatever their names."""
    docs = documents(spark, sf_dir) if docs is None else docs
    return quality_rules.kept_documents(docs, QUALITY_POLICY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The row with the smallest doc_id stays, rows without an id yield, and of repeated rows one
    stays; null and empty texts are one group. Further columns are handed on."""
    return simhash.one_of_each_group(docs, SIMHASH_SHINGLE, SIMHASH_BITS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and all documents, if the benchmark is empty or null, stay; repeated
    rows stay or go together. Further columns are handed on."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced.

    Every row stays; null and empty texts and texts without secrets are unchanged. Further
    columns are handed on."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document.

    One row per row; null and empty texts have size 0; a null source is one of its own; an
    empty table gives an empty result."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = documents(spark, sf_dir)
    base = shared_path(spark, f"corpus-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs


QUERIES = {"pipeline": run}

#: SimHash groups, string tiles and lexed literals cannot be expressed in SQL.
ORACLE_SQL = None
ORACLE: dict[str, str] = {}

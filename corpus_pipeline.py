"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontamination, jaccard_join, packing, quality, secrets
from shelfmark.llm.exchange import checkpoint_dir

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", decontamination.stage),
    ("secret scans", secrets.stage),
    ("packing", packing.stage),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each result but the last is written to the shared folder and read again."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

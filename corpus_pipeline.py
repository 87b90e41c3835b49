"""Corpus pipeline: the stages a document table passes before training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.common import table
from panelweave.llm.stages import language, mixture, near_duplicates, no_benchmark, no_secrets
from panelweave.session import cut_lineage

STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_secrets),
    ("mixing sources to target weights", mixture),
]

# Fingerprints, a trained classifier and a knapsack have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs

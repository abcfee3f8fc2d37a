"""The corpus pipeline: quality classifier, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineup.llm import near_dup, packing, quality, substring_dup
from lineup.llm.common import documents, materialize

STAGES = [
    ("quality classifier", quality.stage),
    ("near-duplicate groups", near_dup.stage),
    ("repeated passages", substring_dup.stage),
    ("mixture packing", packing.stage),
]

#: SQL cannot express a trained classifier or a tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs

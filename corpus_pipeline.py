"""The corpus pipeline: quality rules, exact and near de-duplication, mixing and packing of ``documents``.

Each stage reads what the one before it wrote. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foresail.llm.common import scratch_path
from foresail.llm.exact_dedup import stage_exact_dedup
from foresail.llm.mixing import stage_mixing
from foresail.llm.near_dedup import stage_near_dedup
from foresail.llm.packing import stage_packing
from foresail.llm.quality_rules import stage_quality_rules

STAGES = [
    ("quality_rules", stage_quality_rules),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Near-duplicate components and least-squares packing are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to all documents; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

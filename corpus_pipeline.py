"""Documents to packed training sequences: language, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqrec.llm import stages
from seqrec.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("secrets", stages.secret_scan),
    ("mixing", stages.mixing_weights),
    ("packing", stages.pack),
]

#: The stages learn models and sample by hash; SQL cannot express them.  tests/llm holds run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

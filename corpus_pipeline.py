"""A corpus pipeline over documents, each stage reading what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparktile.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", stages.quality_classifier),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: The first stage is a learned model, which SQL cannot express; tests hold the run against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents`` of a folder; what each writes in the shared folder, the next one reads."""
    from sparktile.llm.common import Scratch, table

    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs

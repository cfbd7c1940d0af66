"""A training corpus from raw documents: five stages, each on all the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import discard, materialize, new_path, scratch
from tidemark.llm.decontamination import decontamination_stage
from tidemark.llm.packing import packing_stage
from tidemark.llm.pii import pii_stage
from tidemark.llm.simhash import simhash_stage
from tidemark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL has neither zstandard nor XXH64 nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus made from ``sf_dir``'s documents.

    A stage's intermediates, in a folder of its own, and the table before it go
    once its result is written.
    """
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "pipeline")
    for name, stage in STAGES:
        before = docs
        with scratch(spark, name):
            docs = materialize(stage(spark, before, sf_dir), name, f"{home}/{name}")
        discard(before)
    return docs

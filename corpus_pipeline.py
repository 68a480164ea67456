"""The document pipeline: each stage is one operator; what it returns is written as Parquet and reread.

A stage's own tables, and the output before the last, are removed as soon as its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm import minhash, mixing, packing, pii, quality_rules
from beaconry.llm.common import Stash, scratch

#: (name, function of session, documents and folder); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash", minhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express the sketches' banding, the classifier or the packing; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    outputs, before = Stash(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch():
            docs = outputs.put(stage(spark, docs, sf_dir))
        if before is not None:
            outputs.forget(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}

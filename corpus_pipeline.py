"""The corpus pipeline: documents become token files in five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, minhash, mixing, quality, tokens
from millrace.session import materialize, table

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", minhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("token-ID output", tokens.stage),
]

#: The classifier, the tokenizer and the coder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs

"""The training-data pipeline over ``documents``: stages that each apply one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoframe.llm import stages
from mnemoframe.llm.common import store, table

STAGES = [
    ("language", stages.keep_known_languages),
    ("near duplicates", stages.drop_near_duplicates),
    ("personal data", stages.redact_personal_data),
    ("source mix", stages.mix_sources),
    ("byte-level BPE", stages.encode_tokens),
]

# Learned languages and spans and the merges of a vocabulary have no SQL: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus cleaning: toxicity, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns
the columns of documents (the last one the packed pieces). run() writes each stage's rows and reads
them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import store, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near-duplicates", stages.drop_similar),
    ("decontamination", stages.drop_leaks),
    ("secrets", stages.mask_secrets),
    ("packing", stages.pack_tokens),
]

#: The learned toxicity model has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs

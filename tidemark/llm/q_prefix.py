"""Query of the prefix count operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import prefix_counts
from tidemark.llm.common import table
from tidemark.llm.q_packing import tokenizer_path
from tidemark.llm.registry import query

LIMIT = 4096


@query("op12_prefix_token_counts")
def op12_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = prefix_counts.token_totals(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return totals.withColumn("over_limit", F.col("n_tokens") > LIMIT)

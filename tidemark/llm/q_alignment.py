"""Query of the token alignment operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import token_alignment
from tidemark.llm.common import table
from tidemark.llm.q_packing import tokenizer_path
from tidemark.llm.registry import query


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                            tokenizer_path("piece_bpe_32k.model"))

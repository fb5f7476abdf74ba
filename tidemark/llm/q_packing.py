"""Query of the sequence packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing
from tidemark.llm.common import store, table
from tidemark.llm.registry import query


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def packed_digest(docs: DataFrame, cache: int = packing.CACHE) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids, and their places."""
    rows = packing.pieces(docs.select("doc_id", "text"), tokenizer_path(), cache=cache).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(store(rows, "pieces"))


@query("op7_sum_of_squares_packing")
def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))

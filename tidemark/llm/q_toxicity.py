"""Query of the toxicity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import held_out, id_bucket, table
from tidemark.llm.registry import query


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 5) != 0)
    out = docs.select("doc_id", toxicity.score_text(spark, chain)("text").alias("t"))
    spans = F.array_join(F.zip_with("t.starts", "t.ends", lambda a, b: F.concat_ws(":", a, b)), ",")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("t.score").alias("score"),
                      (F.col("t.score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))

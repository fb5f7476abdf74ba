"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import katz
from tidemark.llm.common import held_out, id_bucket, table
from tidemark.llm.registry import query


@query("op10_katz_scores")
def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = katz.train(docs.where(id_bucket(F.col("doc_id"), 10) != 0))
    return katz.score(docs.withColumn("held_out", held_out(F.col("doc_id"), 10, 0)), model)

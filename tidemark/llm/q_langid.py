"""Query of the language operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import held_out, table
from tidemark.llm.registry import query


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out & F.col("doc_id").isNotNull()))
    return docs.select("doc_id", langid.predict(spark, model)("text").alias("p")).select(
        "doc_id", out.alias("held_out"), "p.lang_pred", "p.score")

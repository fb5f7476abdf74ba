"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import store, table
from tidemark.llm.registry import query


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = store(docs.select("doc_id", quality.statistics_udf()("text").alias("stats")), "quality-statistics")
    x, poor = quality.training_rows(rows, table(spark, sf_dir, "labels"))
    rules = quality.learn(x, poor)
    stats = F.col("stats")
    return rows.select(
        "doc_id", *(stats[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        quality.base_failed(stats).alias("base_failed"), quality.verdict(stats, rules).alias("rule")).select(
        "*", (~F.col("base_failed") & (F.col("rule") < 0)).alias("kept"))

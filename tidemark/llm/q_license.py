"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import licenses
from tidemark.llm.common import table
from tidemark.llm.registry import query


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", licenses.scan_udf()("text").alias("m")).select(
        "doc_id", "m.n_words", "m.n_base", "m.first_word", "m.last_word", "m.base_labels", "m.labels", "m.binding",
        "m.expressions", "m.score")

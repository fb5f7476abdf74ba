"""Query of the main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html
from tidemark.llm.common import table
from tidemark.llm.registry import query


@query("op8_tag_path_text")
def op8_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html.extract_udf()("html").alias("m")).select(
        "page_id", "url", "m.text", F.length("m.text").cast("long").alias("n_chars"))

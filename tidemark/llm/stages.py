"""Stages of the corpus pipeline: each keeps or changes documents by one operator's decisions.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs (the packing
stage returns pieces). Columns beside text and doc_id are carried along untouched, whatever they are
called. Null texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, secrets, similar, toxicity
from tidemark.llm.common import fresh, id_bucket, settle, table
from tidemark.llm.q_packing import packed_digest


#: Words that a worker of the toxicity stage remembers, and texts it takes at once.
WORDS, TEXTS = 80_000, 200
#: Parts and pieces that a worker of the packing stage remembers: workers live on, and the next stages need the memory.
PACK_CACHE = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches 0.5 go; the chain learns from the labels as op1 does."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 5) != 0)
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = toxicity.scorer(shared.value, WORDS)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):  # few texts at a time are held as Python strings
                some = batch.slice(lo, TEXTS)
                yield some.filter(pa.array([one(t.as_py())[0] < 0.5 for t in some["text"]], pa.bool_()))
        one = batch = some = None
        settle()
    return docs.mapInArrow(run, docs.schema)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the least doc_id stays.

    Documents are linked by op2's method (SimHash fingerprints at 2 or fewer differing bits, by ball hashing), and also
    at a 5-word similarity of 0.8 or more, which finds edited copies whose fingerprints lie further apart.
    """
    return similar.keep_first(docs, prints=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or at a similarity of 0.8 or more, go."""
    for found in decontaminate.match_columns(docs, table(spark, sf_dir, "benchmark")):
        name = fresh(docs, "leaks")
        docs = docs.withColumn(name, F.size(found["items"])).where(F.col(name) == 0).drop(name)
    return docs


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked in its text; n_chars, where there is such a column, follows the text."""
    name, columns = fresh(docs, "spans"), docs.columns
    out = secrets.scan(docs, column=name)
    masked = out.withColumn("text", secrets.redact(F.col("text"), F.col(name)))
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences of at most 1024 tokens."""
    return packed_digest(docs, cache=PACK_CACHE)

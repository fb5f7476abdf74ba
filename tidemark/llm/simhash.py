"""Near-duplicate classes of documents from SimHash fingerprints and ball hashing.

Method (meet in the middle). Two fingerprints at no more than 2r differing bits have a third one
within r of both. So every distinct fingerprint is sent to all fingerprints within r of it (1 + 64
for r = 1, itself and each single flip); fingerprints that meet are links once verified. A ball of
radius 1 has 65 members, so a meeting point never holds more than 65 distinct fingerprints, whatever
the number of documents: no bucket is hot, and copies count once because documents are first
reduced to their distinct fingerprints.

All members of one meeting point are within 2r of each other, so the links of the point to its least
member join the same components as all its pairs; only those are kept, verified by bit count.

Special cases. Null and empty texts have fingerprint zero and link like any other. Repeated rows each
come back. A null doc_id never becomes a component_id unless all ids of the component are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import fresh, store
from tidemark.llm.components import components

SEED = 42
SHINGLE = 3
BALL = 1
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < size:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(size))))
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join every pair within 2 * BALL bits."""
    flips = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    ball = prints.select("fp", F.explode(F.array([F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("at"))
    met = (ball.groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
           .where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b").distinct())
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * BALL)


def classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, fp, root, component_id.

    root is the least fingerprint of the component, component_id its least doc_id.
    """
    rows = store(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    prints = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints))
    named = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = store(named, "classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "fp", "root", "component_id")


def keep_first(docs: DataFrame, classes=classes, print_udf=fingerprint_udf) -> DataFrame:
    """One row of each near-duplicate class: the row with its least doc_id.

    Of repeated rows with that id one stays; a class whose ids are all null keeps one row too.
    Text is moved only for the rows that stay.
    """
    key, mark, at = fresh(docs, "key"), fresh(docs, "root"), fresh(docs, "print")
    found = classes(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(key), F.col("fp").alias(at), F.col("root").alias(mark)).distinct()
    some = docs.join(kept.where(F.col(key).isNotNull()), F.col("doc_id") == F.col(key)).where(
        print_udf("text") == F.col(at)).dropDuplicates([key, mark])
    none = docs.where("doc_id is null").withColumn(at, print_udf("text")).join(
        kept.where(F.col(key).isNull()), at).dropDuplicates([mark])
    return some.select(docs.columns).unionByName(none.select(docs.columns))

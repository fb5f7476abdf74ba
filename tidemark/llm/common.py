"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """Whether a row belongs to the fold that no model learns from; false for a null id."""
    return F.coalesce(id_bucket(doc_id, n) == remainder, F.lit(False))


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write once to the folder that all executors share and read it back, partitioned by a column if named.

    Unlike a cached frame the copy survives lost executors, and later reads of it are pruned to the
    columns they need.
    """
    path = scratch_dir(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle() -> None:
    """Give back what a task has freed: Python workers live on, and what they keep counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim is not None:
        trim(0)


def per_text(make: Callable[[], Callable], schema: str):
    """An Arrow-batched column function: text -> struct of the given schema.

    make() runs once per task and returns the function that maps one text (or None) to one tuple,
    so tables and caches are built once. Rows are handled one text at a time, which bounds memory
    by the longest text and not by the batch.
    """
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = make()
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema).asNondeterministic()


class Memo(dict):
    """A bounded cache of a pure function.

    When full, its entries become the old generation, from which those still asked for come back;
    the generation before is dropped. So memory has a fixed limit and frequent keys stay.
    """

    def __init__(self, fn: Callable, limit: int = 400_000):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            super().clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}

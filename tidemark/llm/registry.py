"""Named queries of this subpackage and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MODULES = ("q_toxicity", "q_simhash", "q_decontaminate", "q_secrets", "q_packing", "q_langid", "q_quality", "q_html", "q_license",
           "q_katz", "q_prefix", "q_alignment", "q_collocations")


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable, with its oracle where SQL can say it."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidemark.llm.{name}")

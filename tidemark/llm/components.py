"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round. Large star: every larger neighbour of u moves to the least of u and its neighbours.
    Small star: every smaller neighbour of u, and u itself, moves there.

    The least neighbour is an aggregate with a map-side half, joined back to the links; a hub is a
    skewed side of that join, which adaptive execution splits, and no group is gathered.
    """
    if small:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = seen.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root), root being the least node of the component.

    Nodes without a link do not appear. Self-links and repeated links are allowed. Rounds go on
    until the links no longer change; each is written to the shared folder, so lineage stays short.
    """
    now = store(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = store(_star(_star(now, small=False), small=True), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark

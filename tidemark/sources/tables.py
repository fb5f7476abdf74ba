"""Table scans, sinks with a manifest, feature files and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import TABLES, coerce


def load_tables(spark: SparkSession, data_dir: str, names: Sequence[str] | None = None
                ) -> dict[str, DataFrame]:
    """Lazy scans of the named canonical tables with their declared types; others are refused."""
    names = list(names) if names is not None else list(TABLES)
    unknown = [n for n in names if n not in TABLES]
    if unknown:
        raise KeyError(f"unknown tables {unknown}")
    return {n: coerce(spark.read.schema(TABLES[n].struct()).parquet(f"{data_dir}/{n}.parquet"),
                      TABLES[n]) for n in names}


def content_hash(df: DataFrame) -> F.Column:
    """Order-insensitive content hash: the sum of row hashes, as an exact decimal."""
    return F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)"))


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows, columns, content_hash) of every table, one aggregation each."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                     F.lit(len(df.columns)).alias("columns"),
                     content_hash(df).cast("string").alias("content_hash"))
        out = row if out is None else out.unionByName(row)
    return out


def write_tables(tables: Mapping[str, DataFrame], out_dir: str) -> DataFrame:
    """One zstd Parquet folder per table plus a manifest; returns the manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(
            f"{out_dir}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    m = manifest({n: spark.read.parquet(f"{out_dir}/{n}.parquet") for n in tables})
    m.write.mode("overwrite").json(f"{out_dir}/manifest.json")
    return spark.read.json(f"{out_dir}/manifest.json")


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Feature file by extension; ids keep the declared (string) type in CSV, too."""
    kind = PurePosixPath(path).suffix
    if kind == ".csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    if kind == ".parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unsupported feature file {path}: use .csv or .parquet")


def write_scores(scores: DataFrame, rejected: DataFrame, out: str) -> None:
    """Scores and, next to them, the quarantined records."""
    scores.write.mode("overwrite").option("header", True).csv(f"{out}/scores.csv")
    rejected.write.mode("overwrite").option("header", True).csv(f"{out}/rejected.csv")


def clean_metrics(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles, NaN as null and infinities as text, ready for a JSON sink."""
    v = F.col("value")
    text = (F.when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
            .when(~F.isnan(v), F.round(v, digits).cast("string")))
    return metrics.withColumn("value", text)


def write_results(results: Mapping[str, DataFrame], metrics: DataFrame, out: str,
                  provenance: Mapping[str, str]) -> None:
    """One CSV folder per result table and one JSON folder of metric rows."""
    for name, df in results.items():
        df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")
    tagged = clean_metrics(metrics)
    for k, v in provenance.items():
        tagged = tagged.withColumn(k, F.lit(v))
    tagged.write.mode("overwrite").json(f"{out}/metrics.json")


def load_sections(spark: SparkSession, sections: Mapping[str, str], found: Sequence[str],
                  key: str) -> DataFrame:
    """Expected sections with a found flag and whether their provenance equals the first's.

    ``found`` lists the section folders that exist; the rest are reported missing.
    """
    rows = [(n, p, n in found) for n, p in sections.items()]
    expected = spark.createDataFrame(rows, "section string, path string, found boolean")
    seen = None
    for n in found:
        r = spark.read.json(f"{sections[n]}/metrics.json").agg(
            F.lit(n).alias("section"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        seen = r if seen is None else seen.unionByName(r)
    if seen is None:
        return expected.withColumn("consistent", F.lit(None).cast("boolean"))
    base = seen.agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).withColumn("_j", F.lit(1))
    j = expected.join(seen, "section", "left").withColumn("_j", F.lit(1)).join(
        F.broadcast(base), "_j")
    same = (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_lo")) & (
        F.col("_lo") == F.col("_hi"))
    return j.select("section", "path", "found", F.when(F.col("found"), same).alias("consistent"))

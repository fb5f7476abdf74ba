"""Tie-exact distributed ranking.

Every ranking metric needs running totals in score order. A window without a partition key would
pull all rows into one task, and a window per run would still do so for a run that holds a third of
the data. Here rows are first aggregated by (run, score), so any number of tied rows becomes one
row. Distinct scores are then cut into ordered buckets whose bounds come from a quantile sketch;
running totals are taken inside (run, bucket) and shifted by the totals of the earlier buckets. The
bounds only balance the work: the totals are exact for any bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Runs = Sequence[str]


def _default_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def score_bounds(df: DataFrame, cols: str | Sequence[str], buckets: int | None = None
                 ) -> list[float]:
    """Ascending bucket bounds of one or several numeric columns (a bounded sketch, one scan)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return sorted({b for per_col in column_bounds(df, cols, buckets) for b in per_col})


def column_bounds(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> list[list[float]]:
    """Bucket bounds of each column, in its own list (one scan)."""
    buckets = buckets or _default_buckets(df)
    if buckets < 2:
        return [[] for _ in cols]
    probs = [i / buckets for i in range(1, buckets)]
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(
        list(cols), probs, 1.0 / (4 * buckets))


def with_bucket(df: DataFrame, col: str, bounds: Sequence[float], name: str) -> DataFrame:
    """Order-preserving bucket number (binary search on the JVM side)."""
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol="_x", outputCol=name).transform(
        df.withColumn("_x", F.col(col).cast("double"))).drop("_x")


def by_score(df: DataFrame, score: str, sums: Mapping[str, Column], runs: Runs = ()) -> DataFrame:
    """One row per (run, distinct score) with the row count ``n`` and the requested sums."""
    return df.groupBy(*runs, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def running_totals(groups: DataFrame, sums: Sequence[str], runs: Runs = (), order: str = "score",
                   descending: bool = True, bounds: Sequence[float] = (),
                   then: Sequence[str] = ()) -> DataFrame:
    """Add ``before_x``, ``upto_x`` and ``total_x`` for every ``x`` in ``n`` and ``sums``.

    ``then`` holds ascending tie-break columns when the input has more than one row per score.
    """
    names = ["n", *sums]
    g = with_bucket(groups, order, bounds, "_bucket")
    keys = [*runs, "_bucket"]
    across = Window.partitionBy(*(runs or [F.lit(0)]))
    earlier = across.orderBy(F.desc("_bucket") if descending else F.asc("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = g.groupBy(*keys).agg(*[F.sum(x).alias(f"_t_{x}") for x in names])
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{x}").over(earlier), F.lit(0)).alias(f"_o_{x}")
                 for x in names],
        *[F.sum(f"_t_{x}").over(across).alias(f"total_{x}") for x in names])
    inside = Window.partitionBy(*keys).orderBy(
        F.desc(order) if descending else F.asc(order), *then).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = {x: F.col(f"_o_{x}") + F.sum(x).over(inside) for x in names}
    return (g.join(offsets, keys)
            .select("*", *[upto[x].alias(f"upto_{x}") for x in names])
            .select("*", *[(F.col(f"upto_{x}") - F.col(x)).alias(f"before_{x}") for x in names])
            .drop("_bucket", *[f"_o_{x}" for x in names]))


def running_extreme(groups: DataFrame, value: str, extreme: Callable[[str], Column], runs: Runs = (), order: str = "score",
                    descending: bool = False, bounds: Sequence[float] = ()) -> DataFrame:
    """``value`` replaced by its running maximum or minimum (``F.max`` or ``F.min``) in score order."""
    g = with_bucket(groups, order, bounds, "_bucket")
    keys = [*runs, "_bucket"]
    way = F.desc if descending else F.asc
    earlier = Window.partitionBy(*(runs or [F.lit(0)])).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = g.groupBy(*keys).agg(extreme(value).alias("_end")).select(*keys, extreme("_end").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    both = g.withColumn("_run", extreme(value).over(inside)).alias("g").join(carried.alias("c"), same)
    pick = F.greatest if extreme is F.max else F.least
    return both.select(*[pick("g._run", "c._carry").alias(value) if c == value else F.col(f"g.{c}") for c in groups.columns])


def ranked_scores(df: DataFrame, score: str, sums: Mapping[str, Column], runs: Runs = (),
                  descending: bool = True, bounds: Sequence[float] | None = None) -> DataFrame:
    """``by_score`` followed by ``running_totals``."""
    if bounds is None:
        bounds = score_bounds(df, score)
    return running_totals(by_score(df, score, sums, runs), list(sums), runs, "score", descending,
                          bounds)


def long_scores(df: DataFrame, policies: Mapping[str, str], keep: Sequence[str],
                name: str = "policy") -> DataFrame:
    """Unpivot several score columns into (policy, score) rows."""
    pairs = F.array(*[F.struct(F.lit(p).alias(name), F.col(c).cast("double").alias("score"))
                      for p, c in policies.items()])
    return df.select(*keep, F.inline(pairs))


def average_ranks(df: DataFrame, value: str, runs: Runs = (), descending: bool = False
                  ) -> DataFrame:
    """(run, value) rows with the average rank of the tied group and the population size."""
    r = ranked_scores(df, value, {}, runs, descending)
    return r.select(*runs, F.col("score").alias(value), "n",
                    (F.col("before_n") + (F.col("n") + 1) / 2).alias("avg_rank"),
                    F.col("total_n").alias("population"))


def row_ranks(df: DataFrame, score: str, entity: str, runs: Runs = (), name: str = "rank",
              descending: bool = True) -> DataFrame:
    """Add a 1-based rank by (score, entity id) and ``<name>_n``, the size of the run.

    A tied score may hold any share of the rows, so the id range is bucketed as well and the
    window only ever sees one (run, score, id bucket).
    """
    bounds, id_bounds = rank_bounds(df, score, entity)
    id_bucket = f"_{name}_id"
    rows = df.withColumn(id_bucket, _id_bucket(F.col(entity), id_bounds))
    keys = [*runs, score, id_bucket]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(groups, [], runs, score, descending, bounds, then=[id_bucket]).select(
        *keys, F.col("before_n").alias("_before"), F.col("total_n").alias(f"{name}_n"))
    within = Window.partitionBy(*keys).orderBy(entity)
    return (rows.join(before, keys)
            .withColumn(name, F.col("_before") + F.row_number().over(within))
            .drop("_before", id_bucket))


def several_ranks(df: DataFrame, entity: str, values: Mapping[str, str]) -> DataFrame:
    """(entity, rank per value, population) for several orderings, in one ranking job."""
    long = long_scores(df, values, [entity], "ordering")
    r = row_ranks(long, "score", entity, ["ordering"], "_r")
    return r.groupBy(entity).agg(
        *[F.max(F.when(F.col("ordering") == name, F.col("_r"))).alias(name) for name in values],
        *[F.max(F.when(F.col("ordering") == name, F.col("_r_n"))).alias(f"{name}_n")
          for name in values])


def rank_bounds(df: DataFrame, score: str, entity: str) -> tuple[list, list]:
    """Score and id bounds, from a single scan where both are numeric."""
    buckets = _default_buckets(df)
    if dict(df.dtypes)[entity] not in ("bigint", "int", "double") or buckets < 2:
        return score_bounds(df, score, buckets), id_range_bounds(df, entity, buckets)
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(score).cast("double").alias("s"), F.col(entity).cast("double").alias(
        "e")).approxQuantile(["s", "e"], probs, 1.0 / (4 * buckets))
    return sorted(set(found[0])), sorted(set(found[1]))


def id_range_bounds(df: DataFrame, entity: str, buckets: int | None = None) -> list:
    """Ordered bounds of an id column of any type, from a bounded hash-ordered sample of ids."""
    buckets = buckets or _default_buckets(df)
    dtype = dict(df.dtypes)[entity]
    if dtype in ("bigint", "int", "double"):
        return score_bounds(df, entity, buckets)
    sample = [r[0] for r in df.select(entity).where(F.col(entity).isNotNull()).distinct()
              .orderBy(F.xxhash64(entity)).limit(64 * buckets).collect()]
    ids = sorted(set(sample))
    return sorted({ids[i * len(ids) // buckets] for i in range(1, buckets)}) if ids else []


def _id_bucket(c: Column, bounds: Sequence) -> Column:
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= c))


def equal_frequency_bin(rank: Column, n: Column, bins: int) -> Column:
    """Equal-frequency bin of a first-rank: bin i holds ranks up to 1 + (n - 1) * i / bins."""
    whole = F.ceil(bins * (rank - 1) / F.greatest(n - 1, F.lit(1)))
    return F.greatest(F.lit(1), whole).cast("bigint")

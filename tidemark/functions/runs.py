"""Point-in-time aggregates of many runs without multiplying rows.

A feature of a run looks at the events before it. Copying each event to every run it is visible to
would multiply the rows that are shuffled by the number of runs; instead an event is aggregated once
per key, with one conditional column set per run, and the runs unfold when a key has a single row.
All parts of a feature row then share the partitioning on their key and are joined on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cols import plus_days, ts

RUN, SEEN = "run_cutoff", "_seen"


@dataclass(frozen=True)
class Window:
    """Which events a run sees, and one range that holds those of a first to a last run."""

    inside: Callable[[Column, Column], Column]
    outer: Callable[[Column, Column, Column], Column]


def before(lookback_days: int | None = None) -> Window:
    """Events strictly before the run, and within the lookback where one is given."""
    def inside(event: Column, run: Column) -> Column:
        ok = event < run
        return ok if lookback_days is None else ok & (event >= plus_days(run, -lookback_days))

    def outer(event: Column, first: Column, last: Column) -> Column:
        ok = event < last
        return ok if lookback_days is None else ok & (event >= plus_days(first, -lookback_days))
    return Window(inside, outer)


def ahead(horizon_days: int) -> Window:
    """Events of the outcome window ``[run, run + horizon)``."""
    return Window(lambda event, run: (event >= run) & (event < plus_days(run, horizon_days)),
                  lambda event, first, last: (event >= first) & (event < plus_days(last, horizon_days)))


def per_run(df: DataFrame, key: str, event: str, cutoffs: Sequence[str], window: Window,
            columns: Callable[[Column, Column], Mapping[str, Column]], name: str = "runs") -> DataFrame:
    """One row per key: an array with one struct per run, in the order of the cutoffs.

    ``columns(run, seen)`` gives the aggregates of one run; ``seen`` is true for the events in its
    window. The struct also counts these events as ``_seen``. Events outside the range of all
    windows are filtered first, and that range reaches the scan.
    """
    at = F.col(event)
    aggs, names = [], []
    for i, c in enumerate(cutoffs):
        run = ts(c)
        seen = window.inside(at, run)
        cols = {SEEN: F.count_if(seen), **columns(run, seen)}
        names = list(cols)
        aggs += [col.alias(f"_{i}_{k}") for k, col in cols.items()]
    some = window.outer(at, ts(min(cutoffs)), ts(max(cutoffs)))
    one = df.where(some).groupBy(key).agg(*aggs)
    structs = [F.struct(ts(c).alias(RUN), *[F.col(f"_{i}_{k}").alias(k) for k in names])
               for i, c in enumerate(cutoffs)]
    return one.select(key, F.array(*structs).alias(name))


def unfold(df: DataFrame, key: str, name: str = "runs") -> DataFrame:
    """(run, key) rows of one part, where the run saw any event."""
    rows = df.select(key, F.inline(name)).where(F.col(SEEN) > 0).drop(SEEN)
    return rows.select(RUN, key, *[c for c in rows.columns if c not in (RUN, key)])


def join_parts(base: DataFrame, parts: Mapping[str, DataFrame], key: str, n_runs: int) -> DataFrame:
    """Base rows (one per key, with the part columns it brings) and every part, joined on the key.

    Each part arrives as its array; ``rows_of`` unfolds all of them at once.
    """
    for name, part in parts.items():
        kind = part.schema[name].dataType.elementType
        nothing = F.array_repeat(F.lit(None).cast(kind), n_runs)
        base = base.join(part, key, "left").withColumn(name, F.coalesce(name, nothing))
    return base


def rows_of(df: DataFrame, names: Sequence[str], cutoffs: Sequence[str]) -> DataFrame:
    """One row per run: ``run_cutoff``, and the struct of each part under its name (null if none)."""
    runs = F.array(*[ts(c) for c in cutoffs])
    others = [c for c in df.columns if c not in names]
    zipped = F.arrays_zip(runs.alias(RUN), *[F.col(n) for n in names])
    return df.select(*others, F.explode(zipped).alias("_z")).select(*others, "_z.*")

"""Small column helpers shared by every operator (all stay inside generated code)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # standard normal quantile at 0.975


def ts(value: str) -> Column:
    """Zone-free timestamp literal; folds to a constant, so it reaches the Parquet filter."""
    return F.lit(str(value)).cast("timestamp_ntz")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plus_days(c: str | Column, days: int) -> Column:
    return as_col(c) + F.expr(f"INTERVAL '{int(days)}' DAY")


def micros(c: str | Column) -> Column:
    """Microseconds as a plain long, so that ages are integer arithmetic."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Fractional days, microsecond exact."""
    return (micros(end) - micros(start)) / F.lit(86_400e6)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3_600e6)


def day_of(c: str | Column) -> Column:
    return as_col(c).cast("date")


def month_of(c: str | Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(as_col(c).cast("date"), "MM")


def month_index(c: str | Column) -> Column:
    return (F.year(as_col(c)) * 12 + F.month(as_col(c)) - 1).cast("bigint")


def index_to_month(c: str | Column) -> Column:
    c = as_col(c)
    return F.make_date((c / 12).cast("int"), (c % 12 + 1).cast("int"), F.lit(1))


def flag(c: Column) -> Column:
    """Null-safe 0/1: a null condition counts as false."""
    return F.when(c, 1).otherwise(0)


def true_or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """Quotient, or ``default`` where the denominator is not positive."""
    other = F.lit(None).cast("double") if default is None else F.lit(default)
    return F.when(den > 0, num / den).otherwise(other)


def edges_at_or_below(c: Column, edges: Sequence[float]) -> Column:
    """Left-closed bucket index: how many edges are <= the value."""
    return reduce(lambda a, b: a + b, [flag(c >= F.lit(float(e))) for e in edges])


def edges_below(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bucket index: how many edges are < the value."""
    return reduce(lambda a, b: a + b, [flag(c > F.lit(float(e))) for e in edges])


def first_match(pairs: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """Ordered rules, first match wins."""
    out = None
    for cond, value in pairs:
        value = F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(otherwise))


def half_open_label(c: Column, edges: Sequence[float]) -> Column:
    """Right-open band label such as ``30-60`` or ``360+``."""
    pairs = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi == float("inf"):
            pairs.append((c >= lo, f"{int(lo)}+"))
        else:
            pairs.append(((c >= lo) & (c < hi), f"{int(lo)}-{int(hi)}"))
    return first_match(pairs, None)


def order_of(c: str | Column, values: Sequence[str]) -> Column:
    """Position of a category in a fixed order (for custom sorts)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), as_col(c))


def pick(c: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def fan_out(df: DataFrame, ts_col: str, cutoffs: Sequence[str], lookback_days: int | None = None,
            name: str = "run_cutoff") -> DataFrame:
    """One copy of a row for every cutoff strictly after it (and within the lookback).

    The cutoffs are a short parameter list, so this is a bounded ``explode`` that feeds the
    map-side half of the aggregation, not a join.
    """
    runs = F.array(*[ts(c) for c in cutoffs])
    event = F.col(ts_col)

    def visible(c: Column) -> Column:
        ok = event < c
        if lookback_days is not None:
            ok = ok & (event >= c - F.expr(f"INTERVAL '{int(lookback_days)}' DAY"))
        return ok

    bounded = event < ts(max(cutoffs))  # a plain range that reaches the Parquet filter
    if lookback_days is not None:
        bounded = bounded & (event >= plus_days(ts(min(cutoffs)), -lookback_days))
    return df.where(bounded).withColumn(name, F.explode(F.filter(runs, visible)))


def fan_forward(df: DataFrame, ts_col: str, cutoffs: Sequence[str], horizon_days: int,
                name: str = "run_cutoff") -> DataFrame:
    """One copy of a row for every cutoff whose outcome window ``[c, c + horizon)`` holds it."""
    event = F.col(ts_col)
    inside = F.filter(F.array(*[ts(c) for c in cutoffs]), lambda c: (event >= c) & (
        event < plus_days(c, horizon_days)))
    bounded = (event >= ts(min(cutoffs))) & (event < plus_days(ts(max(cutoffs)), horizon_days))
    return df.where(bounded).withColumn(name, F.explode(inside))


def rounded(df: DataFrame, digits: int = 4, skip: Sequence[str] = ()) -> DataFrame:
    """Round every double column for publication."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip
                       else F.col(f"`{n}`") for n, t in df.dtypes])

"""Point-in-time rules: strict cutoffs, half-open windows, snapshots, runs and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cols import plus_days, ts

# The event-time column of every timed table.
TIME_COLUMNS = {
    "campaigns": "start_date", "experiments": "start_date", "prospects": "created_at",
    "customers": "customer_since", "marketing_touches": "touch_at", "sessions": "session_start",
    "funnel_events": "event_ts", "orders": "order_ts", "subscription_events": "event_ts",
    "support_contacts": "contact_ts", "experiment_assignments": "assigned_at",
}


def _day(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


@dataclass(frozen=True)
class PredictionWindow:
    """Feature window before a cutoff and outcome window from it, inside a known data range."""

    cutoff: str
    horizon_days: int
    data_start: str
    data_end: str
    lookback_days: int | None = None

    def __post_init__(self) -> None:
        if self.horizon_days <= 0:
            raise ValueError("horizon_days must be positive")
        if self.lookback_days is not None and self.lookback_days <= 0:
            raise ValueError("lookback_days must be positive when given")
        if not _day(self.data_start) < _day(self.cutoff) < _day(self.data_end):
            raise ValueError(f"cutoff {self.cutoff} lies outside the data range")
        if _day(self.label_end) > _day(self.data_end):
            raise ValueError(f"outcome window ends {self.label_end}, after the data ends")

    @property
    def feature_start(self) -> str:
        if self.lookback_days is None:
            return self.data_start
        return str(max(_day(self.data_start),
                       _day(self.cutoff) - timedelta(days=self.lookback_days)))

    @property
    def label_end(self) -> str:
        return str(_day(self.cutoff) + timedelta(days=self.horizon_days))

    def in_features(self, c: Column) -> Column:
        return between(c, self.feature_start, self.cutoff)

    def in_labels(self, c: Column) -> Column:
        return between(c, self.cutoff, self.label_end)


def between(c: Column, start: str, end: str) -> Column:
    return (c >= ts(start)) & (c < ts(end))


def events_before(df: DataFrame, ts_col: str, cutoff: str) -> DataFrame:
    return df.where(F.col(ts_col) < ts(cutoff))


def events_between(df: DataFrame, ts_col: str, start: str, end: str) -> DataFrame:
    return df.where(between(F.col(ts_col), start, end))


def rolling_cutoffs(first: str, last: str, step_days: int) -> list[str]:
    """Evenly spaced dates, both ends included."""
    if step_days <= 0:
        raise ValueError("step_days must be positive")
    a, b = _day(first), _day(last)
    if b < a:
        raise ValueError("last must not precede first")
    return [str(a + timedelta(days=i)) for i in range(0, (b - a).days + 1, step_days)]


def monthly_runs(first: str, last: str) -> list[str]:
    """Month starts from ``first`` to ``last``, both included where they are month starts."""
    a, b = _day(first), _day(last)
    y, m = (a.year, a.month) if a.day == 1 else divmod(a.year * 12 + a.month, 12)
    if a.day != 1:
        m += 1
    out = []
    while date(y, m, 1) <= b:
        out.append(str(date(y, m, 1)))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def snapshot(tables: Mapping[str, DataFrame], cutoff: str) -> dict[str, DataFrame]:
    """Every table as it was known at the cutoff.

    Timed tables keep rows strictly before it, order lines follow their order, and contacts still
    open at the cutoff lose the resolution time and satisfaction score that came later.
    """
    out = {name: events_before(df, TIME_COLUMNS[name], cutoff) if name in TIME_COLUMNS else df
           for name, df in tables.items()}
    if "order_lines" in out and "orders" in out:
        out["order_lines"] = out["order_lines"].join(
            out["orders"].select("order_id"), "order_id", "left_semi").select(
            *tables["order_lines"].columns)
    if "support_contacts" in out:
        out["support_contacts"] = mask_open(out["support_contacts"], ts(cutoff))
    return out


def mask_open(contacts: DataFrame, cutoff: Column) -> DataFrame:
    """Hide outcomes of contacts that were resolved at or after the cutoff."""
    known = F.col("resolved_at") < cutoff
    return (contacts.withColumn("csat_score", F.when(known | F.col("resolved_at").isNull(),
                                                     F.col("csat_score")))
            .withColumn("resolved_at", F.when(known, F.col("resolved_at"))))


# ------------------------------------------------------------------ splits
@dataclass(frozen=True)
class SplitPlan:
    """Time-ordered fit, validation and holdout runs whose outcome windows never overlap."""

    fit: tuple[str, ...]
    validation: tuple[str, ...]
    holdout: tuple[str, ...]
    horizon_days: int
    data_end: str

    def __post_init__(self) -> None:
        if not (self.fit and self.validation and self.holdout):
            raise ValueError("fit, validation and holdout runs must all be non-empty")
        for earlier, later in ((self.fit, self.validation), (self.train, self.holdout)):
            end = max(map(_day, earlier)) + timedelta(days=self.horizon_days)
            if end > min(map(_day, later)):
                raise ValueError(f"an outcome window ends {end}, after a later run starts: labels "
                                 "would leak across the split")
        if max(map(_day, self.holdout)) + timedelta(days=self.horizon_days) > _day(self.data_end):
            raise ValueError("a holdout outcome window extends past the end of the data")

    @property
    def train(self) -> tuple[str, ...]:
        return self.fit + self.validation

    @property
    def runs(self) -> tuple[str, ...]:
        return self.train + self.holdout

    def role(self, run: str) -> str:
        for name in ("fit", "validation", "holdout"):
            if run in getattr(self, name):
                return name
        raise KeyError(run)

    def role_of(self, run: Column) -> Column:
        """Role of a run as a column (a short literal map, no join)."""
        out = F.lit(None).cast("string")
        for name in ("fit", "validation", "holdout"):
            out = F.when(run.isin([_day(r).isoformat() for r in getattr(self, name)]),
                         name).otherwise(out)
        return out


def split_summary(data: DataFrame, plan: SplitPlan, entity: str, label: str) -> DataFrame:
    """Runs, rows, distinct entities and positive rate per split."""
    role = plan.role_of(F.date_format("run_cutoff", "yyyy-MM-dd"))
    return (data.withColumn("split", role).where("split is not null").groupBy("split").agg(
        F.countDistinct("run_cutoff").alias("runs"),
        F.min("run_cutoff").cast("date").alias("first_run"),
        F.max("run_cutoff").cast("date").alias("last_run"),
        F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"),
        F.sum(F.col(label).cast("bigint")).alias("positives"), F.avg(label).alias("rate")))


def labels_mature(run: Column, horizon_days: int, data_end: str) -> Column:
    return plus_days(run, horizon_days) <= ts(data_end)


# ------------------------------------------------------------------ selections
def month_window(monthly: DataFrame, start: str, end: str, col: str = "month") -> DataFrame:
    lo, hi = sorted((start, end))
    return monthly.where(F.col(col).between(lo, hi))


def nearest_rows(curve: DataFrame, col: str, target: float) -> DataFrame:
    """Rows at the saved value of ``col`` closest to the request (smaller one on a tie)."""
    best = curve.agg(F.min(F.struct(F.abs(F.col(col) - target).alias("d"), F.col(col).alias("v")))
                     .alias("b")).select(F.col("b.v").alias("_v"))
    return curve.join(F.broadcast(best), equals_within(F.col(col), F.col("_v"))).drop("_v")


def equals_within(c: Column, value: float | Column, tolerance: float = 1e-9) -> Column:
    return F.abs(c - value) < tolerance

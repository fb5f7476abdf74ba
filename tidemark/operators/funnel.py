"""Ordered conversion funnel over contiguous stage prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import flag, plus_days, ratio, true_or_false, ts
from tidemark.operators.quality import backward_steps, stage_profile
from tidemark.schema import STAGES

N = len(STAGES)
STEPS = [f"{a}->{b}" for a, b in zip(STAGES[:-1], STAGES[1:])]


def prefix_depth(present: list) -> F.Column:
    """Longest prefix of true flags, as nested conditions."""
    out = F.lit(N)
    for k in range(N, 0, -1):
        out = F.when(present[k - 1], out).otherwise(k - 1)
    return out


def session_depth(events: DataFrame) -> DataFrame:
    """Deepest contiguous stage per session (0 without the first stage).

    One pass of OR-like flags per session: no sort, so a session with very many events is summed
    map-side like any other.
    """
    flags = [F.max(flag(F.col("stage_number") == k)).alias(f"_s{k}") for k in range(1, N + 1)]
    wide = events.groupBy("session_id").agg(*flags, F.max(F.when(
        F.col("stage_number").between(1, N), F.col("stage_number"))).alias("deepest"))
    return wide.select("session_id", prefix_depth(
        [F.col(f"_s{k}") == 1 for k in range(1, N + 1)]).alias("depth"), "deepest")


def funnel_integrity(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of event-log defects, one row per defect."""
    p = stage_profile(events)
    per = p.withColumn("_back", backward_steps(p)).groupBy("session_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dupes"), F.sum("_back").alias("back"))
    d = session_depth(events).join(per, "session_id")
    j = sessions.select("session_id", F.lit(1).alias("_known")).join(d, "session_id",
                                                                     "full_outer")
    zero = F.lit(0)
    agg = {
        "sessions": F.count("_known"), "events": F.coalesce(F.sum("n"), zero),
        "orphan_events": F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), zero),
        "sessions_without_events": F.count_if(F.col("n").isNull()),
        "sessions_missing_session_start": F.count_if(F.col("depth") == 0),
        "sessions_with_skipped_stages": F.count_if(F.col("deepest") > F.col("depth")),
        "duplicate_stage_events": F.coalesce(F.sum("dupes"), zero),
        "out_of_order_events": F.coalesce(F.sum("back"), zero)}
    one = j.agg(*[c.alias(k) for k, c in agg.items()])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(k).alias("defect"), F.col(k).cast("bigint").alias("rows")) for k in agg])))


def visit_numbers(sessions: DataFrame) -> DataFrame:
    """Prospect sessions labelled 1st, 2nd or 3rd+ over the whole history.

    Only the two earliest sessions matter, and both are plain minima: the second is the minimum
    of what is left once the first is removed. No per-person sort is needed.
    """
    s = sessions.where("customer_id is null").select(
        "session_id", "prospect_id", F.struct("session_start", "session_id").alias("_at"))
    first = s.groupBy("prospect_id").agg(F.min("_at").alias("_first"))
    j = s.join(first, "prospect_id")
    second = j.where("_at > _first").groupBy("prospect_id").agg(F.min("_at").alias("_second"))
    j = j.join(second, "prospect_id", "left")
    return j.select("session_id", F.when(F.col("_at") == F.col("_first"), "1st visit")
                    .when(F.col("_at") == F.col("_second"), "2nd visit")
                    .otherwise("3rd+ visit").alias("visit_number"))


def session_frame(sessions: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions of a period with depth, visitor type and visit number (depth >= 1 only)."""
    s = sessions.where((F.col("session_start") >= ts(start)) & (F.col("session_start") < ts(end)))
    return (s.join(session_depth(events).select("session_id", "depth"), "session_id")
            .where("depth >= 1").join(visit_numbers(sessions), "session_id", "left")
            .withColumn("visitor_type", F.when(F.col("customer_id").isNull(), "prospect")
                        .otherwise("customer")))


def reached_counts(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return frame.groupBy(*keys).agg(
        *[F.count_if(F.col("depth") >= k).alias(f"reached_{s}") for k, s in enumerate(STAGES, 1)])


def stage_table(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Units reaching each stage, step conversion and where the losses happen."""
    r = reached_counts(frame, keys)
    rows = F.array(*[F.struct(
        F.lit(k).cast("bigint").alias("stage_number"), F.lit(s).alias("stage"),
        F.col(f"reached_{s}").alias("reached"), F.col(f"reached_{STAGES[0]}").alias("_first"),
        F.col(f"reached_{STAGES[max(k - 2, 0)]}").alias("_prev"),
        F.col(f"reached_{STAGES[-1]}").alias("_last")) for k, s in enumerate(STAGES, 1)])
    t = r.select(*keys, F.inline(rows))
    lost = F.col("_prev") - F.col("reached")
    return t.select(*keys, "stage_number", "stage", "reached",
                    ratio(F.col("reached"), F.col("_first"), None).alias("share_of_start"),
                    ratio(F.col("reached"), F.col("_prev"), None).alias("step_conversion"),
                    lost.alias("lost_at_step"),
                    ratio(lost, F.col("_first") - F.col("_last")).alias("share_of_all_losses"))


def non_monotone(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows where more units are downstream than upstream (must be empty)."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("stage_number")  # a few stages each
    return table.withColumn("_prev", F.lag("reached").over(w)).where("reached > _prev").drop(
        "_prev")


def segment_funnel(frame: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Stage counts and step rates for every level of each dimension."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level"))
                      for d in dimensions])
    long = frame.select("depth", F.inline(pairs)).where("level is not null")
    r = reached_counts(long, ["dimension", "level"])
    rates = [ratio(F.col(f"reached_{b}"), F.col(f"reached_{a}"), None).alias(f"rate_{a}->{b}")
             for a, b in zip(STAGES[:-1], STAGES[1:])]
    return r.select("dimension", "level", F.col(f"reached_{STAGES[0]}").alias("sessions"),
                    *[f"reached_{s}" for s in STAGES], *rates,
                    ratio(F.col(f"reached_{STAGES[-1]}"), F.col(f"reached_{STAGES[0]}"), None)
                    .alias("session_to_purchase"))


def dropoff_opportunity(segments: DataFrame, dimension: str, reference: str) -> DataFrame:
    """Extra step completions if every level converted like the reference level."""
    seg = segments.where(F.col("dimension") == dimension)
    rate = {s: F.col(f"`rate_{s}`") for s in STEPS}
    ref = seg.where(F.col("level") == reference).select(
        F.col("dimension"), *[rate[s].alias(f"_ref{i}") for i, s in enumerate(STEPS)])
    rows = []
    for i, s in enumerate(STEPS):
        downstream = F.lit(1.0)
        for later in STEPS[i + 1:]:
            downstream = downstream * rate[later]
        rows.append(F.struct(F.lit(s).alias("step"),
                             F.col(f"reached_{STAGES[i]}").alias("entering"),
                             rate[s].alias("level_rate"),
                             F.col(f"_ref{i}").alias("reference_rate"),
                             downstream.alias("_down")))
    t = seg.where(F.col("level") != reference).join(F.broadcast(ref), "dimension").select(
        "dimension", "level", F.lit(reference).alias("reference"), F.inline(F.array(*rows)))
    gap = F.col("reference_rate") - F.col("level_rate")
    return t.select("dimension", "level", "reference", "step", "entering", "level_rate",
                    "reference_rate", gap.alias("rate_gap"),
                    (F.col("entering") * gap).alias("extra_step_completions"),
                    (F.col("entering") * gap * F.col("_down")).alias("purchase_equivalents"))


def prospect_funnel(prospects: DataFrame, sessions: DataFrame, events: DataFrame, start: str,
                    end: str, window_days: int) -> DataFrame:
    """Deepest stage within ``window_days`` of creation for leads created in ``[start, end)``."""
    cohort = prospects.where((F.col("created_at") >= ts(start)) & (F.col("created_at") < ts(end)))
    cohort = cohort.select("prospect_id", "created_at", "device_type", "acquisition_channel")
    s = sessions.select("session_id", "prospect_id", "session_start").join(
        cohort.select("prospect_id", "created_at"), "prospect_id").where(
        (F.col("session_start") >= F.col("created_at"))
        & (F.col("session_start") < plus_days("created_at", window_days)))
    best = s.join(session_depth(events), "session_id", "left").groupBy("prospect_id").agg(
        F.max(F.coalesce("depth", F.lit(0))).alias("depth"))
    return cohort.join(best, "prospect_id", "left").withColumn("depth", F.coalesce("depth",
                                                                                   F.lit(0)))


def step_highlights(segments: DataFrame, min_entering: int = 1000) -> DataFrame:
    """Weakest level of each step among levels with enough entering units (else any level)."""
    rows = [F.struct(F.lit(s).alias("step"), F.col(f"reached_{STAGES[i]}").alias("entering"),
                     F.col(f"`rate_{s}`").alias("rate")) for i, s in enumerate(STEPS)]
    long = segments.select("dimension", "level", F.inline(F.array(*rows))).where("entering > 0")
    enough = true_or_false(F.col("entering") >= min_entering)
    pick = F.struct("rate", "dimension", "level")
    best = long.groupBy("step").agg(F.min(F.when(enough, pick)).alias("_e"),
                                    F.min(pick).alias("_a"))
    w = F.coalesce("_e", "_a")
    return best.select("step", w["dimension"].alias("dimension"), w["level"].alias("level"),
                       w["rate"].alias("rate"))


def loss_summary(table: DataFrame) -> DataFrame:
    """Step with the largest loss and step with the lowest conversion (earliest on a tie)."""
    name = F.element_at(F.array(*[F.lit(s) for s in STEPS]),
                        (F.col("stage_number") - 1).cast("int"))
    t = table.where("stage_number > 1").withColumn("step", name)
    return t.agg(F.max_by("step", F.struct("lost_at_step", -F.col("stage_number")))
                 .alias("largest_loss_step"),
                 F.min_by("step", F.struct("step_conversion", "stage_number"))
                 .alias("lowest_step_conversion"))

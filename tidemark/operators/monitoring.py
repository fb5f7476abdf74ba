"""Reference profiles, drift statistics and matured performance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.operators.ranking import long_scores, ranked_scores, score_bounds

# Fixed values.
PSI_BINS, PSI_FLOOR, QUANTILES = 10, 1e-4, 1000
PSI_MODERATE, PSI_MAJOR, AUC_DROP = 0.10, 0.25, 0.05
CALIBRATION_LOW, CALIBRATION_HIGH, Z95 = 0.80, 1.25, 1.959964
SEVERITY = ("ok", "watch", "investigate", "recalibrate", "retrain")
RECOMMENDATIONS = {
    "ok": "no action", "watch": "review moved inputs", "investigate": "confirm the shift",
    "recalibrate": "refit the calibration", "retrain": "retrain on recent runs"}


def numeric_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return long_scores(df, {f: f for f in features}, list(keep), "feature")


def by_value(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Ascending running counts per (feature, distinct value)."""
    bounds = score_bounds(df, list(features))
    return ranked_scores(numeric_long(df, features), "score", {}, ["feature"], descending=False,
                         bounds=bounds)


def quantile_edges(ranked: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Interior edges at observed values (inverted CDF), repeats collapsed, per feature.

    Read off the running counts, so no task ever holds a feature's values.
    """
    cuts = F.array(*[F.lit(i) for i in range(1, bins)])
    hit = ranked.withColumn("i", F.explode(F.filter(cuts, lambda i: (
        F.col("upto_n") * bins >= i * F.col("total_n"))
        & (F.col("before_n") * bins < i * F.col("total_n")))))
    return hit.groupBy("feature").agg(F.sort_array(F.collect_set("score")).alias("edges"))


def exact_quantiles(ranked: DataFrame, steps: int = QUANTILES) -> DataFrame:
    """(feature, j, value): linearly interpolated quantiles j / steps, from running counts.

    A by-value row covers a range of order positions, hence a range of j; each j is emitted by
    exactly one row for its lower and one for its upper neighbour.
    """
    last = F.greatest(F.col("total_n") - 1, F.lit(1))
    before, upto = F.col("before_n"), F.col("upto_n")

    def ceil_div(a: Column) -> Column:
        return F.ceil(a / last).cast("bigint")

    def floor_div(a: Column) -> Column:
        return F.floor(a / last).cast("bigint")

    lo_a, lo_b = ceil_div(before * steps), ceil_div(upto * steps) - 1
    hi_a, hi_b = floor_div((before - 1) * steps) + 1, floor_div((upto - 1) * steps)

    def emit(a: Column, b: Column, name: str) -> DataFrame:
        a, b = F.greatest(a, F.lit(0)), F.least(b, F.lit(steps))
        return ranked.where(a <= b).select("feature", F.explode(F.sequence(a, b)).alias("j"),
                                           F.col("score").alias(name), "total_n")

    j = emit(lo_a, lo_b, "lo").join(emit(hi_a, hi_b, "hi").drop("total_n"), ["feature", "j"])
    pos = F.col("j") * (F.col("total_n") - 1) / steps
    frac = pos - F.floor(pos)
    return j.select("feature", "j", (F.col("lo") + (F.col("hi") - F.col("lo")) * frac)
                    .alias("value"))


def bin_shares(df: DataFrame, features: Sequence[str], edges: DataFrame,
               keys: Sequence[str] = ()) -> DataFrame:
    """Right-closed bin shares per feature (and key); empty bins are present with share 0.

    ``edges`` has one short row per feature, so it is the small side by construction.
    """
    e = edges.select("feature", "edges")
    rows = numeric_long(df, features, keys).join(F.broadcast(e), "feature")
    b = F.size(F.filter("edges", lambda x: x < F.col("score")))
    t = rows.groupBy(*keys, "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    pairs = t.select(*keys, "feature").distinct().join(F.broadcast(e), "feature").select(
        *keys, "feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    full = pairs.join(t, [*keys, "feature", "bin"], "left")
    total = F.sum("n").over(Window.partitionBy(*keys, "feature"))  # at most ten bins
    return full.select(*keys, "feature", "bin",
                       (F.coalesce("n", F.lit(0)) / total).alias("share"))


def level_shares(df: DataFrame, levels: Mapping[str, Sequence[str]], keys: Sequence[str] = ()
                 ) -> DataFrame:
    """Shares over declared levels per categorical feature; absent levels have share 0."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level"))
                      for f in levels])
    t = df.select(*keys, F.inline(pairs)).groupBy(*keys, "feature", "level").agg(
        F.count(F.lit(1)).alias("n"))
    t = t.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "feature")))
    declared = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("level"))
                         for f, vs in levels.items() for v in vs])
    totals = t.groupBy(*keys, "feature").agg(F.max("total").alias("total"))
    grid = df.sparkSession.range(1).select(F.inline(declared))
    return (totals.join(F.broadcast(grid), "feature").join(t.drop("total"),
                                                           [*keys, "feature", "level"], "left")
            .select(*keys, "feature", "level",
                    (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share")))


def psi(reference: Column, current: Column) -> Column:
    """Population stability index as an aggregate over floored shares."""
    r = F.greatest(reference, F.lit(PSI_FLOOR))
    c = F.greatest(current, F.lit(PSI_FLOOR))
    return F.sum((c - r) * F.log(c / r))


def numeric_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Edges, shares, mean and range per numeric feature: the stored reference."""
    edges = cut(quantile_edges(by_value(df, features)))
    shares = bin_shares(df, features, edges).groupBy("feature").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bin", "share"))),
                    lambda s: s["share"]).alias("shares"))
    stats = numeric_long(df, features).groupBy("feature").agg(
        F.avg("score").alias("mean"), F.min("score").alias("lowest"),
        F.max("score").alias("highest"))
    return cut(edges.join(shares, "feature").join(stats, "feature"))


def numeric_drift(profile: DataFrame, current: DataFrame, features: Sequence[str],
                  keys: Sequence[str] = ()) -> DataFrame:
    """PSI, means and the share outside the reference range per feature (and run)."""
    ref = profile.select("feature", F.posexplode("shares").alias("bin", "ref_share"))
    cur = bin_shares(current, features, profile, keys)
    p = cur.join(F.broadcast(ref), ["feature", "bin"]).groupBy(*keys, "feature").agg(
        psi(F.col("ref_share"), F.col("share")).alias("psi"))
    m = numeric_long(current, features, keys).join(F.broadcast(
        profile.select("feature", "mean", "lowest", "highest")), "feature")
    outside = (F.col("score") < F.col("lowest")) | (F.col("score") > F.col("highest"))
    s = m.groupBy(*keys, "feature").agg(
        F.max("mean").alias("reference_mean"), F.avg("score").alias("current_mean"),
        F.avg(outside.cast("double")).alias("outside_reference_range"))
    return p.join(s, [*keys, "feature"]).withColumn("kind", F.lit("numeric"))


def categorical_drift(reference: DataFrame, current: DataFrame,
                      levels: Mapping[str, Sequence[str]], keys: Sequence[str] = ()
                      ) -> DataFrame:
    """PSI and the level whose share moved most, per categorical feature."""
    ref = level_shares(reference, levels).withColumnRenamed("share", "ref_share")
    cur = level_shares(current, levels, keys)
    j = cur.join(F.broadcast(ref), ["feature", "level"])
    move = F.abs(F.col("share") - F.col("ref_share"))
    top = F.max_by(F.struct("level", "ref_share", "share"), F.struct(move, "level"))
    covered = F.sum(F.when(F.col("ref_share") > 0, F.col("share")).otherwise(0.0))
    out = j.groupBy(*keys, "feature").agg(psi(F.col("ref_share"), F.col("share")).alias("psi"),
                                          top.alias("_t"), covered.alias("_c"))
    return out.select(*keys, "feature", "psi", F.col("_t.ref_share").alias("reference_mean"),
                      F.col("_t.share").alias("current_mean"),
                      (1 - F.col("_c")).alias("outside_reference_range"),
                      F.lit("categorical").alias("kind"),
                      F.col("_t.level").alias("most_shifted_level"))


def psi_status(value: Column) -> Column:
    return (F.when(value >= PSI_MAJOR, "investigate").when(value >= PSI_MODERATE, "watch")
            .otherwise("ok"))


def reference_percentile(df: DataFrame, score: str, quantiles: Sequence[float],
                         name: str = "reference_percentile") -> DataFrame:
    """Percent of the reference at or below each score; ``quantiles`` is the stored short list."""
    distinct = sorted(set(quantiles))
    upto, seen = [0.0], 0
    for v in distinct:
        seen += sum(1 for q in quantiles if q == v)
        upto.append(100.0 * seen / len(quantiles))
    b = Bucketizer(splits=[float("-inf"), *distinct, float("inf")], inputCol="_s",
                   outputCol="_b").transform(df.withColumn("_s", F.col(score).cast("double")))
    table = F.array(*[F.lit(v) for v in upto])
    return b.withColumn(name, F.element_at(table, (F.col("_b") + 1).cast("int"))).drop("_s", "_b")


def auc_standard_error(auc: Column, pos: Column, neg: Column) -> Column:
    """Hanley-McNeil standard error."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    var = (auc * (1 - auc) + (pos - 1) * (q1 - auc * auc) + (neg - 1) * (q2 - auc * auc)) / (
        pos * neg)
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def performance(df: DataFrame, score: str, label: str, runs: Sequence[str]) -> DataFrame:
    """AUC with interval and calibration-in-the-large with its z score, per run."""
    from tidemark.operators.metrics import discrimination
    d = discrimination(df, {score: score}, label, runs).drop("model")
    y, p = F.col(label).cast("double"), F.col(score)
    s = df.groupBy(*runs).agg(F.avg(y).alias("observed_rate"), F.avg(p).alias("mean_predicted"),
                              F.sum(y).alias("_y"), F.sum(p).alias("_e"),
                              F.sum(p * (1 - p)).alias("_v"))
    if runs:
        j = d.join(s, list(runs))
    else:
        j = d.withColumn("_j", F.lit(1)).join(s.withColumn("_j", F.lit(1)), "_j").drop("_j")
    pos, neg = F.col("positives"), F.col("rows") - F.col("positives")
    se = auc_standard_error(F.col("roc_auc"), pos, neg)
    return j.select(*runs, "rows", "observed_rate", "mean_predicted",
                    (F.col("_y") / F.col("_e")).alias("observed_to_predicted"),
                    ((F.col("_y") - F.col("_e")) / F.sqrt("_v")).alias("calibration_z"),
                    "roc_auc", (F.col("roc_auc") - Z95 * se).alias("roc_auc_ci_low"),
                    (F.col("roc_auc") + Z95 * se).alias("roc_auc_ci_high"), "average_precision")


def findings(drift: DataFrame, perf: DataFrame, reference_auc: float, run: str) -> DataFrame:
    """Material and significant changes only, one row each."""
    moved = drift.where(psi_status(F.col("psi")) != "ok").select(
        F.lit("feature_drift").alias("check_name"), psi_status(F.col("psi")).alias("severity"),
        F.col("feature").alias("subject"))
    worse = (F.col("roc_auc") < reference_auc - AUC_DROP) & (
        F.col("roc_auc_ci_high") < reference_auc)
    off = ~F.col("observed_to_predicted").between(CALIBRATION_LOW, CALIBRATION_HIGH) & (
        F.abs("calibration_z") > Z95)
    subject = F.col(run).cast("string").alias("subject")
    a = perf.where(worse).select(F.lit("discrimination").alias("check_name"),
                                 F.lit("retrain").alias("severity"), subject)
    b = perf.where(off).select(F.lit("calibration").alias("check_name"),
                               F.lit("recalibrate").alias("severity"), subject)
    return moved.unionByName(a).unionByName(b)


def overall_status(found: DataFrame) -> DataFrame:
    """Highest severity among the findings and what to do about it."""
    order = F.array(*[F.lit(s) for s in SEVERITY])
    top = found.agg(F.coalesce(F.max(F.array_position(order, F.col("severity"))),
                               F.lit(1)).alias("_r"), F.count(F.lit(1)).alias("findings"))
    text = F.element_at(F.array(*[F.lit(RECOMMENDATIONS[s]) for s in SEVERITY]),
                        F.col("_r").cast("int"))
    return top.select(F.element_at(order, F.col("_r").cast("int")).alias("status"), "findings",
                      text.alias("recommendation"))


def monitor(reference: DataFrame, current: DataFrame, numeric: Sequence[str],
            levels: Mapping[str, Sequence[str]], score: str, label: str, run: str,
            mature: Column, reference_auc: float) -> dict[str, DataFrame]:
    """Pooled and worst-run drift, score drift, matured performance, findings and status."""
    features = [*numeric, score]
    profile = numeric_profile(reference, features)

    def drift(keys: Sequence[str]) -> DataFrame:
        num = numeric_drift(profile, current, features, keys)
        return num.unionByName(categorical_drift(reference, current, levels, keys),
                               allowMissingColumns=True)

    worst = drift([run]).groupBy("feature").agg(
        F.max("psi").alias("max_run_psi"), F.max_by(run, F.struct("psi", run)).alias("max_run"))
    pooled = drift([]).join(worst, "feature").withColumn("status", psi_status(F.col("psi")))
    perf = performance(current.where(mature), score, label, [run])
    found = findings(pooled, perf, reference_auc, run)
    pending = current.where(~mature).groupBy(run).agg(F.count(F.lit(1)).alias("records"))
    return {"drift": pooled, "performance": perf, "findings": found, "pending": pending,
            "status": overall_status(found)}


def cross_check(metrics: DataFrame, recorded: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Recorded champion metrics against recomputed ones."""
    j = metrics.join(recorded.select("model", F.col("roc_auc").alias("recorded_auc")), "model",
                     "full_outer")
    ok = F.coalesce(F.abs(F.col("roc_auc") - F.col("recorded_auc")) < tolerance, F.lit(False))
    return j.select("model", "roc_auc", "recorded_auc", ok.alias("consistent"))

"""Ranking, calibration and regression metrics over scored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import first_match, ratio
from tidemark.operators.ranking import (
    average_ranks,
    by_score,
    equal_frequency_bin,
    long_scores,
    ranked_scores,
    row_ranks,
    running_totals,
    score_bounds,
)
from tidemark.operators.replicates import interval_table, resample

Policies = Mapping[str, str]


def _y(label: str) -> Column:
    return F.col(label).cast("double")


# ------------------------------------------------------------------ discrimination
def roc_auc_from(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank-sum ROC AUC and average precision from by-score running totals (``pos`` summed)."""
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg * (F.col("before_pos") + F.col("pos") / 2))
    p, n = F.max("total_pos"), F.max("total_n")
    ap = F.sum(F.col("pos") * F.col("upto_pos") / F.col("upto_n"))
    return ranked.groupBy(*keys).agg(
        n.alias("rows"), p.alias("positives"), ratio(area, p * (n - p), None).alias("roc_auc"),
        ratio(ap, p, None).alias("average_precision"))


def discrimination(df: DataFrame, scores: Policies, label: str, runs: Sequence[str] = ()
                   ) -> DataFrame:
    """Exact ROC AUC and average precision per score column (and per run)."""
    bounds = score_bounds(df, list(dict.fromkeys(scores.values())))
    rows = long_scores(df, scores, [*runs, label], "model")
    keys = [*runs, "model"]
    return roc_auc_from(ranked_scores(rows, "score", {"pos": _y(label)}, keys, bounds=bounds),
                        keys)


def single_feature_auc(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """max(AUC, 1 - AUC) of every feature on its own."""
    out = discrimination(df, {f: f for f in features}, label)
    return out.select(F.col("model").alias("feature"),
                      F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"))


# ------------------------------------------------------------------ top shares
def capture(df: DataFrame, scores: Policies, targets: Mapping[str, Column],
            shares: Sequence[float], runs: Sequence[str]) -> DataFrame:
    """Expected target sums in the top ``share`` of every run, pooled over runs.

    Ties are resolved by expectation, a fractional last row counts pro rata. One row per
    (model, share) with ``contacts``, the totals and one column per target.
    """
    base = df.select(*runs, *dict.fromkeys(scores.values()),
                     *[c.alias(f"_y_{k}") for k, c in targets.items()])
    bounds = score_bounds(df, list(dict.fromkeys(scores.values())))
    rows = long_scores(base, scores, [*runs, *[f"_y_{k}" for k in targets]], "model")
    keys = ["model", *runs]
    ranked = ranked_scores(rows, "score", {k: F.col(f"_y_{k}") for k in targets}, keys,
                           bounds=bounds)
    return top_sums(ranked, list(targets), shares, keys, ["model"])


def top_sums(ranked: DataFrame, targets: Sequence[str], shares: Sequence[float],
             keys: Sequence[str], pooled: Sequence[str]) -> DataFrame:
    """Top-share sums from by-score running totals; a by-score row only expands to the shares
    whose cut lies beyond it."""
    cut = F.array(*[F.lit(float(s)) for s in shares])
    reached = ranked.withColumn("share", F.explode(F.filter(
        cut, lambda s: F.col("before_n") < s * F.col("total_n"))))
    k = F.col("share") * F.col("total_n")
    part = F.greatest(F.lit(0.0), F.least(k - F.col("before_n"), F.col("n"))) / F.col("n")
    per_run = reached.groupBy(*keys, "share").agg(
        F.max(k).alias("contacts"), F.max("total_n").alias("rows"),
        *[F.sum(part * F.col(t)).alias(t) for t in targets],
        *[F.max(f"total_{t}").alias(f"total_{t}") for t in targets])
    return per_run.groupBy(*pooled, "share").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("contacts").alias("contacts"),
        F.sum("rows").alias("rows"), *[F.sum(t).alias(t) for t in targets],
        *[F.sum(f"total_{t}").alias(f"total_{t}") for t in targets])


def top_share_metrics(df: DataFrame, scores: Policies, label: str, shares: Sequence[float],
                      runs: Sequence[str]) -> DataFrame:
    """Precision, recall and lift at the given shares."""
    c = capture(df, scores, {"hits": _y(label)}, shares, runs)
    base = F.col("total_hits") / F.col("rows")
    return c.select("model", "share", "contacts", "hits",
                    ratio(F.col("hits"), F.col("contacts"), None).alias("precision"),
                    ratio(F.col("hits"), F.col("total_hits"), None).alias("recall"),
                    (F.col("hits") / F.col("contacts") / base).alias("lift"))


def gains_curve(df: DataFrame, scores: Policies, label: str, shares: Sequence[float],
                runs: Sequence[str]) -> DataFrame:
    c = capture(df, scores, {"hits": _y(label)}, shares, runs)
    return c.select("model", "share", ratio(F.col("hits"), F.col("total_hits"), None)
                    .alias("captured"))


def _with_random(c: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Add the untargeted policy, evaluated by expectation from one of the scored policies."""
    one = c.groupBy("share").agg(*[F.first(x).alias(x) for x in c.columns
                                   if x not in ("model", "share")])
    rnd = one.select(F.lit("random").alias("model"), "share", "runs", "contacts", "rows",
                     *[(F.col("share") * F.col(f"total_{t}")).alias(t) for t in targets],
                     *[f"total_{t}" for t in targets])
    return c.unionByName(rnd)


def budget_simulation(df: DataFrame, policies: Policies, label: str, capacities: Sequence[float],
                      runs: Sequence[str]) -> DataFrame:
    """What a fixed share of every run reaches, per policy, against no targeting."""
    c = _with_random(capture(df, policies, {"hits": _y(label)}, capacities, runs), ["hits"])
    random_hits = F.col("share") * F.col("total_hits")
    return c.select(
        F.col("share").alias("capacity_share"), F.col("model").alias("policy"),
        (F.col("contacts") / F.col("runs")).alias("contacts_per_run"),
        (F.col("hits") / F.col("runs")).alias("conversions_reached_per_run"),
        F.col("hits").alias("conversions_reached_total"),
        (F.col("hits") / F.col("contacts")).alias("precision"),
        (F.col("hits") / F.col("total_hits")).alias("share_of_conversions_captured"),
        (F.col("hits") / random_hits).alias("lift_vs_random"),
        ratio(F.col("contacts"), F.col("hits"), None).alias("contacts_per_conversion"))


def depth_table(df: DataFrame, scores: Policies, label: str, depths: Sequence[float],
                runs: Sequence[str]) -> DataFrame:
    c = _with_random(capture(df, scores, {"hits": _y(label)}, depths, runs), ["hits"])
    base = F.col("total_hits") / F.col("rows")
    return c.select(
        F.col("share").alias("depth"), "model",
        (F.col("contacts") / F.col("runs")).alias("customers_per_run"),
        (F.col("hits") / F.col("runs")).alias("churners_reached_per_run"),
        (F.col("hits") / F.col("contacts")).alias("precision"),
        (F.col("hits") / F.col("total_hits")).alias("recall"),
        (F.col("hits") / F.col("contacts") / base).alias("lift"))


# ------------------------------------------------------------------ probability quality
def probability_metrics(df: DataFrame, scores: Policies, label: str) -> DataFrame:
    """Brier score and skill, clipped log loss and mean prediction per score."""
    rows = long_scores(df, scores, [label], "model")
    y, p = _y(label), F.col("score")
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    out = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("base_rate"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"),
        F.avg(p).alias("mean_predicted"))
    spread = F.col("base_rate") * (1 - F.col("base_rate"))
    return out.withColumn("brier_skill", 1 - F.col("brier") / spread)


def calibration_table(df: DataFrame, scores: Policies, label: str, entity: str, bins: int = 10
                      ) -> DataFrame:
    """Equal-frequency bins of the first-rank: size, mean prediction and observed rate."""
    rows = long_scores(df, scores, [entity, label], "model")
    r = row_ranks(rows, "score", entity, ["model"], "r", descending=False)
    return (r.withColumn("bin", equal_frequency_bin(F.col("r"), F.col("r_n"), bins))
            .groupBy("model", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_predicted"),
                 F.avg(_y(label)).alias("observed_rate")))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted"))
    return table.groupBy("model").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def decile_table(df: DataFrame, score: str, label: str, entity: str, runs: Sequence[str],
                 bins: int = 10) -> DataFrame:
    """Equal groups within every run by descending score, pooled over runs."""
    r = row_ranks(df.select(*runs, entity, score, label), score, entity, runs, "r")
    t = (r.withColumn("decile", equal_frequency_bin(F.col("r"), F.col("r_n"), bins))
         .groupBy("decile").agg(F.count(F.lit(1)).alias("customers"),
                                F.sum(F.col(label).cast("bigint")).alias("positives"),
                                F.avg(score).alias("mean_score")))
    whole = Window.partitionBy(F.lit(0))  # at most ``bins`` rows reach these windows
    upto = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.col("positives") / F.col("customers")
    base = F.sum("positives").over(whole) / F.sum("customers").over(whole)
    return t.select("decile", "customers", "positives", "mean_score", rate.alias("rate"),
                    (rate / base).alias("lift"),
                    (F.sum("positives").over(upto) / F.sum("positives").over(whole))
                    .alias("cumulative_capture"))


def per_run_metrics(df: DataFrame, score: str, label: str, run: str) -> DataFrame:
    """One monitoring row per run: size, observed and predicted rate, AUC."""
    bounds = score_bounds(df, score)
    g = by_score(df, score, {"pos": _y(label)}, [run])
    r = running_totals(g, ["pos"], [run], bounds=bounds)
    sums = g.groupBy(run).agg((F.sum("pos") / F.sum("n")).alias("observed_rate"),
                              (F.sum(F.col("score") * F.col("n")) / F.sum("n"))
                              .alias("mean_predicted"))
    return roc_auc_from(r, [run]).drop("average_precision").join(sums, run)


# ------------------------------------------------------------------ value ranking
def lorenz(df: DataFrame, scores: Policies, value: str) -> DataFrame:
    """Cumulative population and value shares at tied-group boundaries, per score."""
    bounds = score_bounds(df, list(dict.fromkeys(scores.values())))
    rows = long_scores(df, scores, [value] if value not in scores.values() else
                       [F.col(value)], "model")
    r = ranked_scores(rows, "score", {"y": _y(value)}, ["model"], bounds=bounds)
    return r.select("model", "score", "n", (F.col("upto_n") / F.col("total_n")).alias("cum_n"),
                    (F.col("upto_y") / F.col("total_y")).alias("cum_y"),
                    (F.col("before_n") / F.col("total_n")).alias("prev_n"),
                    (F.col("before_y") / F.col("total_y")).alias("prev_y"))


def gini(curve: DataFrame) -> DataFrame:
    """Trapezoid Gini of each Lorenz curve."""
    area = F.sum((F.col("cum_n") - F.col("prev_n")) * (F.col("cum_y") + F.col("prev_y")) / 2)
    return curve.groupBy("model").agg((2 * area - 1).alias("gini"))


def normalized_gini(df: DataFrame, scores: Policies, value: str) -> DataFrame:
    """Gini relative to ranking by the realised value itself."""
    g = gini(lorenz(df, {**scores, "_oracle": value}, value))
    best = g.where("model = '_oracle'").select(F.col("gini").alias("_best"), F.lit(1).alias("_j"))
    return (g.where("model <> '_oracle'").withColumn("_j", F.lit(1)).join(F.broadcast(best), "_j")
            .select("model", "gini", (F.col("gini") / F.col("_best")).alias("normalized_gini")))


def value_capture(df: DataFrame, scores: Policies, value: str, shares: Sequence[float]
                  ) -> DataFrame:
    """Value held by the top shares per policy, with the random and perfect-foresight policies."""
    c = capture(df, {**scores, "oracle": value}, {"y": _y(value)}, shares, [])
    c = _with_random(c, ["y"])
    captured = F.col("y") / F.col("total_y")
    return c.select(F.col("share").alias("share_targeted"), F.col("model").alias("policy"),
                    F.col("contacts").alias("customers"), F.col("y").alias("revenue_captured"),
                    captured.alias("share_of_revenue"),
                    (F.col("y") / F.col("contacts")).alias("revenue_per_customer"),
                    (captured / F.col("share")).alias("lift"))


def regression_metrics(df: DataFrame, scores: Policies, value: str) -> DataFrame:
    """RMSE, MAE, bias and R2 per score."""
    rows = long_scores(df, scores, [F.col(value).cast("double").alias("_y")], "model")
    y, p = F.col("_y"), F.col("score")
    agg = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((y > 0).cast("double")).alias("buyer_rate"),
        F.avg(y).alias("actual_mean"), F.avg(p).alias("predicted_mean"),
        (F.sum(p) / F.sum(y) - 1).alias("bias"), F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("_mse"), F.var_pop(y).alias("_var"))
    return agg.select("model", "rows", "buyer_rate", "actual_mean", "predicted_mean", "bias",
                      "mae", F.sqrt("_mse").alias("rmse"),
                      (1 - F.col("_mse") / F.col("_var")).alias("r2"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks: both rank tables are by distinct value."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("w"))
    ra = average_ranks(df, a).select(a, F.col("avg_rank").alias("ra"))
    rb = average_ranks(df, b).select(b, F.col("avg_rank").alias("rb"))
    j = pairs.join(ra, a).join(rb, b)
    return j.select(F.lit(a).alias("x"), F.lit(b).alias("y"), "w", "ra", "rb").groupBy(
        "x", "y").agg(weighted_corr("ra", "rb", "w").alias("spearman"))


def weighted_corr(x: str, y: str, w: str) -> Column:
    sw = F.sum(w)
    mx, my = F.sum(F.col(w) * F.col(x)) / sw, F.sum(F.col(w) * F.col(y)) / sw
    cov = F.sum(F.col(w) * F.col(x) * F.col(y)) / sw - mx * my
    vx = F.sum(F.col(w) * F.col(x) * F.col(x)) / sw - mx * mx
    vy = F.sum(F.col(w) * F.col(y) * F.col(y)) / sw - my * my
    return cov / F.sqrt(vx * vy)


def value_deciles(df: DataFrame, score: str, value: str, entity: str, bins: int = 10
                  ) -> DataFrame:
    r = row_ranks(df.select(entity, score, value), score, entity, [], "r")
    t = (r.withColumn("decile", equal_frequency_bin(F.col("r"), F.col("r_n"), bins))
         .groupBy("decile").agg(
             F.count(F.lit(1)).alias("customers"), F.avg(score).alias("mean_predicted"),
             F.avg(value).alias("mean_actual"),
             F.avg((F.col(value) > 0).cast("double")).alias("buyer_rate"),
             F.sum(value).alias("actual_revenue")))
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("actual_revenue").over(whole)
    return t.select("*", (F.col("actual_revenue") / total).alias("share_of_revenue"),
                    (F.sum("actual_revenue").over(upto) / total).alias("cumulative_capture"),
                    (F.col("mean_predicted") / F.col("mean_actual")).alias("predicted_to_actual"))


def active_subset_metrics(df: DataFrame, scores: Policies, value: str, active: Column
                          ) -> DataFrame:
    """Headline value metrics restricted to an active subset."""
    sub = df.where(active)
    m = regression_metrics(sub, scores, value).select(
        "model", F.col("rows").alias("customers"), "rmse", "bias")
    top = capture(sub, scores, {"y": _y(value)}, [0.1], []).select(
        "model", (F.col("y") / F.col("total_y")).alias("capture_top10"))
    base = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"),
                  F.sum(F.when(active, F.col(value))).alias("_va")).withColumn("_j", F.lit(1))
    return (m.join(top, "model").join(normalized_gini(sub, scores, value).drop("gini"), "model")
            .withColumn("_j", F.lit(1)).join(F.broadcast(base), "_j")
            .select("model", "customers", (F.col("customers") / F.col("_n"))
                    .alias("share_of_base"), (F.col("_va") / F.col("_v"))
                    .alias("share_of_future_revenue"), "rmse", "bias", "capture_top10",
                    "normalized_gini"))


# ------------------------------------------------------------------ segments
def segment_drivers(df: DataFrame, segments: Mapping[str, Column], label: str, score: str
                    ) -> DataFrame:
    """Observed and predicted rates per level of every segment (one pass over the rows)."""
    levels = F.array(*[F.struct(F.lit(k).alias("segment"), c.cast("string").alias("level"))
                       for k, c in segments.items()])
    t = df.select(F.inline(levels), _y(label).alias("y"), F.col(score).alias("p")).groupBy(
        "segment", "level").agg(F.count(F.lit(1)).alias("customer_runs"), F.sum("y").alias("_s"),
                                F.avg("p").alias("mean_predicted"))
    per = Window.partitionBy("segment")  # bounded: one row per level
    base = F.sum("_s").over(per) / F.sum("customer_runs").over(per)
    rate = F.col("_s") / F.col("customer_runs")
    return t.select("segment", "level", "customer_runs",
                    (F.col("customer_runs") / F.sum("customer_runs").over(per))
                    .alias("share_of_base"), rate.alias("churn_rate"), "mean_predicted",
                    (rate / base).alias("relative_risk"))


def band(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-open labelled bands; values outside every band read ``nan``."""
    pairs = [((c >= lo) & (c < hi), lab) for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return first_match(pairs, "nan")


# ------------------------------------------------------------------ resampling
def cluster_bootstrap(df: DataFrame, scores: Policies, label: str, cluster: str,
                      replicates: int = 200, seed: int = 0, references: Sequence[str] = ()
                      ) -> DataFrame:
    """Percentile intervals of AUC and average precision, and of differences to the references."""
    r = resample(df, scores, label, cluster, replicates, seed)
    return interval_table(df.sparkSession, list(scores), {
        "roc_auc": r.roc_auc(), "average_precision": r.average_precision()}, references)


def value_bootstrap(df: DataFrame, scores: Policies, value: str, cluster: str,
                    replicates: int = 200, seed: int = 0, references: Sequence[str] = ()
                    ) -> DataFrame:
    """Percentile intervals of the value metrics, and of differences to the references."""
    r = resample(df, {**scores, "_oracle": value}, value, cluster, replicates, seed)
    gini = r.gini()
    stats = {"rmse": (r.squares / r.n) ** 0.5, "mae": r.errors / r.n,
             "normalized_gini": gini / gini[-1], "capture_top10": r.top / r.v}
    return interval_table(df.sparkSession, list(scores),
                          {k: x[:-1] for k, x in stats.items()}, references)

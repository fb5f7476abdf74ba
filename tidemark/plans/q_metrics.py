"""Ranking, calibration, value and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cols import rounded
from tidemark.operators import metrics as m
from tidemark.operators import ranking as rk
from tidemark.plans.registry import query
from tidemark.sources.adapters import score_frame
from tidemark.sources.oracle_views import with_views

SCORES = {"score_a": "score_a", "score_b": "score_b"}
RUN = ["run_cutoff"]

LONG = """
lng AS (SELECT entity_id, run_cutoff, label, value, 'score_a' AS model, score_a AS score FROM scored
        UNION ALL
        SELECT entity_id, run_cutoff, label, value, 'score_b' AS model, score_b AS score FROM scored),
gr AS (SELECT model, run_cutoff, score, count(*) AS n, sum(label) AS pos FROM lng GROUP BY ALL),
rr AS (SELECT *, sum(n) OVER w - n AS before_n, sum(pos) OVER w - pos AS before_pos,
              sum(n) OVER w AS upto_n, sum(pos) OVER w AS upto_pos,
              sum(n) OVER p AS total_n, sum(pos) OVER p AS total_pos
       FROM gr WINDOW w AS (PARTITION BY model, run_cutoff ORDER BY score DESC),
                      p AS (PARTITION BY model, run_cutoff)),
ga AS (SELECT model, score, count(*) AS n, sum(label) AS pos FROM lng GROUP BY ALL),
ra AS (SELECT *, sum(n) OVER w - n AS before_n, sum(pos) OVER w - pos AS before_pos,
              sum(n) OVER w AS upto_n, sum(pos) OVER w AS upto_pos,
              sum(n) OVER p AS total_n, sum(pos) OVER p AS total_pos
       FROM ga WINDOW w AS (PARTITION BY model ORDER BY score DESC), p AS (PARTITION BY model))
"""
AUC = ("sum((n - pos) * (before_pos + pos / 2.0::DOUBLE)) / "
       "(max(total_pos) * (max(total_n) - max(total_pos)))")


def cap_sql(shares: str) -> str:
    return f"""
cut AS (SELECT unnest({shares}::DOUBLE[]) AS share),
pr AS (SELECT model, run_cutoff, share, max(share * total_n) AS contacts, max(total_n) AS rows,
              sum(greatest(0.0::DOUBLE, least(share * total_n - before_n, n)) / n * pos) AS hits,
              max(total_pos) AS total_hits FROM rr, cut GROUP BY ALL),
cap AS (SELECT model, share, count(*) AS runs, sum(contacts) AS contacts, sum(rows) AS rows,
               sum(hits) AS hits, sum(total_hits) AS total_hits FROM pr GROUP BY ALL),
capr AS (SELECT * FROM cap UNION ALL
         SELECT 'random', share, runs, contacts, rows, share * total_hits, total_hits
         FROM cap WHERE model = 'score_a')
"""


@query("m1_roc_auc", with_views(f"""
SELECT model, CAST(max(total_n) AS BIGINT) AS rows, CAST(max(total_pos) AS BIGINT) AS positives,
       round({AUC}, 6) AS roc_auc FROM ra GROUP BY model""", LONG))
def m1(spark, sf):
    d = m.discrimination(score_frame(spark, sf), SCORES, "label")
    return d.select("model", "rows", F.col("positives").cast("bigint").alias("positives"),
                    F.round("roc_auc", 6).alias("roc_auc"))


@query("m1_roc_auc_per_run", with_views(f"""
SELECT model, run_cutoff, round({AUC}, 6) AS roc_auc FROM rr GROUP BY model, run_cutoff""", LONG))
def m1_runs(spark, sf):
    d = m.discrimination(score_frame(spark, sf), SCORES, "label", RUN)
    return d.select("model", "run_cutoff", F.round("roc_auc", 6).alias("roc_auc"))


@query("m2_average_precision", with_views("""
SELECT model, round(sum(pos * upto_pos / CAST(upto_n AS DOUBLE)) / max(total_pos), 6)
       AS average_precision FROM ra GROUP BY model""", LONG))
def m2(spark, sf):
    d = m.discrimination(score_frame(spark, sf), SCORES, "label")
    return d.select("model", F.round("average_precision", 6).alias("average_precision"))


@query("m3_hits_at_k", with_views("""
SELECT model, run_cutoff, round(sum(greatest(0.0::DOUBLE, least(25.5::DOUBLE - before_n, n)) / n
       * pos), 4) AS expected_hits FROM rr GROUP BY ALL""", LONG))
def m3(spark, sf):
    d = score_frame(spark, sf)
    rows = rk.long_scores(d, SCORES, ["run_cutoff", "label"], "model")
    r = rk.ranked_scores(rows, "score", {"pos": F.col("label")}, ["model", "run_cutoff"],
                         bounds=rk.score_bounds(d, ["score_a", "score_b"]))
    part = F.greatest(F.lit(0.0), F.least(F.lit(25.5) - F.col("before_n"), F.col("n")))
    return r.groupBy("model", "run_cutoff").agg(
        F.round(F.sum(part / F.col("n") * F.col("pos")), 4).alias("expected_hits"))


@query("m4_capture_by_share", with_views("""
SELECT model, share, round(contacts, 4) AS contacts, round(hits, 4) AS hits FROM cap""",
                                         LONG + "," + cap_sql("[0.05, 0.1, 0.33]")))
def m4(spark, sf):
    c = m.capture(score_frame(spark, sf), SCORES, {"hits": F.col("label")}, [0.05, 0.1, 0.33], RUN)
    return rounded(c.select("model", "share", "contacts", "hits"), 4)


@query("m5_top_share_metrics", with_views("""
SELECT model, share, round(hits / contacts, 6) AS precision, round(hits / total_hits, 6) AS recall,
       round(hits / contacts / (total_hits / CAST(rows AS DOUBLE)), 6) AS lift FROM cap""",
                                          LONG + "," + cap_sql("[0.1, 0.2]")))
def m5(spark, sf):
    c = m.top_share_metrics(score_frame(spark, sf), SCORES, "label", [0.1, 0.2], RUN)
    return rounded(c.select("model", "share", "precision", "recall", "lift"), 6)


@query("m6_probability_metrics", with_views("""
SELECT model, count(*) AS rows, round(avg(label), 6) AS base_rate,
  round(avg((score - label) * (score - label)), 6) AS brier,
  round(1 - avg((score - label) * (score - label)) / (avg(label) * (1 - avg(label))), 6)
    AS brier_skill,
  round(avg(-(label * ln(greatest(1e-6, least(1 - 1e-6, score)))
      + (1 - label) * ln(1 - greatest(1e-6, least(1 - 1e-6, score))))), 6) AS log_loss,
  round(avg(score), 6) AS mean_predicted FROM lng GROUP BY model""", LONG))
def m6(spark, sf):
    return rounded(m.probability_metrics(score_frame(spark, sf), SCORES, "label"), 6)


CALIB = LONG + """,
cb AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, entity_id) AS r,
              count(*) OVER (PARTITION BY model) AS cn FROM lng),
ct AS (SELECT model, greatest(1, CAST(ceil(10 * (r - 1) / CAST(cn - 1 AS DOUBLE)) AS BIGINT)) AS bin,
              count(*) AS n, avg(score) AS mean_predicted, avg(label) AS observed_rate
       FROM cb GROUP BY ALL)
"""


@query("m7_calibration_table", with_views("""
SELECT model, bin, n, round(mean_predicted, 6) AS mean_predicted,
       round(observed_rate, 6) AS observed_rate FROM ct""", CALIB))
def m7(spark, sf):
    return rounded(m.calibration_table(score_frame(spark, sf), SCORES, "label", "entity_id"), 6)


@query("m8_expected_calibration_error", with_views("""
SELECT model, round(sum(n * abs(observed_rate - mean_predicted)) / sum(n), 6) AS ece
FROM ct GROUP BY model""", CALIB))
def m8(spark, sf):
    t = m.calibration_table(score_frame(spark, sf), SCORES, "label", "entity_id")
    return rounded(m.expected_calibration_error(t), 6)


@query("m10_decile_table", with_views("""
SELECT decile, customers, positives, round(mean_score, 6) AS mean_score,
  round(positives / CAST(customers AS DOUBLE), 6) AS rate,
  round(positives / CAST(customers AS DOUBLE) / (sum(positives) OVER () /
        CAST(sum(customers) OVER () AS DOUBLE)), 6) AS lift,
  round(sum(positives) OVER (ORDER BY decile) / CAST(sum(positives) OVER () AS DOUBLE), 6)
    AS cumulative_capture
FROM (SELECT decile, count(*) AS customers, CAST(sum(label) AS BIGINT) AS positives,
             avg(score_a) AS mean_score
      FROM (SELECT *, greatest(1, CAST(ceil(10 * (r - 1) / CAST(cn - 1 AS DOUBLE)) AS BIGINT))
              AS decile
            FROM (SELECT *, row_number() OVER (PARTITION BY run_cutoff
                          ORDER BY score_a DESC, entity_id) AS r,
                        count(*) OVER (PARTITION BY run_cutoff) AS cn FROM scored))
      GROUP BY decile)"""))
def m10(spark, sf):
    return rounded(m.decile_table(score_frame(spark, sf), "score_a", "label", "entity_id", RUN), 6)


GAIN_SHARES = [i / 50 for i in range(51)]


@query("m11_gains_curve", with_views("""
SELECT model, share, round(hits / total_hits, 6) AS captured FROM cap WHERE share > 0""",
                                     LONG + "," + cap_sql(str(GAIN_SHARES))))
def m11(spark, sf):
    c = m.gains_curve(score_frame(spark, sf), SCORES, "label", GAIN_SHARES, RUN)
    return rounded(c.where("share > 0"), 6)


@query("m12_budget_simulation", with_views("""
SELECT share AS capacity_share, model AS policy, round(contacts / runs, 4) AS contacts_per_run,
  round(hits / runs, 4) AS conversions_reached_per_run,
  round(hits, 6) AS conversions_reached_total, round(hits / contacts, 6) AS precision,
  round(hits / total_hits, 6) AS share_of_conversions_captured,
  round(hits / (share * total_hits), 6) AS lift_vs_random,
  round(contacts / hits, 4) AS contacts_per_conversion FROM capr""",
                                           LONG + "," + cap_sql("[0.05, 0.1, 0.2, 0.3]")))
def m12(spark, sf):
    b = m.budget_simulation(score_frame(spark, sf), SCORES, "label", [0.05, 0.1, 0.2, 0.3], RUN)
    six = ("conversions_reached_total", "precision", "share_of_conversions_captured", "lift_vs_random")
    return b.select(*[F.round(c, 6 if c in six else 4).alias(c) if c not in
                      ("policy", "capacity_share") else F.col(c) for c in b.columns])


@query("m13_depth_table", with_views("""
SELECT share AS depth, model, round(contacts / runs, 4) AS customers_per_run,
  round(hits / runs, 4) AS churners_reached_per_run, round(hits / contacts, 4) AS precision,
  round(hits / total_hits, 4) AS recall,
  round(hits / contacts / (total_hits / CAST(rows AS DOUBLE)), 4) AS lift FROM capr""",
                                     LONG + "," + cap_sql("[0.05, 0.1, 0.2, 0.3]")))
def m13(spark, sf):
    return rounded(m.depth_table(score_frame(spark, sf), SCORES, "label", [0.05, 0.1, 0.2, 0.3],
                                 RUN), 4, skip=("depth",))


@query("m14_cluster_bootstrap")
def m14(spark, sf):
    return rounded(m.cluster_bootstrap(score_frame(spark, sf), SCORES, "label", "cluster_id",
                                       replicates=200, seed=7, references=["score_b"]), 6)


@query("m14_value_bootstrap")
def m14_value(spark, sf):
    return rounded(m.value_bootstrap(score_frame(spark, sf), SCORES, "value", "cluster_id",
                                     replicates=200, seed=7, references=["score_b"]), 6)


@query("m16_per_run_monitoring", with_views(f"""
SELECT run_cutoff, CAST(max(total_n) AS BIGINT) AS rows, CAST(max(total_pos) AS BIGINT)
       AS positives, round(sum(pos) / CAST(sum(n) AS DOUBLE), 6) AS observed_rate,
       round(sum(score * n) / sum(n), 6) AS mean_predicted, round({AUC}, 6) AS roc_auc
FROM rr WHERE model = 'score_a' GROUP BY run_cutoff""", LONG))
def m16(spark, sf):
    d = m.per_run_metrics(score_frame(spark, sf), "score_a", "label", "run_cutoff")
    return rounded(d.withColumn("positives", F.col("positives").cast("bigint")), 6)


VAL = """
vl AS (SELECT entity_id, value AS y, 'score_a' AS model, score_a AS score FROM scored UNION ALL
       SELECT entity_id, value, 'score_b', score_b FROM scored UNION ALL
       SELECT entity_id, value, 'oracle', value FROM scored),
vg AS (SELECT model, score, count(*) AS n, sum(y) AS sy FROM vl GROUP BY ALL),
vc AS (SELECT model, score, n, sy, sum(n) OVER w / CAST(sum(n) OVER p AS DOUBLE) AS cum_n,
              sum(sy) OVER w / sum(sy) OVER p AS cum_y,
              (sum(n) OVER w - n) / CAST(sum(n) OVER p AS DOUBLE) AS prev_n,
              (sum(sy) OVER w - sy) / sum(sy) OVER p AS prev_y,
              sum(n) OVER p AS total_n, sum(sy) OVER p AS total_y, sum(n) OVER w - n AS before_n
       FROM vg WINDOW w AS (PARTITION BY model ORDER BY score DESC), p AS (PARTITION BY model)),
gi AS (SELECT model, 2 * sum((cum_n - prev_n) * (cum_y + prev_y) / 2) - 1 AS gini
       FROM vc GROUP BY model)
"""


@query("m17_lorenz", with_views("""
SELECT model, round(score, 6) AS score, n, round(cum_n, 6) AS cum_n, round(cum_y, 6) AS cum_y
FROM vc WHERE model <> 'oracle'""", VAL))
def m17(spark, sf):
    c = m.lorenz(score_frame(spark, sf), SCORES, "value")
    return rounded(c.select("model", "score", "n", "cum_n", "cum_y"), 6)


@query("m18_value_capture", with_views("""
SELECT share AS share_targeted, policy, round(k, 4) AS customers, round(y, 4) AS revenue_captured,
       round(y / total_y, 4) AS share_of_revenue, round(y / k, 4) AS revenue_per_customer,
       round(y / total_y / share, 4) AS lift FROM cr""", VAL + """,
cut AS (SELECT unnest([0.01, 0.05, 0.1, 0.2]::DOUBLE[]) AS share),
cp AS (SELECT model AS policy, share, max(share * total_n) AS k,
       sum(greatest(0.0::DOUBLE, least(share * total_n - before_n, n)) / n * sy) AS y,
       max(total_y) AS total_y FROM vc, cut GROUP BY ALL),
cr AS (SELECT * FROM cp UNION ALL SELECT 'random', share, k, share * total_y, total_y
       FROM cp WHERE policy = 'score_a')
"""))
def m18(spark, sf):
    return rounded(m.value_capture(score_frame(spark, sf), SCORES, "value",
                                   [0.01, 0.05, 0.1, 0.2]), 4, skip=("share_targeted",))


@query("m19_normalized_gini", with_views("""
SELECT model, round(gini, 6) AS gini, round(gini / (SELECT gini FROM gi WHERE model = 'oracle'), 6)
       AS normalized_gini FROM gi WHERE model <> 'oracle'""", VAL))
def m19(spark, sf):
    return rounded(m.normalized_gini(score_frame(spark, sf), SCORES, "value"), 6)


@query("m20_regression_metrics", with_views("""
SELECT model, count(*) AS rows, round(avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0 END), 4)
  AS buyer_rate, round(avg(y), 4) AS actual_mean, round(avg(score), 4) AS predicted_mean,
  round(sum(score) / sum(y) - 1, 4) AS bias, round(avg(abs(y - score)), 4) AS mae,
  round(sqrt(avg((y - score) * (y - score))), 4) AS rmse,
  round(1 - avg((y - score) * (y - score)) / var_pop(y), 4) AS r2
FROM vl WHERE model <> 'oracle' GROUP BY model""", VAL))
def m20(spark, sf):
    return rounded(m.regression_metrics(score_frame(spark, sf), SCORES, "value"), 4)


@query("m20_spearman", with_views("""
SELECT 'score_b' AS x, 'value' AS y, round(corr(rx, ry), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0::DOUBLE
           AS rx,
         rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE
           AS ry FROM scored)"""))
def m20s(spark, sf):
    return rounded(m.spearman(score_frame(spark, sf), "score_b", "value"), 6)


@query("m21_value_deciles", with_views("""
SELECT decile, customers, round(mean_predicted, 4) AS mean_predicted,
  round(mean_actual, 4) AS mean_actual, round(buyer_rate, 4) AS buyer_rate,
  round(actual_revenue, 2) AS actual_revenue,
  round(actual_revenue / sum(actual_revenue) OVER (), 4) AS share_of_revenue,
  round(sum(actual_revenue) OVER (ORDER BY decile) / sum(actual_revenue) OVER (), 4)
    AS cumulative_capture, round(mean_predicted / mean_actual, 4) AS predicted_to_actual
FROM (SELECT greatest(1, CAST(ceil(10 * (r - 1) / CAST(cn - 1 AS DOUBLE)) AS BIGINT)) AS decile,
             count(*) AS customers, avg(score_b) AS mean_predicted, avg(value) AS mean_actual,
             avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS buyer_rate,
             sum(value) AS actual_revenue
      FROM (SELECT *, row_number() OVER (ORDER BY score_b DESC, entity_id) AS r,
                   count(*) OVER () AS cn FROM scored) GROUP BY 1)"""))
def m21(spark, sf):
    t = m.value_deciles(score_frame(spark, sf), "score_b", "value", "entity_id")
    return t.select(*[F.round(c, 2 if c == "actual_revenue" else 4).alias(c)
                      if c not in ("decile", "customers") else F.col(c) for c in t.columns])


@query("m22_active_subset", with_views("""
SELECT model, customers, round(sob, 6) AS share_of_base, round(sov, 6) AS share_of_future_revenue,
       round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(cap, 6) AS capture_top10,
       round(gini / og, 6) AS normalized_gini
FROM (SELECT model, count(*) AS customers, sqrt(avg((y - score) * (y - score))) AS rmse,
             sum(score) / sum(y) - 1 AS bias,
             count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE) AS sob,
             sum(y) / (SELECT sum(value) FROM scored) AS sov FROM al
      WHERE model <> 'oracle' GROUP BY model)
JOIN (SELECT model, 2 * sum((cum_n - prev_n) * (cum_y + prev_y) / 2) - 1 AS gini,
             sum(greatest(0.0::DOUBLE, least(0.1::DOUBLE * total_n - before_n, n)) / n * sy) /
               max(total_y) AS cap FROM ac GROUP BY model) USING (model),
(SELECT 2 * sum((cum_n - prev_n) * (cum_y + prev_y) / 2) - 1 AS og FROM ac WHERE model = 'oracle')
""", VAL + """,
al AS (SELECT vl.* FROM vl JOIN scored USING (entity_id) WHERE label = 1),
ag AS (SELECT model, score, count(*) AS n, sum(y) AS sy FROM al GROUP BY ALL),
ac AS (SELECT model, score, n, sy, sum(n) OVER w / CAST(sum(n) OVER p AS DOUBLE) AS cum_n,
              sum(sy) OVER w / sum(sy) OVER p AS cum_y,
              (sum(n) OVER w - n) / CAST(sum(n) OVER p AS DOUBLE) AS prev_n,
              (sum(sy) OVER w - sy) / sum(sy) OVER p AS prev_y,
              sum(n) OVER p AS total_n, sum(sy) OVER p AS total_y, sum(n) OVER w - n AS before_n
       FROM ag WINDOW w AS (PARTITION BY model ORDER BY score DESC), p AS (PARTITION BY model))
"""))
def m22(spark, sf):
    return rounded(m.active_subset_metrics(score_frame(spark, sf), SCORES, "value",
                                           F.col("label") == 1), 6)


@query("w4_equal_frequency_bins", with_views("""
SELECT bin, count(*) AS n, round(min(amount), 2) AS lowest, round(max(amount), 2) AS highest
FROM (SELECT amount, greatest(1, CAST(ceil(7 * (r - 1) / CAST(cn - 1 AS DOUBLE)) AS BIGINT)) AS bin
      FROM (SELECT amount, row_number() OVER (ORDER BY amount, entity_id) AS r,
                   count(*) OVER () AS cn FROM scored)) GROUP BY bin"""))
def w4(spark, sf):
    r = rk.row_ranks(score_frame(spark, sf).select("entity_id", "amount"), "amount", "entity_id",
                     [], "r", descending=False)
    return r.groupBy(rk.equal_frequency_bin(F.col("r"), F.col("r_n"), 7).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("amount"), 2).alias("lowest"),
        F.round(F.max("amount"), 2).alias("highest"))


@query("w5_average_ranks", with_views("""
SELECT score_a, count(*) AS n, min(r) AS avg_rank, min(cn) AS population
FROM (SELECT score_a, rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1)
             / 2.0::DOUBLE AS r, count(*) OVER () AS cn FROM scored) GROUP BY score_a"""))
def w5(spark, sf):
    return rk.average_ranks(score_frame(spark, sf), "score_a")


@query("w6_first_ranks", with_views("""
SELECT entity_id, run_cutoff, row_number() OVER (PARTITION BY run_cutoff
       ORDER BY score_a DESC, entity_id) AS rank FROM scored"""))
def w6(spark, sf):
    r = rk.row_ranks(score_frame(spark, sf).select("entity_id", "run_cutoff", "score_a"),
                     "score_a", "entity_id", RUN)
    return r.select("entity_id", "run_cutoff", "rank")

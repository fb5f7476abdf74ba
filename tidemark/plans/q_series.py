"""KPI, forecast and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cols import rounded
from tidemark.functions.lineage import cut
from tidemark.operators import churn, forecast as fc, kpis, monitoring as mo
from tidemark.operators import timewin as tw
from tidemark.plans.q_features import CHURN_LABEL, CHURN_SQL, rnd, runs_cte
from tidemark.plans.registry import query
from tidemark.sources import adapters as ad
from tidemark.sources.oracle_views import with_views

# ------------------------------------------------------------------ G: KPIs
CH = "'organic_search', 'paid_search', 'paid_social', 'email', 'referral'"


@query("g1_channel_summary", with_views(f"""
SELECT acquisition_channel, leads, coalesce(customers, 0) AS customers,
  round(conversion_rate, 6) AS conversion_rate, round(coalesce(spend, 0), 4) AS sourcing_spend,
  round(CASE WHEN spend > 0 THEN spend / leads END, 6) AS cost_per_lead,
  round(CASE WHEN spend > 0 AND customers > 0 THEN spend / customers END, 6) AS cost_per_customer
FROM (SELECT acquisition_channel, count(*) AS leads FROM j_prospects GROUP BY 1)
LEFT JOIN (SELECT acquisition_channel, count(*) AS customers FROM j_customers GROUP BY 1)
  USING (acquisition_channel)
LEFT JOIN (SELECT p.acquisition_channel, avg(CASE WHEN customer_since < created_at +
    INTERVAL 5 DAY THEN 1.0::DOUBLE ELSE 0 END) AS conversion_rate FROM j_prospects p
    LEFT JOIN j_customers c USING (prospect_id)
    WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 5 DAY GROUP BY 1)
  USING (acquisition_channel)
LEFT JOIN (SELECT p.acquisition_channel, sum(cost) AS spend FROM j_touches t JOIN j_prospects p
    ON p.prospect_id = t.prospect_id AND p.campaign_id = t.campaign_id
    AND p.created_at = t.touch_at GROUP BY 1) USING (acquisition_channel)"""))
def g1(spark, sf):
    t = kpis.channel_summary(ad.journey(spark, sf), 5, ad.JOURNEY_END, ad.CHANNELS)
    return rnd(t, {"conversion_rate": 6, "sourcing_spend": 4, "cost_per_lead": 6,
                   "cost_per_customer": 6})


def _m(c):
    return f"strftime({c}, '%Y-%m')"


MONTHLY = f"""
mk AS (SELECT month, CAST(sum(a) AS BIGINT) AS new_leads, CAST(sum(b) AS BIGINT) AS new_customers,
    CAST(sum(c) AS BIGINT) AS orders, CAST(sum(d) AS BIGINT) AS ordering_customers,
    sum(e) AS net_revenue, sum(f) AS membership_revenue, sum(g) AS marketing_cost
  FROM (SELECT {_m('created_at')} AS month, 1 AS a, 0 AS b, 0 AS c, 0 AS d, 0.0::DOUBLE AS e,
          0.0::DOUBLE AS f, 0.0::DOUBLE AS g FROM g_prospects
    UNION ALL SELECT {_m('customer_since')}, 0, 1, 0, 0, 0, 0, 0 FROM g_customers
    UNION ALL SELECT {_m('order_ts')}, 0, 0, count(*), count(DISTINCT customer_id),
      sum(net_amount), 0, 0 FROM g_orders GROUP BY 1
    UNION ALL SELECT {_m('event_ts')}, 0, 0, 0, 0, 0, amount, 0 FROM g_subs
    UNION ALL SELECT {_m('touch_at')}, 0, 0, 0, 0, 0, 0, cost FROM g_touches) GROUP BY 1)
"""


@query("g2_monthly_kpis", with_views("""
SELECT month, new_leads, new_customers, orders, ordering_customers,
  round(net_revenue, 3) AS net_revenue, round(membership_revenue, 3) AS membership_revenue,
  round(marketing_cost, 4) AS marketing_cost FROM mk""", MONTHLY))
def g2(spark, sf):
    return rnd(kpis.monthly_kpis(ad.ledger(spark, sf)),
               {"net_revenue": 3, "membership_revenue": 3, "marketing_cost": 4})


HEAD = {
    "leads": "SELECT count(*) FROM g_prospects", "customers": "SELECT count(*) FROM g_customers",
    "lead_conversion_rate": "SELECT avg(CASE WHEN customer_since < created_at + INTERVAL 60 DAY "
    "THEN 1.0::DOUBLE ELSE 0 END) FROM g_prospects JOIN g_customers USING (prospect_id) WHERE "
    "created_at < TIMESTAMP '2001-08-02' - INTERVAL 60 DAY",
    "orders": "SELECT count(*) FROM g_orders",
    "net_revenue": "SELECT sum(net_amount) FROM g_orders",
    "average_order_value": "SELECT avg(net_amount) FROM g_orders",
    "discounted_order_share": "SELECT avg((campaign_id IS NOT NULL)::INT) FROM g_orders",
    "store_order_share": "SELECT avg((order_channel = 'store')::INT) FROM g_orders",
    "orders_before_cutoff": "SELECT count(*) FROM g_orders WHERE order_ts < "
                            "TIMESTAMP '2000-07-01'",
    "orders_on_or_after_cutoff": "SELECT count(*) FROM g_orders WHERE order_ts >= "
                                 "TIMESTAMP '2000-07-01'",
    "repeat_purchase_rate": "SELECT avg(r) FROM (SELECT c.customer_id, max(CASE WHEN order_ts > "
    "customer_since AND order_ts < customer_since + INTERVAL 180 DAY THEN 1 ELSE 0 END) AS r FROM "
    "g_customers c JOIN g_orders USING (customer_id) WHERE customer_since < TIMESTAMP "
    "'2001-08-02' - INTERVAL 180 DAY GROUP BY 1)",
    "repeat_order_revenue_share": "SELECT sum(CASE WHEN order_ts <> customer_since THEN "
    "net_amount ELSE 0 END) / sum(net_amount) FROM g_orders JOIN g_customers USING (customer_id)",
    "members_ever": "SELECT count(DISTINCT customer_id) FROM g_subs WHERE event_type = "
                    "'subscribe'",
    "membership_revenue": "SELECT sum(amount) FROM g_subs",
    "support_contacts": "SELECT count(*) FROM g_contacts",
    "mean_csat": "SELECT avg(csat_score) FROM g_contacts",
    "marketing_cost": "SELECT sum(cost) FROM g_touches"}
HEAD_SQL = "\nUNION ALL ".join(
    f"SELECT '{k}' AS metric, round(CAST(({v}) AS DOUBLE), 2) AS value" for k, v in HEAD.items())


@query("g3_headline", with_views(HEAD_SQL))
def g3(spark, sf):
    return rounded(kpis.headline(ad.ledger(spark, sf), ad.LEDGER_END, "2000-07-01"), 2)


@query("g4_repeat_purchase_rate", with_views(
    f"SELECT 'repeat_purchase_rate' AS metric, round(({HEAD['repeat_purchase_rate']}), 6) "
    "AS value"))
def g4(spark, sf):
    t = ad.ledger(spark, sf)
    return rounded(kpis.repeat_rate(t["customers"], t["orders"], ad.LEDGER_END, 180), 6)


@query("g5_repeat_revenue_share", with_views(
    "SELECT 'repeat_order_revenue_share' AS metric, "
    f"round(({HEAD['repeat_order_revenue_share']}), 6) AS value"))
def g5(spark, sf):
    t = ad.ledger(spark, sf)
    return rounded(kpis.repeat_revenue_share(t["customers"], t["orders"]), 6)


@query("g6_window_totals", with_views("""
SELECT round(sum(net_revenue), 3) AS net_revenue, CAST(sum(orders) AS DOUBLE) AS orders,
  CAST(sum(new_customers) AS DOUBLE) AS new_customers, CAST(sum(new_leads) AS DOUBLE) AS new_leads,
  round(sum(marketing_cost), 3) AS marketing_cost, count(*) AS months,
  round(sum(net_revenue) / sum(orders), 3) AS average_order_value FROM mk
WHERE month BETWEEN '2000-01' AND '2000-06'""", MONTHLY))
def g6(spark, sf):
    m = tw.month_window(kpis.monthly_kpis(ad.ledger(spark, sf)), "2000-01", "2000-06")
    return rounded(kpis.window_totals(m), 3)


@query("g7_kpi_catalog")
def g7(spark, sf):
    t = ad.ledger(spark, sf)
    now = kpis.headline(t, ad.LEDGER_END, "2000-07-01")
    was = kpis.headline(tw.snapshot(t, "2000-07-01"), "2000-07-01", "2000-01-01")
    share = F.col("metric").endswith("_share") | F.col("metric").endswith("_rate")
    theme = F.when(F.col("metric").contains("revenue"), "revenue").when(
        F.col("metric").contains("order"), "orders").otherwise("customers")
    defs = now.select("metric", theme.alias("theme"), F.when(share, "share").otherwise("amount")
                      .alias("unit"))
    return rounded(kpis.kpi_catalog(now, was, defs), 4)


def _curve(spark, sf):
    from tidemark.operators import targeting as tg
    return tg.simulate_policies(ad.score_frame(spark, sf), {"a": "score_a", "b": "score_b"},
                                "label", "value", [0.05, 0.1, 0.2, 0.4],
                                tg.assume(tg.RETENTION, save_rate=0.2), ["run_cutoff"])


CURVE = """
cl AS (SELECT run_cutoff, label, value, 'a' AS policy, score_a AS score FROM scored UNION ALL
       SELECT run_cutoff, label, value, 'b', score_b FROM scored),
cgr AS (SELECT policy, run_cutoff, score, count(*) AS n, sum(label) AS c, sum(1 - label) AS o,
  sum(label * value) AS v FROM cl GROUP BY ALL),
crr AS (SELECT *, sum(n) OVER (PARTITION BY policy, run_cutoff ORDER BY score DESC) - n AS before_n,
  sum(n) OVER (PARTITION BY policy, run_cutoff) AS total_n FROM cgr),
crd AS (SELECT policy, depth, count(DISTINCT run_cutoff) AS runs, sum(t * c) AS c, sum(t * o) AS o,
    sum(t * v) AS v FROM (SELECT *, greatest(0.0::DOUBLE, least(depth * total_n - before_n, n)) / n
      AS t FROM crr, (SELECT unnest([0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS depth)) GROUP BY 1, 2
  UNION ALL SELECT 'random', depth, count(DISTINCT run_cutoff), depth * sum(label),
    depth * sum(1 - label), depth * sum(label * value) FROM scored,
    (SELECT unnest([0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS depth) GROUP BY depth),
curve AS (SELECT policy, depth, (0.2::DOUBLE * v - ((c + o) + 10 * (0.2::DOUBLE * c + 0.5::DOUBLE
  * o))) / runs AS net_value_per_run FROM crd)
"""


@query("g8_best_depth", with_views("""
SELECT policy, depth, round(net_value_per_run, 3) AS net_value_per_run FROM curve
WHERE policy = 'a' ORDER BY net_value_per_run DESC, depth LIMIT 1""", CURVE))
def g8(spark, sf):
    return kpis.best_depth(_curve(spark, sf), "a", "net_value_per_run").select(
        "policy", "depth", F.round("net_value_per_run", 3).alias("net_value_per_run"))


@query("f14_nearest_depth", with_views("""
SELECT policy, depth, round(net_value_per_run, 3) AS net_value_per_run FROM curve
WHERE depth = 0.1""", CURVE))
def f14(spark, sf):
    return tw.nearest_rows(_curve(spark, sf), "depth", 0.14).select(
        "policy", "depth", F.round("net_value_per_run", 3).alias("net_value_per_run"))


@query("g9_recommended_actions", with_views("""
SELECT 'targeting' AS action, policy || ' at ' || CAST(depth AS VARCHAR) AS label,
  round(net_value_per_run, 3) AS value FROM (SELECT * FROM curve
  ORDER BY net_value_per_run DESC LIMIT 1)
UNION ALL SELECT 'lifecycle', month, round(net_revenue, 3) FROM (SELECT * FROM mk
  ORDER BY net_revenue DESC LIMIT 1)""", CURVE + "," + MONTHLY))
def g9(spark, sf):
    m = kpis.monthly_kpis(ad.ledger(spark, sf)).select(
        F.col("month").alias("decision_point"), F.col("net_revenue")
        .alias("revenue_gap_per_year"))
    return rounded(kpis.recommended_actions(_curve(spark, sf), m), 3)


@query("g11_distinct_counts", with_views("""
SELECT order_channel, count(DISTINCT customer_id) AS customers FROM g_orders GROUP BY 1"""))
def g11(spark, sf):
    return ad.ledger(spark, sf)["orders"].groupBy("order_channel").agg(
        F.countDistinct("customer_id").alias("customers"))


@query("g12_conditional_aggregates", with_views("""
SELECT order_channel, count(*) FILTER (net_amount > 250000) AS large_orders,
  round(avg((campaign_id IS NOT NULL)::INT), 6) AS discounted_share FROM g_orders GROUP BY 1"""))
def g12(spark, sf):
    return ad.ledger(spark, sf)["orders"].groupBy("order_channel").agg(
        F.count_if(F.col("net_amount") > 250000).alias("large_orders"),
        F.round(F.avg(F.col("campaign_id").isNotNull().cast("int")), 6).alias("discounted_share"))


# ------------------------------------------------------------------ T: forecasting
KEY = ["segment"]
PLAN = fc.BacktestPlan("1999-01-04", "1999-06-28", "1999-10-04", "2001-04-30")


def series(spark, sf):
    t = ad.ledger(spark, sf)
    o = t["orders"].join(t["customers"].select("customer_id", F.col("acquisition_channel")
                                               .alias("segment")), "customer_id")
    return fc.daily_revenue(o, ad.LEDGER_START, ad.LEDGER_END, KEY)


SERIES = f"""
sday AS (SELECT segment, CAST(day AS DATE) AS day, coalesce(net_revenue, 0) AS net_revenue
  FROM (SELECT DISTINCT acquisition_channel AS segment FROM g_customers)
  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{ad.LEDGER_START}',
       TIMESTAMP '{ad.LEDGER_END}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day)
  LEFT JOIN (SELECT acquisition_channel AS segment, order_ts AS day, sum(net_amount) AS net_revenue
     FROM g_orders JOIN g_customers USING (customer_id) GROUP BY 1, 2) USING (segment, day)),
swk AS (SELECT segment, CAST(date_trunc('week', day) AS DATE) AS week_start,
    sum(net_revenue) AS net_revenue, count(*) AS days FROM sday GROUP BY 1, 2 HAVING count(*) = 7),
slv AS (SELECT segment, day, avg(net_revenue) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)
    AS level, CASE WHEN row_number() OVER w > 392 THEN avg(net_revenue) OVER (w ROWS BETWEEN 392
    PRECEDING AND 365 PRECEDING) END AS level_ly FROM sday
    WINDOW w AS (PARTITION BY segment ORDER BY day)),
sgr AS (SELECT segment, day AS origin, level, level_ly, k AS horizon_week,
    CAST(day + 7 * (k - 1) AS DATE) AS week_start FROM slv,
    (SELECT unnest(generate_series(1, 13))::INT AS k)
    WHERE dayofweek(day) = 1 AND day BETWEEN DATE '{PLAN.first_origin}'
      AND DATE '{PLAN.last_origin}'),
bt AS (SELECT g.segment, origin, CASE WHEN origin <= DATE '{PLAN.design_last_origin}' THEN 'design'
      WHEN origin >= DATE '{PLAN.first_evaluation_origin}' THEN 'evaluation' ELSE 'calibration' END
      AS role, horizon_week, g.week_start, a.net_revenue AS actual, model,
      CASE WHEN model = 'naive_4wk' THEN level * 7 ELSE b.net_revenue * level / level_ly END
        AS forecast
  FROM sgr g JOIN swk a ON a.segment = g.segment AND a.week_start = g.week_start
  LEFT JOIN swk b ON b.segment = g.segment AND b.week_start = g.week_start - 364,
  (SELECT unnest(['naive_4wk', 'seasonal_naive_yoy']) AS model))
"""


def backtest(spark, sf):
    return fc.baseline_backtest(series(spark, sf), PLAN, KEY)


@query("t1_daily_revenue", with_views(
    "SELECT segment, day, round(net_revenue, 4) AS net_revenue FROM sday", SERIES))
def t1(spark, sf):
    return rounded(series(spark, sf), 4)


@query("t2_weekly_revenue", with_views(
    "SELECT segment, week_start, round(net_revenue, 4) AS net_revenue, days FROM swk", SERIES))
def t2(spark, sf):
    return rounded(fc.weekly_revenue(series(spark, sf), KEY), 4)


@query("t3_path_to_weeks", with_views("""
SELECT segment, CAST((day - DATE '1999-01-04') // 7 AS BIGINT) AS week, round(sum(net_revenue), 4)
  AS total FROM sday WHERE day >= DATE '1999-01-04' AND day < DATE '1999-04-05'
GROUP BY 1, 2""", SERIES))
def t3(spark, sf):
    d = series(spark, sf).where((F.col("day") >= "1999-01-04") & (F.col("day") < "1999-04-05"))
    h = F.datediff("day", F.lit("1999-01-04").cast("date"))
    return d.groupBy("segment", F.floor(h / 7).cast("bigint").alias("week")).agg(
        F.round(F.sum("net_revenue"), 4).alias("total"))


PROMO = """
pd AS (SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE)
       AS day FROM g_campaigns WHERE objective = 'promotion')
"""


@query("t4_promo_calendar", with_views("""
SELECT date_trunc('month', day)::DATE AS month, count(*) AS days, count(*) FILTER (promotion)
  AS promo_days, round(sum(net_revenue), 3) AS net_revenue
FROM (SELECT day, sum(net_revenue) AS net_revenue, day IN (SELECT day FROM pd) AS promotion
      FROM sday GROUP BY day) GROUP BY 1""", SERIES + "," + PROMO))
def t4(spark, sf):
    promos = fc.planned_promotions(ad.ledger(spark, sf)["campaigns"])
    cal = fc.promo_calendar(promos, ad.LEDGER_START, ad.LEDGER_END)
    d = series(spark, sf).groupBy("day").agg(F.sum("net_revenue").alias("net_revenue"))
    return d.join(cal, "day").groupBy(F.trunc("day", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.count_if("promotion").alias("promo_days"),
        F.round(F.sum("net_revenue"), 3).alias("net_revenue"))


@query("t5_repeat_promotions", with_views("""
SELECT campaign_id, campaign_name, start_date, end_date, false AS assumed FROM g_campaigns
WHERE objective = 'promotion'
UNION ALL SELECT NULL, regexp_replace(campaign_name, '\\d{4}$', '(assumed repeat)'),
  start_date + INTERVAL 364 DAY, end_date + INTERVAL 364 DAY, true FROM g_campaigns
WHERE objective = 'promotion' AND start_date + INTERVAL 364 DAY > (SELECT max(end_date)
  FROM g_campaigns WHERE objective = 'promotion') AND start_date + INTERVAL 364 DAY <
  TIMESTAMP '2002-01-01'"""))
def t5(spark, sf):
    return fc.repeat_promotions(fc.planned_promotions(ad.ledger(spark, sf)["campaigns"]),
                                "2002-01-01")


@query("t6_history_contract", with_views("""
SELECT segment, min(day) AS lo, max(day) AS hi, count(*) AS n FROM sday GROUP BY 1
HAVING max(day) <> DATE '2001-07-31'""", SERIES))
def t6(spark, sf):
    return fc.history_issues(series(spark, sf), "2001-08-01", KEY)


BT = ("SELECT segment, origin, role, horizon_week, week_start, model, round(actual, 3) AS actual, "
      "round(forecast, 3) AS forecast FROM bt")


@query("t7_naive_forecast", with_views(BT.replace("round(forecast, 3)", "round(forecast, 5)")
                                       + " WHERE model = 'naive_4wk'", SERIES))
def t7(spark, sf):
    return rnd(backtest(spark, sf).where("model = 'naive_4wk'"), {"actual": 3, "forecast": 5})


@query("t8_seasonal_naive", with_views(BT + " WHERE model = 'seasonal_naive_yoy'", SERIES))
def t8(spark, sf):
    return rounded(backtest(spark, sf).where("model = 'seasonal_naive_yoy'"), 3)


@query("t11_rolling_backtest", with_views("""
SELECT role, model, count(*) AS rows, count(DISTINCT origin) AS origins, round(avg(forecast), 2)
  AS mean_forecast, round(avg(actual), 2) AS mean_actual FROM bt GROUP BY 1, 2""", SERIES))
def t11(spark, sf):
    return rounded(backtest(spark, sf).groupBy("role", "model").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("origin").alias("origins"),
        F.avg("forecast").alias("mean_forecast"), F.avg("actual").alias("mean_actual")), 2)


@query("t12_horizon_totals", with_views("""
SELECT segment, origin, role, model, round(sum(actual), 4) AS actual, round(sum(forecast), 5)
  AS forecast, round(sum(forecast) / sum(actual) - 1, 6) AS pct_error FROM bt
GROUP BY ALL""", SERIES))
def t12(spark, sf):
    return rnd(fc.horizon_totals(backtest(spark, sf), KEY), {"actual": 4, "forecast": 5,
                                                             "pct_error": 6})


MET = """
mt AS (SELECT model, CASE WHEN horizon_week <= 4 THEN 'weeks 1-4' WHEN horizon_week <= 8
    THEN 'weeks 5-8' ELSE 'weeks 9-13' END AS bucket, count(*) AS n,
    avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) * (forecast - actual)))
    AS rmse, sum(abs(forecast - actual)) / sum(abs(actual)) AS wape,
    avg(CASE WHEN abs(actual) + abs(forecast) > 0 THEN 2 * abs(forecast - actual) /
      (abs(actual) + abs(forecast)) ELSE 0 END) AS smape,
    sum(forecast) / sum(actual) - 1 AS bias
  FROM bt WHERE forecast IS NOT NULL AND role = 'evaluation' GROUP BY 1, 2)
"""


def metric_table(spark, sf):
    b = backtest(spark, sf).where("role = 'evaluation'").withColumn(
        "bucket", fc.bucket_label(F.col("horizon_week")))
    return fc.point_metrics(b, ["model", "bucket"])


@query("t13_point_metrics", with_views("""
SELECT model, bucket, n, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(wape, 6) AS wape,
  round(smape, 6) AS smape, round(bias, 6) AS bias FROM mt""", SERIES + "," + MET))
def t13(spark, sf):
    return rnd(metric_table(spark, sf), {"mae": 2, "rmse": 2, "wape": 6, "smape": 6, "bias": 6})


@query("t14_skill", with_views("""
SELECT m.model, m.bucket, round(1 - m.mae / b.mae, 6) AS skill_vs_naive FROM mt m JOIN mt b
ON b.bucket = m.bucket AND b.model = 'naive_4wk'""", SERIES + "," + MET))
def t14(spark, sf):
    t = fc.with_skill(metric_table(spark, sf), ["bucket"])
    return rounded(t.select("model", "bucket", "skill_vs_naive"), 6)


IV = """
ir AS (SELECT *, week_start + 7 AS observed_at, actual / forecast AS ratio FROM bt
  WHERE model = 'naive_4wk'),
ij AS (SELECT q.segment, q.horizon_week, q.origin, q.forecast, q.actual, q.role, p.ratio,
    p.observed_at, row_number() OVER (PARTITION BY q.segment, q.horizon_week, q.origin
      ORDER BY p.origin DESC) AS r
  FROM ir q LEFT JOIN ir p ON p.segment = q.segment AND p.horizon_week = q.horizon_week
    AND p.observed_at <= q.origin),
iv AS (SELECT segment, horizon_week, origin, forecast, actual, role,
    count(ratio) AS calibration_n, max(observed_at)::DATE AS calibration_last_observed,
    CASE WHEN count(ratio) >= 12 THEN forecast * quantile_cont(ratio, 0.25) END AS lower_50,
    CASE WHEN count(ratio) >= 12 THEN forecast * quantile_cont(ratio, 0.75) END AS upper_50,
    CASE WHEN count(ratio) >= 12 THEN forecast * quantile_cont(ratio, 0.1) END AS lower_80,
    CASE WHEN count(ratio) >= 12 THEN forecast * quantile_cont(ratio, 0.9) END AS upper_80
  FROM ij WHERE r <= 26 GROUP BY 1, 2, 3, 4, 5, 6)
"""


def intervals(spark, sf):
    rows = fc.weekly_pool(backtest(spark, sf).where("model = 'naive_4wk'"))
    return rows, fc.empirical_intervals(rows, rows, [*KEY, "horizon_week"], PLAN)


IV_ROUND = {"forecast": 5, **{c: 2 for c in ("lower_50", "upper_50", "lower_80", "upper_80")}}


@query("t15_empirical_intervals", with_views("""
SELECT segment, horizon_week, origin, calibration_n, calibration_last_observed,
  round(forecast, 5) AS forecast, round(lower_50, 2) AS lower_50, round(upper_50, 2) AS upper_50,
  round(lower_80, 2) AS lower_80, round(upper_80, 2) AS upper_80 FROM iv""", SERIES + "," + IV))
def t15(spark, sf):
    return rnd(intervals(spark, sf)[1], IV_ROUND)


LIVE = "2001-07-30"


def live(spark, sf):
    """Naive forecast issued on the Monday after the last complete week."""
    lv = fc.levels(series(spark, sf), KEY).where(F.col("day") == F.lit(LIVE).cast("date"))
    k = F.explode(F.sequence(F.lit(1), F.lit(PLAN.horizon_weeks)))
    return lv.select("segment", F.col("day").alias("origin"), k.alias("horizon_week"),
                     (F.col("level") * 7).alias("forecast"))


FWD = IV + f""",
fq AS (SELECT segment, k AS horizon_week, day AS origin, level * 7 AS forecast FROM slv,
  (SELECT unnest(generate_series(1, 13))::INT AS k) WHERE day = DATE '{LIVE}'),
fj AS (SELECT q.*, p.ratio, row_number() OVER (PARTITION BY q.segment, q.horizon_week
    ORDER BY p.origin DESC) AS r FROM fq q LEFT JOIN ir p ON p.segment = q.segment
    AND p.horizon_week = q.horizon_week AND p.observed_at <= q.origin),
fv AS (SELECT segment, horizon_week, origin, forecast, count(ratio) AS calibration_n,
    forecast * quantile_cont(ratio, 0.1) AS lower_80, forecast * quantile_cont(ratio, 0.9)
    AS upper_80 FROM fj WHERE r <= 26 GROUP BY 1, 2, 3, 4)
"""


@query("t16_forward_intervals", with_views("""
SELECT segment, horizon_week, origin, round(forecast, 5) AS forecast, calibration_n,
  round(lower_80, 2) AS lower_80, round(upper_80, 2) AS upper_80 FROM fv""", SERIES + "," + FWD))
def t16(spark, sf):
    rows, _ = intervals(spark, sf)
    f = fc.empirical_intervals(live(spark, sf), rows, [*KEY, "horizon_week"], PLAN)
    return rnd(f.select("segment", "horizon_week", "origin", "forecast", "calibration_n",
                        "lower_80", "upper_80"), IV_ROUND)


@query("t17_coverage", with_views("""
SELECT segment, level, count(*) AS n, round(avg((actual >= lo AND actual <= hi)::INT), 6)
  AS coverage, round(avg((actual < lo)::INT), 6) AS below, round(avg((actual > hi)::INT), 6)
  AS above, round(avg((hi - lo) / forecast), 6) AS mean_relative_width
FROM (SELECT *, 0.5::DOUBLE AS level, lower_50 AS lo, upper_50 AS hi FROM iv UNION ALL
      SELECT *, 0.8, lower_80, upper_80 FROM iv) WHERE lo IS NOT NULL AND role = 'evaluation'
GROUP BY 1, 2""", SERIES + "," + IV))
def t17(spark, sf):
    rows, iv = intervals(spark, sf)
    j = iv.join(rows.select(*KEY, "horizon_week", "origin", "actual", "role"),
                [*KEY, "horizon_week", "origin"]).where("role = 'evaluation'")
    return rounded(fc.coverage(j, PLAN.levels, KEY), 6)


DM_TERMS = " + ".join(
    f"CASE WHEN horizon_week > {i} THEN 2 * (1 - {i}.0::DOUBLE / horizon_week) * "
    f"coalesce(dc * lag(dc, {i}) OVER w, 0) ELSE 0 END" for i in range(1, 13))
DM = f"""
de AS (SELECT segment, horizon_week, origin,
    sum(abs(forecast - actual)) FILTER (model = 'seasonal_naive_yoy') -
    sum(abs(forecast - actual)) FILTER (model = 'naive_4wk') AS d FROM bt
  WHERE role = 'evaluation' GROUP BY 1, 2, 3),
dd AS (SELECT *, d - avg(d) OVER (PARTITION BY segment, horizon_week) AS dc FROM de
  WHERE d IS NOT NULL),
dc AS (SELECT *, dc * dc + {DM_TERMS} AS c FROM dd
  WINDOW w AS (PARTITION BY segment, horizon_week ORDER BY origin))
"""


@query("t18_diebold_mariano", with_views("""
SELECT segment, horizon_week, n, round(m, 2) AS mean_loss_diff, round(CASE WHEN s > 0 THEN
  m / sqrt(s / n / n) * sqrt(greatest((n + 1 - 2 * horizon_week + horizon_week *
  (horizon_week - 1) / CAST(n AS DOUBLE)) / n, 0)) END, 5) AS dm_stat
FROM (SELECT segment, horizon_week, count(*) AS n, avg(d) AS m, sum(c) AS s FROM dc
      GROUP BY 1, 2)""", SERIES + "," + DM))
def t18(spark, sf):
    b = backtest(spark, sf).where("role = 'evaluation'")
    return rnd(fc.diebold_mariano(b, "seasonal_naive_yoy", "naive_4wk", KEY),
               {"mean_loss_diff": 2, "dm_stat": 5})


@query("t18_diebold_mariano_p")
def t18p(spark, sf):
    from tidemark.functions.numeric import p_student
    b = backtest(spark, sf).where("role = 'evaluation'")
    d = fc.diebold_mariano(b, "seasonal_naive_yoy", "naive_4wk", KEY)
    return rounded(d.withColumn("p_value", p_student("dm_stat", (F.col("n") - 1)
                                                     .cast("double"))), 5)


H_PLAN = PLAN


@query("t9_harmonic_backtest")
def t9(spark, sf):
    promos = fc.planned_promotions(ad.ledger(spark, sf)["campaigns"])
    cal = fc.promo_calendar(promos, ad.LEDGER_START, ad.LEDGER_END)
    return rounded(fc.harmonic_backtest(series(spark, sf), cal, H_PLAN, KEY, ad.LEDGER_START), 2)


@query("t10_harmonic_accuracy")
def t10(spark, sf):
    promos = fc.planned_promotions(ad.ledger(spark, sf)["campaigns"])
    cal = fc.promo_calendar(promos, ad.LEDGER_START, ad.LEDGER_END)
    d = series(spark, sf)
    h = fc.harmonic_backtest(d, cal, H_PLAN, KEY, ad.LEDGER_START)
    b = fc.baseline_backtest(d, H_PLAN, KEY).unionByName(h)
    return rounded(fc.with_skill(fc.point_metrics(b, ["model"]), []), 5)


@query("t19_forecast_leakage_audit", with_views("""
SELECT unnest(['forecasts_identical_when_rebuilt_from_orders_before_origin',
  'history_on_or_after_origin_is_refused', 'interval_errors_observed_before_origin'])
  AS check_name, 0::BIGINT AS violations"""))
def t19(spark, sf):
    t = ad.ledger(spark, sf)
    o = t["orders"].join(t["customers"].select("customer_id", F.col("acquisition_channel")
                                               .alias("segment")), "customer_id")
    return fc.leakage_audit(o, backtest(spark, sf), PLAN, KEY, ad.LEDGER_START, "2000-07-03",
                            intervals(spark, sf)[1])


@query("t20_series_summary", with_views("""
SELECT segment, first_day, last_day, days, round(total, 2) AS total_revenue, complete_weeks,
  round(l13, 2) AS last_13_weeks, round(p13, 2) AS same_13_weeks_prior_year
FROM (SELECT segment, min(day) AS first_day, max(day) AS last_day, count(*) AS days,
        sum(net_revenue) AS total FROM sday GROUP BY 1)
JOIN (SELECT segment, count(*) AS complete_weeks,
        sum(net_revenue) FILTER (week_start > mx - 91) AS l13,
        sum(net_revenue) FILTER (week_start < mx - 357 AND week_start >= mx - 448) AS p13
      FROM (SELECT *, max(week_start) OVER (PARTITION BY segment) AS mx FROM swk) GROUP BY 1)
USING (segment)""", SERIES))
def t20(spark, sf):
    return rounded(fc.series_summary(series(spark, sf), KEY), 2)


@query("t20_weekday_means", with_views("""
SELECT segment, CAST(isodow(day) - 1 AS INT) AS weekday, round(avg(net_revenue), 2) AS mean_revenue
FROM sday WHERE day >= DATE '2001-08-01' - 363 GROUP BY 1, 2""", SERIES))
def t20w(spark, sf):
    return rounded(fc.weekday_means(series(spark, sf), KEY), 2)


@query("t20_live_forecast", with_views("""
SELECT fv.segment, horizon_week, round(forecast, 2) AS naive_4wk, round(lower_80, 2) AS lower_80,
  round(upper_80, 2) AS upper_80, round(net_revenue, 3) AS same_week_last_year
FROM fv LEFT JOIN swk ON swk.segment = fv.segment
  AND swk.week_start = origin + 7 * (horizon_week - 1) - 364""", SERIES + "," + FWD))
def t20l(spark, sf):
    rows, _ = intervals(spark, sf)
    f = fc.empirical_intervals(live(spark, sf), rows, [*KEY, "horizon_week"], PLAN)
    f = f.withColumn("week_start", F.date_add("origin", 7 * (F.col("horizon_week") - 1)
                                              - fc.YEAR_DAYS))
    j = f.join(fc.weekly_revenue(series(spark, sf), KEY), ["segment", "week_start"], "left")
    return rnd(j.select("segment", "horizon_week", F.col("forecast").alias("naive_4wk"),
                        "lower_80", "upper_80", F.col("net_revenue")
                        .alias("same_week_last_year")),
               {"naive_4wk": 2, "lower_80": 2, "upper_80": 2, "same_week_last_year": 3})


# Fixed value: the model whose intervals and totals are published.
CHAMPION = "harmonic"


def all_models(spark, sf):
    """Backtest of the four models, written once: the pools and the totals read it."""
    promos = fc.planned_promotions(ad.ledger(spark, sf)["campaigns"])
    cal = fc.promo_calendar(promos, ad.LEDGER_START, ad.LEDGER_END)
    d = series(spark, sf)
    return cut(fc.baseline_backtest(d, PLAN, KEY).unionByName(
        fc.harmonic_backtest(d, cal, PLAN, KEY, ad.LEDGER_START)))


def live_outputs(spark, sf):
    """The live issue of all models, with assumed promotions, and the champion's intervals."""
    d, until = series(spark, sf), "2001-10-29"
    promos = fc.repeat_promotions(fc.planned_promotions(ad.ledger(spark, sf)["campaigns"]), until)
    cal = fc.promo_calendar(promos, ad.LEDGER_START, until)
    issued = cut(fc.issue(d, cal, LIVE, PLAN, KEY, ad.LEDGER_START))
    return fc.issued_with_intervals(issued, all_models(spark, sf), CHAMPION, PLAN, KEY, d)


BOUNDS = {c: 2 for c in ("lower_50", "upper_50", "lower_80", "upper_80")}


@query("t20_live_forecast_all_models")
def t20_all(spark, sf):
    return rounded(live_outputs(spark, sf)[0], 2)


@query("t16_live_total_intervals")
def t16_total(spark, sf):
    return rounded(live_outputs(spark, sf)[1], 2)


@query("t15_champion_intervals")
def t15_champion(spark, sf):
    rows = fc.weekly_pool(all_models(spark, sf).where(F.col("model") == CHAMPION))
    return rounded(fc.empirical_intervals(rows, rows, [*KEY, "horizon_week"], PLAN), 2)


def total_intervals(totals):
    pool = fc.total_pool(totals, PLAN)
    return fc.empirical_intervals(pool, pool, [*KEY, "model"], PLAN)


@query("t15_champion_total_intervals")
def t15_champion_total(spark, sf):
    mine = all_models(spark, sf).where(F.col("model") == CHAMPION)
    return rounded(total_intervals(cut(fc.horizon_totals(mine, KEY))), 2)


@query("t15_total_intervals", with_views("""
SELECT segment, model, origin, round(forecast, 0) AS forecast, calibration_n, calibration_last_observed,
  round(lower_50, 2) AS lower_50, round(upper_50, 2) AS upper_50, round(lower_80, 2) AS lower_80,
  round(upper_80, 2) AS upper_80 FROM (
  SELECT q.segment, q.model, q.origin, q.forecast, count(p.ratio) AS calibration_n,
    max(p.observed_at)::DATE AS calibration_last_observed,
    CASE WHEN count(p.ratio) >= 12 THEN q.forecast * quantile_cont(p.ratio, 0.25) END AS lower_50,
    CASE WHEN count(p.ratio) >= 12 THEN q.forecast * quantile_cont(p.ratio, 0.75) END AS upper_50,
    CASE WHEN count(p.ratio) >= 12 THEN q.forecast * quantile_cont(p.ratio, 0.1) END AS lower_80,
    CASE WHEN count(p.ratio) >= 12 THEN q.forecast * quantile_cont(p.ratio, 0.9) END AS upper_80
  FROM tq q LEFT JOIN (SELECT a.*, b.origin AS asked, row_number() OVER (PARTITION BY a.segment, a.model, b.origin
      ORDER BY a.origin DESC) AS r FROM tq a JOIN tq b ON a.segment = b.segment AND a.model = b.model
      AND a.observed_at <= b.origin) p
    ON p.segment = q.segment AND p.model = q.model AND p.asked = q.origin AND p.r <= 26
  GROUP BY 1, 2, 3, 4)""", SERIES + """,
tq AS (SELECT segment, origin, model, sum(forecast) AS forecast, sum(actual) / sum(forecast) AS ratio,
    origin + 91 AS observed_at FROM bt GROUP BY 1, 2, 3 HAVING sum(forecast) IS NOT NULL)"""))
def t15_total(spark, sf):
    totals = cut(fc.horizon_totals(backtest(spark, sf), KEY))
    return rnd(total_intervals(totals), {"forecast": 0, **BOUNDS})


@query("g10_history_and_forecast", with_views("""
SELECT segment, week_start, round(net_revenue, 3) AS value, 'actual' AS kind FROM swk
QUALIFY row_number() OVER (PARTITION BY segment ORDER BY week_start DESC) <= 8
UNION ALL SELECT segment, CAST(origin + 7 * (horizon_week - 1) AS DATE), round(forecast, 3),
  'forecast' FROM fv""", SERIES + "," + FWD))
def g10(spark, sf):
    h = kpis.history_tail(fc.weekly_revenue(series(spark, sf), KEY), 8, KEY).select(
        "segment", "week_start", F.col("net_revenue").alias("value"), F.lit("actual").alias("kind"))
    f = live(spark, sf).select(
        "segment", F.date_add("origin", 7 * (F.col("horizon_week") - 1)).alias("week_start"),
        F.col("forecast").alias("value"), F.lit("forecast").alias("kind"))
    return rounded(h.unionByName(f), 3)


# ------------------------------------------------------------------ N: monitoring
REF_RUN, CUR_RUNS = ["2000-01-01"], ["2000-07-01", "2000-10-01"]
NUM = ["days_since_last_order", "orders_total", "browse_sessions_90d", "tenure_days"]
LEVELS = {"acquisition_channel": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
          "device_type": ["desktop", "mobile", "tablet"]}


def _scored(df):
    return df.withColumn("p", F.col("days_since_last_order")
                         / (60 + F.col("days_since_last_order")))


def churn_runs(spark, sf, runs):
    from tidemark.functions.lineage import cut
    return cut(_scored(churn.build_dataset(ad.ledger(spark, sf), runs)))


def reference_and_current(spark, sf):
    """Both populations from one dataset job."""
    from tidemark.functions.cols import ts
    both = churn_runs(spark, sf, REF_RUN + CUR_RUNS)
    first = F.col("run_cutoff") == ts(REF_RUN[0])
    return both.where(first), both.where(~first)


MON = CHURN_SQL + ",\nnl AS (" + "\nUNION ALL ".join(
    f"SELECT run_cutoff, '{f}' AS feature, {f}::DOUBLE AS v FROM cf" for f in NUM) + """
  UNION ALL SELECT run_cutoff, 'p', days_since_last_order / (60 + days_since_last_order) FROM cf),
nr AS (SELECT * FROM nl WHERE run_cutoff = TIMESTAMP '2000-01-01'),
nc AS (SELECT * FROM nl WHERE run_cutoff IN (TIMESTAMP '2000-07-01', TIMESTAMP '2000-10-01')),
ne AS (SELECT feature, unnest(quantile_disc(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))
       AS e FROM nr GROUP BY 1),
nd AS (SELECT DISTINCT feature, e FROM ne),
nb AS (SELECT feature, count(*) AS bins FROM nd GROUP BY 1),
rs AS (SELECT feature, bin, count(*) AS n FROM (SELECT feature, (SELECT count(*) FROM nd
    WHERE nd.feature = nr.feature AND e < v) AS bin FROM nr) GROUP BY 1, 2),
cs AS (SELECT feature, bin, count(*) AS n FROM (SELECT feature, (SELECT count(*) FROM nd
    WHERE nd.feature = nc.feature AND e < v) AS bin FROM nc) GROUP BY 1, 2),
ng AS (SELECT feature, unnest(generate_series(0, bins)) AS bin FROM nb),
sh AS (SELECT feature, bin, coalesce(rs.n, 0) / CAST((SELECT count(*) FROM nr x WHERE x.feature
      = ng.feature) AS DOUBLE) AS r, coalesce(cs.n, 0) / CAST((SELECT count(*) FROM nc x WHERE
      x.feature = ng.feature) AS DOUBLE) AS c
    FROM ng LEFT JOIN rs USING (feature, bin) LEFT JOIN cs USING (feature, bin)),
np AS (SELECT feature, sum((greatest(c, 1e-4) - greatest(r, 1e-4)) * ln(greatest(c, 1e-4) /
      greatest(r, 1e-4))) AS psi FROM sh GROUP BY 1),
nm AS (SELECT feature, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM nr GROUP BY 1)
"""


def _edges(spark, sf):
    ref = churn_runs(spark, sf, REF_RUN)
    return ref, mo.quantile_edges(mo.by_value(ref, [*NUM, "p"]))


@query("n1_quantile_edges", with_views(
    "SELECT feature, round(e, 6) AS edge FROM nd", MON))
def n1(spark, sf):
    e = _edges(spark, sf)[1].select("feature", F.explode("edges").alias("edge"))
    return rounded(e, 6)


@query("n2_bin_shares", with_views(
    "SELECT feature, CAST(bin AS INT) AS bin, round(c, 6) AS share FROM sh", MON))
def n2(spark, sf):
    ref, cur = reference_and_current(spark, sf)
    e = mo.quantile_edges(mo.by_value(ref, [*NUM, "p"]))
    return rounded(mo.bin_shares(cur, [*NUM, "p"], e), 6)


LV = "\nUNION ALL ".join(f"SELECT '{f}' AS feature, '{v}' AS level" for f, vs in LEVELS.items()
                         for v in vs)
LEVEL_SQL = f"""
lv AS ({LV}),
ll AS (""" + "\nUNION ALL ".join(f"SELECT run_cutoff, '{f}' AS feature, {f} AS level FROM cf"
                                 for f in LEVELS) + """),
lr AS (SELECT feature, level, (SELECT count(*) FROM ll WHERE ll.feature = lv.feature AND
    ll.level = lv.level AND run_cutoff = TIMESTAMP '2000-01-01') / CAST((SELECT count(*) FROM cf
    WHERE run_cutoff = TIMESTAMP '2000-01-01') AS DOUBLE) AS r,
    (SELECT count(*) FROM ll WHERE ll.feature = lv.feature AND ll.level = lv.level AND run_cutoff
     >= TIMESTAMP '2000-07-01') / CAST((SELECT count(*) FROM cf WHERE run_cutoff >=
     TIMESTAMP '2000-07-01') AS DOUBLE) AS c FROM lv)
"""


@query("n3_level_shares", with_views("SELECT feature, level, round(r, 6) AS share FROM lr",
                                     CHURN_SQL + "," + LEVEL_SQL))
def n3(spark, sf):
    return rounded(mo.level_shares(churn_runs(spark, sf, REF_RUN), LEVELS), 6)


@query("n4_psi", with_views("SELECT feature, round(psi, 6) AS psi FROM np", MON))
def n4(spark, sf):
    ref, cur = reference_and_current(spark, sf)
    d = mo.numeric_drift(mo.numeric_profile(ref, [*NUM, "p"]), cur, [*NUM, "p"])
    return rounded(d.select("feature", "psi"), 6)


@query("n5_reference_quantiles", with_views("""
SELECT j, round(quantile_cont(v, j / 1000.0::DOUBLE), 6) AS value
FROM nr, (SELECT unnest(generate_series(0, 1000))::BIGINT AS j) WHERE feature = 'p' GROUP BY j
""".replace("quantile_cont(v, j / 1000.0::DOUBLE)",
            "(list_sort(list(v))[CAST(floor(j * (count(*) - 1) / 1000.0::DOUBLE) AS INT) + 1] + "
            "(list_sort(list(v))[CAST(ceil(j * (count(*) - 1) / 1000.0::DOUBLE) AS INT) + 1] - "
            "list_sort(list(v))[CAST(floor(j * (count(*) - 1) / 1000.0::DOUBLE) AS INT) + 1]) * "
            "(j * (count(*) - 1) / 1000.0::DOUBLE - floor(j * (count(*) - 1) / "
            "1000.0::DOUBLE)))"), MON))
def n5(spark, sf):
    q = mo.exact_quantiles(mo.by_value(churn_runs(spark, sf, REF_RUN), ["p"]))
    return q.select("j", F.round("value", 6).alias("value"))


@query("n6_reference_percentile", with_views("""
SELECT customer_id, run_cutoff, (SELECT count(*) FROM nqq WHERE q <= round(p, 6)) * 10.0::DOUBLE
  AS reference_percentile FROM (SELECT customer_id, run_cutoff, days_since_last_order /
  (60 + days_since_last_order) AS p FROM cf WHERE run_cutoff >= TIMESTAMP '2000-07-01')""",
                                             MON + """,
nqq AS (SELECT unnest([round(x, 6) FOR x IN quantile_disc(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7,
  0.8, 0.9, 1.0])]) AS q FROM nr WHERE feature = 'p')"""))
def n6(spark, sf):
    past, cur = reference_and_current(spark, sf)
    ref = mo.by_value(past, ["p"])
    cuts = F.array(*[F.lit(i) for i in range(1, 11)])
    q = ref.withColumn("i", F.explode(F.filter(cuts, lambda i: (
        F.col("upto_n") * 10 >= i * F.col("total_n"))
        & (F.col("before_n") * 10 < i * F.col("total_n")))))
    stored = [r["v"] for r in q.select(F.round("score", 6).alias("v")).collect()]  # ten values
    cur = cur.select("customer_id", "run_cutoff", F.round("p", 6).alias("p"))
    return mo.reference_percentile(cur, "p", stored).select("customer_id", "run_cutoff",
                                                            "reference_percentile")


DRIFT_COLS = ["feature", "psi", "reference_mean", "current_mean", "outside_reference_range"]


@query("n7_feature_drift", with_views("""
SELECT feature, round(psi, 6) AS psi, round(nm.mean, 6) AS reference_mean,
  round((SELECT avg(v) FROM nc WHERE nc.feature = np.feature), 6) AS current_mean,
  round((SELECT avg((v < lo OR v > hi)::INT) FROM nc WHERE nc.feature = np.feature), 6)
    AS outside_reference_range FROM np JOIN nm USING (feature) WHERE feature <> 'p'""", MON))
def n7(spark, sf):
    ref, cur = reference_and_current(spark, sf)
    d = mo.numeric_drift(mo.numeric_profile(ref, NUM), cur, NUM)
    return rounded(d.select(*DRIFT_COLS), 6)


@query("n7_categorical_drift", with_views("""
SELECT feature, round(sum((greatest(c, 1e-4) - greatest(r, 1e-4)) * ln(greatest(c, 1e-4) /
  greatest(r, 1e-4))), 6) AS psi, arg_max(level, (abs(c - r), level)) AS most_shifted_level
FROM lr GROUP BY 1""", CHURN_SQL + "," + LEVEL_SQL))
def n7c(spark, sf):
    ref, cur = reference_and_current(spark, sf)
    d = mo.categorical_drift(ref, cur, LEVELS)
    return rounded(d.select("feature", "psi", "most_shifted_level"), 6)


@query("n8_score_drift", with_views("""
SELECT feature, round(psi, 6) AS psi, round(nm.mean, 6) AS reference_mean,
  round((SELECT avg(v) FROM nc WHERE nc.feature = 'p'), 6) AS current_mean
FROM np JOIN nm USING (feature) WHERE feature = 'p'""", MON))
def n8(spark, sf):
    ref, cur = reference_and_current(spark, sf)
    d = mo.numeric_drift(mo.numeric_profile(ref, ["p"]), cur, ["p"])
    return rounded(d.select("feature", "psi", "reference_mean", "current_mean"), 6)


PERF = CHURN_SQL + """,
pf AS (SELECT run_cutoff, churned AS y, days_since_last_order / (60 + days_since_last_order) AS p
  FROM cf JOIN labelled USING (run_cutoff, customer_id)
  WHERE run_cutoff >= TIMESTAMP '2000-07-01'),
pg AS (SELECT run_cutoff, p, count(*) AS n, sum(y) AS pos FROM pf GROUP BY 1, 2),
pw AS (SELECT *, sum(pos) OVER (PARTITION BY run_cutoff ORDER BY p DESC) - pos AS before_pos
  FROM pg),
pa AS (SELECT run_cutoff, sum(n) AS rows, sum(pos) AS np, sum(n) - sum(pos) AS nn,
    sum((n - pos) * (before_pos + pos / 2.0::DOUBLE)) / (sum(pos) * (sum(n) - sum(pos))) AS auc
  FROM pw GROUP BY 1),
pe AS (SELECT *, sqrt(greatest((auc * (1 - auc) + (np - 1) * (auc / (2 - auc) - auc * auc) +
    (nn - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (np * nn), 0)) AS se FROM pa),
pz AS (SELECT pe.*, o, m, s, e, v FROM pe JOIN (SELECT run_cutoff, avg(y) AS o, avg(p) AS m,
  sum(y) AS s, sum(p) AS e, sum(p * (1 - p)) AS v FROM pf GROUP BY 1) USING (run_cutoff))
"""


@query("n9_performance", with_views("""
SELECT run_cutoff, CAST(rows AS BIGINT) AS rows, round(o, 6) AS observed_rate,
  round(m, 6) AS mean_predicted, round(s / e, 6) AS observed_to_predicted,
  round((s - e) / sqrt(v), 5) AS calibration_z, round(auc, 6) AS roc_auc,
  round(auc - 1.959964::DOUBLE * se, 6) AS roc_auc_ci_low,
  round(auc + 1.959964::DOUBLE * se, 6) AS roc_auc_ci_high FROM pz""", PERF))
def n9(spark, sf):
    t = mo.performance(churn_runs(spark, sf, CUR_RUNS), "p", "churned", ["run_cutoff"])
    t = t.drop("average_precision")
    return t.select(*[F.round(c, 5 if c == "calibration_z" else 6).alias(c)
                      if dict(t.dtypes)[c] == "double" else F.col(c) for c in t.columns])


def monitor(spark, sf):
    ref, cur = reference_and_current(spark, sf)
    mature = tw.labels_mature(F.col("run_cutoff"), 90, "2000-11-01")
    return mo.monitor(ref, cur, NUM, LEVELS, "p", "churned", "run_cutoff", mature, 0.75)


@query("n10_monitor")
def n10(spark, sf):
    return rounded(monitor(spark, sf)["drift"], 6)


@query("n11_findings", with_views("""
SELECT check_name, severity, subject FROM (
  SELECT 'feature_drift' AS check_name, CASE WHEN psi >= 0.25 THEN 'investigate' ELSE 'watch' END
    AS severity, feature AS subject FROM (SELECT * FROM np UNION ALL SELECT feature,
      sum((greatest(c, 1e-4) - greatest(r, 1e-4)) * ln(greatest(c, 1e-4) / greatest(r, 1e-4)))
      FROM lr GROUP BY 1) WHERE psi >= 0.1
  UNION ALL SELECT 'discrimination', 'retrain', '2000-07-01 00:00:00' FROM pz WHERE run_cutoff =
    TIMESTAMP '2000-07-01' AND auc < 0.7 AND auc + 1.959964 * se < 0.75
  UNION ALL SELECT 'calibration', 'recalibrate', '2000-07-01 00:00:00' FROM pz WHERE run_cutoff =
    TIMESTAMP '2000-07-01' AND NOT (s / e BETWEEN 0.8 AND 1.25) AND
    abs((s - e) / sqrt(v)) > 1.959964)""", MON + "," + LEVEL_SQL + "," + PERF.replace(
    CHURN_SQL + ",", "", 1)))
def n11(spark, sf):
    return monitor(spark, sf)["findings"]


@query("n11_status")
def n11s(spark, sf):
    return monitor(spark, sf)["status"]


@query("n12_cross_check")
def n12(spark, sf):
    from tidemark.operators.metrics import discrimination
    d = discrimination(ad.score_frame(spark, sf), {"a": "score_a", "b": "score_b"}, "label")
    return rounded(mo.cross_check(d, d.select("model", F.round("roc_auc", 4).alias("roc_auc"))),
                   6)

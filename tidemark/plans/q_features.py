"""Time-window, feature, label and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cols import rounded, ts
from tidemark.operators import churn, leads, value
from tidemark.operators import timewin as tw
from tidemark.plans.registry import query
from tidemark.sources import adapters as ad
from tidemark.sources.oracle_views import with_views

LEAD_RUNS = ["2024-01-02", "2024-01-03", "2024-01-05", "2024-01-08"]
LEAD_DAYS = 7
RUNS = ["2000-01-01", "2000-04-01", "2000-07-01", "2000-10-01"]
PROBE = "2000-07-01"
TS = "TIMESTAMP"


def runs_cte(runs, name="runs") -> str:
    return f"{name} AS (SELECT unnest([{', '.join(f'{TS} {r!r}' for r in runs)}]) AS run_cutoff)"


DAYS = "date_diff('microsecond', {a}, {b}) / 86400e6"


def days(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 86400e6::DOUBLE)"


# ------------------------------------------------------------------ F: time windows
@query("f1_events_before", with_views("""
SELECT count(*) AS n, round(sum(net_amount), 2) AS total FROM g_orders
WHERE order_ts < TIMESTAMP '2000-07-01'"""))
def f1(spark, sf):
    o = tw.events_before(ad.ledger(spark, sf)["orders"], "order_ts", PROBE)
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_amount"), 2).alias("total"))


@query("f2_events_between", with_views("""
SELECT order_id, customer_id FROM g_orders
WHERE order_ts >= TIMESTAMP '2000-01-01' AND order_ts < TIMESTAMP '2000-07-01'"""))
def f2(spark, sf):
    return tw.events_between(ad.ledger(spark, sf)["orders"], "order_ts", "2000-01-01",
                             PROBE).select("order_id", "customer_id")


@query("f3_window_masks", with_views("""
SELECT count(*) FILTER (order_ts >= TIMESTAMP '2000-04-02' AND order_ts < TIMESTAMP '2000-07-01')
         AS in_features,
       count(*) FILTER (order_ts >= TIMESTAMP '2000-07-01' AND order_ts < TIMESTAMP '2000-09-29')
         AS in_labels FROM g_orders"""))
def f3(spark, sf):
    w = tw.PredictionWindow(PROBE, 90, ad.LEDGER_START, ad.LEDGER_END, lookback_days=90)
    t = F.col("order_ts")
    return ad.ledger(spark, sf)["orders"].agg(F.count_if(w.in_features(t)).alias("in_features"),
                                              F.count_if(w.in_labels(t)).alias("in_labels"))


@query("f4_rolling_cutoffs", with_views("""
SELECT run_cutoff, count(*) AS orders_before FROM runs JOIN g_orders ON order_ts < run_cutoff
GROUP BY 1""", runs_cte(tw.rolling_cutoffs("2000-01-01", "2000-12-31", 28))))
def f4(spark, sf):
    from tidemark.functions.cols import fan_out
    cuts = tw.rolling_cutoffs("2000-01-01", "2000-12-31", 28)
    return fan_out(ad.ledger(spark, sf)["orders"], "order_ts", cuts).groupBy("run_cutoff").agg(
        F.count(F.lit(1)).alias("orders_before"))


@query("f5_snapshot", with_views("""
SELECT 'orders' AS table_name, count(*) AS n, 0::BIGINT AS masked FROM g_orders
  WHERE order_ts < TIMESTAMP '2000-07-01'
UNION ALL SELECT 'order_lines', count(*), 0 FROM g_lines WHERE order_id IN
  (SELECT order_id FROM g_orders WHERE order_ts < TIMESTAMP '2000-07-01')
UNION ALL SELECT 'sessions', count(*), 0 FROM g_sessions
  WHERE session_start < TIMESTAMP '2000-06-15'
UNION ALL SELECT 'support_contacts', count(*),
  count(*) FILTER (resolved_at IS NULL OR resolved_at >= TIMESTAMP '2000-06-15')
  FROM g_contacts WHERE contact_ts < TIMESTAMP '2000-06-15'"""))
def f5(spark, sf):
    t = ad.ledger(spark, sf)
    a = tw.snapshot({k: t[k] for k in ("orders", "order_lines")}, PROBE)
    b = tw.snapshot({k: t[k] for k in ("sessions", "support_contacts")}, "2000-06-15")
    out = None
    for name, df in {**a, **b}.items():
        masked = (F.count_if(F.col("resolved_at").isNull()) if name == "support_contacts"
                  else F.lit(0).cast("bigint"))
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                     masked.alias("masked"))
        out = row if out is None else out.unionByName(row)
    return out


@query("f6_monthly_runs", with_views("""
SELECT run_cutoff, count(DISTINCT customer_id) AS customers FROM runs
JOIN g_customers ON customer_since < run_cutoff GROUP BY 1""",
                                     runs_cte(tw.monthly_runs("1995-02-01", ad.LEDGER_END))))
def f6(spark, sf):
    return value.customer_base(ad.ledger(spark, sf)["customers"],
                               tw.monthly_runs("1995-02-01", ad.LEDGER_END)).groupBy(
        "run_cutoff").agg(F.count(F.lit(1)).alias("customers"))


PLAN = tw.SplitPlan(fit=("2000-01-01", "2000-02-01"), validation=("2000-06-01",),
                    holdout=("2000-10-01", "2000-11-01"), horizon_days=90,
                    data_end=ad.LEDGER_END)
CHURN_LABEL = """
base AS (SELECT DISTINCT run_cutoff, customer_id FROM runs JOIN g_orders
         ON order_ts < run_cutoff AND order_ts >= run_cutoff - INTERVAL 180 DAY),
labelled AS (SELECT b.run_cutoff, b.customer_id, CASE WHEN EXISTS (SELECT 1 FROM g_orders o
         WHERE o.customer_id = b.customer_id AND o.order_ts >= b.run_cutoff
           AND o.order_ts < b.run_cutoff + INTERVAL 90 DAY) THEN 0 ELSE 1 END AS churned
         FROM base b)
"""


def _labelled(spark, sf, runs):
    o = ad.ledger(spark, sf)["orders"]
    return churn.churn_labels(churn.active_customers(o, runs), o, runs, 90)


@query("f7_split_roles", with_views("""
SELECT CASE WHEN run_cutoff < TIMESTAMP '2000-05-01' THEN 'fit'
            WHEN run_cutoff < TIMESTAMP '2000-09-01' THEN 'validation' ELSE 'holdout' END AS split,
       run_cutoff, count(*) AS rows FROM base GROUP BY ALL""",
                                    runs_cte(PLAN.runs) + "," + CHURN_LABEL))
def f7(spark, sf):
    b = churn.active_customers(ad.ledger(spark, sf)["orders"], PLAN.runs)
    role = PLAN.role_of(F.date_format("run_cutoff", "yyyy-MM-dd"))
    return b.groupBy(role.alias("split"), "run_cutoff").agg(F.count(F.lit(1)).alias("rows"))


@query("f8_open_leads", with_views("""
SELECT run_cutoff, p.prospect_id FROM runs JOIN j_prospects p
  ON created_at < run_cutoff AND created_at >= run_cutoff - INTERVAL 90 DAY
WHERE NOT EXISTS (SELECT 1 FROM j_customers c WHERE c.prospect_id = p.prospect_id
                  AND c.customer_since < run_cutoff)""", runs_cte(LEAD_RUNS)))
def f8(spark, sf):
    t = ad.journey(spark, sf)
    return leads.open_leads(t["prospects"], t["customers"], LEAD_RUNS).select(
        "run_cutoff", "prospect_id")


@query("f9_active_customers", with_views("SELECT * FROM base",
                                         runs_cte(RUNS) + "," + CHURN_LABEL))
def f9(spark, sf):
    return churn.active_customers(ad.ledger(spark, sf)["orders"], RUNS)


@query("f10_customer_base", with_views("""
SELECT DISTINCT run_cutoff, customer_id FROM runs JOIN g_customers ON customer_since < run_cutoff
""", runs_cte(RUNS)))
def f10(spark, sf):
    return value.customer_base(ad.ledger(spark, sf)["customers"], RUNS)


@query("f11_mature_population", with_views("""
SELECT acquisition_channel, count(*) AS mature FROM g_prospects
WHERE created_at < TIMESTAMP '2001-08-02' - INTERVAL 60 DAY GROUP BY 1"""))
def f11(spark, sf):
    p = ad.ledger(spark, sf)["prospects"]
    from tidemark.operators.kpis import mature
    return mature(p, "created_at", 60, ad.LEDGER_END).groupBy("acquisition_channel").agg(
        F.count(F.lit(1)).alias("mature"))


@query("f12_labels_mature", with_views("""
SELECT run_cutoff, run_cutoff + INTERVAL 90 DAY <= TIMESTAMP '2001-08-02' AS labels_mature,
       count(DISTINCT customer_id) AS rows FROM runs JOIN g_orders
  ON order_ts < run_cutoff AND order_ts >= run_cutoff - INTERVAL 180 DAY GROUP BY ALL""",
                                       runs_cte(tw.monthly_runs("2001-03-01", "2001-08-01"))))
def f12(spark, sf):
    runs = tw.monthly_runs("2001-03-01", "2001-08-01")
    b = churn.active_customers(ad.ledger(spark, sf)["orders"], runs)
    return b.groupBy("run_cutoff", tw.labels_mature(F.col("run_cutoff"), 90, ad.LEDGER_END)
                     .alias("labels_mature")).agg(F.count(F.lit(1)).alias("rows"))


@query("f13_month_window", with_views("""
SELECT strftime(order_ts, '%Y-%m') AS month, count(*) AS orders FROM g_orders
WHERE strftime(order_ts, '%Y-%m') BETWEEN '1999-03' AND '1999-11'
  AND order_channel IN ('web', 'app') GROUP BY 1"""))
def f13(spark, sf):
    o = ad.ledger(spark, sf)["orders"].where(F.col("order_channel").isin("web", "app"))
    monthly = o.groupBy(F.date_format("order_ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"))
    return tw.month_window(monthly, "1999-11", "1999-03")


@query("f17_complete_weeks", with_views("""
SELECT CAST(date_trunc('week', order_ts) AS DATE) AS week_start, round(sum(net_amount), 4)
       AS net_revenue FROM g_orders WHERE order_ts >= TIMESTAMP '1995-01-02'
  AND order_ts < TIMESTAMP '2001-07-30' GROUP BY 1"""))
def f17(spark, sf):
    from tidemark.operators.forecast import daily_revenue, weekly_revenue
    d = daily_revenue(ad.ledger(spark, sf)["orders"], ad.LEDGER_START, ad.LEDGER_END)
    return weekly_revenue(d).select("week_start", F.round("net_revenue", 4).alias("net_revenue"))


@query("f18_split_summary", with_views("""
SELECT CASE WHEN run_cutoff < TIMESTAMP '2000-05-01' THEN 'fit'
            WHEN run_cutoff < TIMESTAMP '2000-09-01' THEN 'validation' ELSE 'holdout' END AS split,
       count(DISTINCT run_cutoff) AS runs, CAST(min(run_cutoff) AS DATE) AS first_run,
       CAST(max(run_cutoff) AS DATE) AS last_run, count(*) AS rows,
       count(DISTINCT customer_id) AS entities, CAST(sum(churned) AS BIGINT) AS positives,
       round(avg(churned), 6) AS rate FROM labelled GROUP BY 1""",
                                       runs_cte(PLAN.runs) + "," + CHURN_LABEL))
def f18(spark, sf):
    return rounded(tw.split_summary(_labelled(spark, sf, PLAN.runs), PLAN, "customer_id",
                                    "churned"), 6)


# ------------------------------------------------------------------ A: leads
LEAD_SQL = runs_cte(LEAD_RUNS) + f""",
lead AS (SELECT run_cutoff, p.* FROM runs JOIN j_prospects p
  ON created_at < run_cutoff AND created_at >= run_cutoff - INTERVAL 90 DAY
  WHERE NOT EXISTS (SELECT 1 FROM j_customers c WHERE c.prospect_id = p.prospect_id
                    AND c.customer_since < run_cutoff)),
ldepth AS (SELECT run_cutoff, session_id, max(stage_number) AS depth FROM runs JOIN j_funnel
  ON event_ts < run_cutoff GROUP BY 1, 2),
ls AS (SELECT l.run_cutoff, l.prospect_id, {days('s.session_start', 'l.run_cutoff')} AS age,
         coalesce(d.depth, 1) AS depth, s.pages_viewed, s.platform, s.device_type
  FROM lead l JOIN j_sessions s ON s.prospect_id = l.prospect_id
       AND s.session_start < l.run_cutoff
  LEFT JOIN ldepth d ON d.session_id = s.session_id AND d.run_cutoff = l.run_cutoff),
lsf AS (SELECT run_cutoff, prospect_id, CAST(count(*) AS DOUBLE) AS sessions_total,
    CAST(count(*) FILTER (age < 7) AS DOUBLE) AS sessions_7d,
    CAST(count(*) FILTER (age < 30) AS DOUBLE) AS sessions_30d,
    min(age) AS days_since_last_session, CAST(max(depth) AS DOUBLE) AS max_stage_reached,
    CAST(count(*) FILTER (depth >= 3) AS DOUBLE) AS cart_sessions,
    CAST(count(*) FILTER (depth >= 3 AND age < 7) AS DOUBLE) AS cart_sessions_7d,
    CAST(count(*) FILTER (depth >= 4) AS DOUBLE) AS checkout_sessions,
    CAST(sum(pages_viewed) AS DOUBLE) AS pages_viewed,
    avg(CASE WHEN platform = 'app' THEN 1 ELSE 0 END) AS app_session_share,
    avg(CASE WHEN device_type = 'mobile' THEN 1 ELSE 0 END) AS mobile_session_share
  FROM ls GROUP BY 1, 2),
ltf AS (SELECT l.run_cutoff, l.prospect_id,
    CAST(count(*) FILTER (touch_type = 'email') AS DOUBLE) AS emails_received,
    CAST(count(*) FILTER (touch_type = 'email' AND opened) AS DOUBLE) AS emails_opened,
    CAST(count(*) FILTER (touch_type = 'email' AND clicked) AS DOUBLE) AS emails_clicked,
    CAST(count(*) FILTER (touch_type = 'ad_click') AS DOUBLE) AS retarget_clicks
  FROM lead l JOIN j_touches t ON t.prospect_id = l.prospect_id AND t.touch_at < l.run_cutoff
       AND t.touch_at > l.created_at GROUP BY 1, 2),
lf AS (SELECT l.run_cutoff, l.prospect_id, l.acquisition_channel, l.region, l.age_band,
    l.income_band, l.device_type, CAST(l.email_opt_in AS INT) AS email_opt_in,
    {days('l.created_at', 'l.run_cutoff')} AS lead_age_days,
    coalesce(sessions_total, 0) AS sessions_total, coalesce(sessions_7d, 0) AS sessions_7d,
    coalesce(sessions_30d, 0) AS sessions_30d,
    coalesce(days_since_last_session, {days('l.created_at', 'l.run_cutoff')})
      AS days_since_last_session,
    coalesce(max_stage_reached, 0) AS max_stage_reached,
    coalesce(cart_sessions, 0) AS cart_sessions,
    coalesce(cart_sessions_7d, 0) AS cart_sessions_7d,
    coalesce(checkout_sessions, 0) AS checkout_sessions, coalesce(pages_viewed, 0) AS pages_viewed,
    coalesce(app_session_share, 0) AS app_session_share,
    coalesce(mobile_session_share, 0) AS mobile_session_share,
    coalesce(emails_received, 0) AS emails_received, coalesce(emails_opened, 0) AS emails_opened,
    coalesce(emails_clicked, 0) AS emails_clicked, coalesce(retarget_clicks, 0) AS retarget_clicks,
    CASE WHEN emails_received > 0 THEN emails_opened / emails_received ELSE 0 END
      AS email_open_rate
  FROM lead l LEFT JOIN lsf USING (run_cutoff, prospect_id)
  LEFT JOIN ltf USING (run_cutoff, prospect_id))
"""
ROUND_LEAD = ("lead_age_days", "days_since_last_session", "app_session_share",
              "mobile_session_share", "email_open_rate")


def _replace(cols, digits=6):
    return "* REPLACE (" + ", ".join(f"round({c}, {digits}) AS {c}" for c in cols) + ")"


@query("a1_conversion_labels", with_views(f"""
SELECT run_cutoff, prospect_id, CASE WHEN EXISTS (SELECT 1 FROM j_customers c
  WHERE c.prospect_id = lead.prospect_id AND customer_since >= run_cutoff
    AND customer_since < run_cutoff + INTERVAL {LEAD_DAYS} DAY) THEN 1 ELSE 0 END AS converted
FROM lead""", LEAD_SQL))
def a1(spark, sf):
    t = ad.journey(spark, sf)
    pop = leads.open_leads(t["prospects"], t["customers"], LEAD_RUNS).select(*leads.KEYS)
    return leads.conversion_labels(pop, t["customers"], LEAD_DAYS)


@query("a2_lead_session_features", with_views(
    f"SELECT {_replace(['days_since_last_session', 'app_session_share', 'mobile_session_share'])} "
    "FROM lsf", LEAD_SQL))
def a2(spark, sf):
    t = ad.journey(spark, sf)
    pop = leads.open_leads(t["prospects"], t["customers"], LEAD_RUNS)
    return rounded(leads.session_features(pop, t["sessions"], t["funnel_events"], LEAD_RUNS), 6)


@query("a3_lead_touch_features", with_views("""
SELECT *, round(CASE WHEN emails_received > 0 THEN emails_opened / emails_received ELSE 0 END, 6)
  AS email_open_rate FROM ltf""", LEAD_SQL))
def a3(spark, sf):
    t = ad.journey(spark, sf)
    pop = leads.open_leads(t["prospects"], t["customers"], LEAD_RUNS)
    return rounded(leads.touch_features(pop, t["marketing_touches"], LEAD_RUNS), 6)


@query("a4_lead_features", with_views(f"SELECT {_replace(ROUND_LEAD)} FROM lf", LEAD_SQL))
def a4(spark, sf):
    return rounded(leads.build_features(ad.journey(spark, sf), LEAD_RUNS), 6)


@query("a5_lead_dataset", with_views(f"""
SELECT run_cutoff, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives,
       round(avg(sessions_total), 6) AS mean_sessions, round(avg(lead_age_days), 6) AS mean_age
FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM j_customers c
  WHERE c.prospect_id = lf.prospect_id AND customer_since >= run_cutoff
    AND customer_since < run_cutoff + INTERVAL {LEAD_DAYS} DAY) THEN 1 ELSE 0 END AS y FROM lf)
GROUP BY 1""", LEAD_SQL))
def a5(spark, sf):
    d = leads.build_dataset(ad.journey(spark, sf), LEAD_RUNS, LEAD_DAYS)
    return rounded(d.groupBy("run_cutoff").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("converted").alias("positives"),
        F.avg("sessions_total").alias("mean_sessions"), F.avg("lead_age_days")
        .alias("mean_age")), 6)


@query("a6_churn_labels", with_views("SELECT * FROM labelled", runs_cte(RUNS) + "," + CHURN_LABEL))
def a6(spark, sf):
    return _labelled(spark, sf, RUNS)


CHURN_SQL = runs_cte(RUNS) + "," + CHURN_LABEL + f""",
co AS (SELECT run_cutoff, o.*, {days('order_ts', 'run_cutoff')} AS age FROM runs JOIN g_orders o
       ON order_ts < run_cutoff),
cof AS (SELECT run_cutoff, customer_id, min(age) AS days_since_last_order,
    count(*) AS orders_total, count(*) FILTER (age < 90) AS orders_90d,
    count(*) FILTER (age >= 90 AND age < 180) AS orders_prev_90d,
    sum(CASE WHEN age < 180 THEN net_amount ELSE 0.0::DOUBLE END) AS net_revenue_180d,
    avg(net_amount) AS avg_order_value,
    CASE WHEN sum(gross_amount) > 0 THEN sum(discount_amount) / sum(gross_amount) ELSE 0 END
      AS discount_share,
    CASE WHEN arg_min(discount_amount, (order_ts, order_id)) > 0 THEN 1 ELSE 0 END
      AS first_order_discounted,
    avg(CASE WHEN order_channel = 'store' THEN 1 ELSE 0 END) AS store_order_share,
    avg(CASE WHEN order_channel = 'app' THEN 1 ELSE 0 END) AS app_order_share
  FROM co GROUP BY 1, 2),
clf AS (SELECT run_cutoff, customer_id, count(DISTINCT category) AS category_count,
    greatest(sum(CASE WHEN age < 180 THEN l.net_amount - quantity * unit_cost
                 ELSE 0.0::DOUBLE END), 0.0::DOUBLE) AS margin_180d
  FROM co JOIN g_lines l USING (order_id) JOIN products USING (product_id) GROUP BY 1, 2),
csf AS (SELECT run_cutoff, customer_id,
    count(*) FILTER (browse AND age < 30) AS browse_sessions_30d,
    count(*) FILTER (browse AND age < 90) AS browse_sessions_90d,
    min(age) AS days_since_last_session
  FROM (SELECT run_cutoff, customer_id, {days('session_start', 'run_cutoff')} AS age,
          NOT EXISTS (SELECT 1 FROM g_orders o WHERE o.session_id = s.session_id
                      AND o.order_ts < run_cutoff) AS browse
        FROM runs JOIN g_sessions s ON session_start < run_cutoff) GROUP BY 1, 2),
cef AS (SELECT run_cutoff, customer_id, count(*) AS emails_received_90d,
    count(*) FILTER (clicked) AS email_clicks_90d,
    count(*) FILTER (opened) / CAST(count(*) AS DOUBLE) AS email_open_rate_90d
  FROM runs JOIN g_touches ON touch_at < run_cutoff AND touch_at >= run_cutoff - INTERVAL 90 DAY
  WHERE touch_type = 'email' GROUP BY 1, 2),
cmf AS (SELECT run_cutoff, customer_id,
    CASE WHEN max(CASE WHEN event_type <> 'cancel' THEN event_ts END) + CASE WHEN
      arg_max(plan, (event_ts, subscription_event_id)) FILTER (event_type <> 'cancel') = 'annual'
      THEN INTERVAL 365 DAY ELSE INTERVAL 30 DAY END > run_cutoff THEN 1 ELSE 0 END AS plus_member,
    max(CASE WHEN event_type = 'cancel' AND event_ts >= run_cutoff - INTERVAL 180 DAY
        THEN 1 ELSE 0 END) AS plus_cancelled_180d
  FROM runs JOIN g_subs ON event_ts < run_cutoff GROUP BY 1, 2),
cuf AS (SELECT run_cutoff, customer_id,
    count(*) FILTER (recent) AS support_contacts_180d,
    count(*) FILTER (recent AND csat <= 2) AS low_csat_contacts_180d,
    count(*) FILTER (recent AND date_diff('microsecond', contact_ts, resolved) / 3600e6 > 24)
      AS slow_resolution_contacts_180d,
    count(*) FILTER (resolved IS NULL) AS open_contacts
  FROM (SELECT run_cutoff, customer_id, contact_ts,
          contact_ts >= run_cutoff - INTERVAL 180 DAY AS recent,
          CASE WHEN resolved_at < run_cutoff THEN resolved_at END AS resolved,
          CASE WHEN resolved_at < run_cutoff OR resolved_at IS NULL THEN csat_score END AS csat
        FROM runs JOIN g_contacts ON contact_ts < run_cutoff) GROUP BY 1, 2),
act AS (SELECT b.run_cutoff, b.customer_id, acquisition_channel, region, age_band, income_band,
    device_type, CAST(email_opt_in AS INT) AS email_opt_in,
    {days('customer_since', 'b.run_cutoff')} AS tenure_days,
    coalesce(browse_sessions_30d, 0) AS browse_sessions_30d,
    coalesce(browse_sessions_90d, 0) AS browse_sessions_90d,
    coalesce(days_since_last_session, {days('customer_since', 'b.run_cutoff')})
      AS days_since_last_session,
    coalesce(emails_received_90d, 0) AS emails_received_90d,
    coalesce(email_open_rate_90d, 0) AS email_open_rate_90d,
    coalesce(email_clicks_90d, 0) AS email_clicks_90d,
    coalesce(plus_member, 0) AS plus_member, coalesce(plus_cancelled_180d, 0)
      AS plus_cancelled_180d, coalesce(support_contacts_180d, 0) AS support_contacts_180d,
    coalesce(low_csat_contacts_180d, 0) AS low_csat_contacts_180d,
    coalesce(slow_resolution_contacts_180d, 0) AS slow_resolution_contacts_180d,
    coalesce(open_contacts, 0) AS open_contacts
  FROM (SELECT DISTINCT run_cutoff, customer_id FROM runs JOIN g_customers
        ON customer_since < run_cutoff) b
  JOIN g_customers USING (customer_id) LEFT JOIN csf USING (run_cutoff, customer_id)
  LEFT JOIN cef USING (run_cutoff, customer_id) LEFT JOIN cmf USING (run_cutoff, customer_id)
  LEFT JOIN cuf USING (run_cutoff, customer_id)),
cf AS (SELECT act.*, cof.* EXCLUDE (run_cutoff, customer_id), category_count,
         coalesce(margin_180d, 0) AS margin_180d
       FROM base JOIN act USING (run_cutoff, customer_id)
       JOIN cof USING (run_cutoff, customer_id) LEFT JOIN clf USING (run_cutoff, customer_id))
"""
ORDER_ROUND = {"days_since_last_order": 6, "net_revenue_180d": 4, "avg_order_value": 7,
               "discount_share": 6, "store_order_share": 6, "app_order_share": 6}
CHURN_ROUND = {**ORDER_ROUND, "tenure_days": 6, "days_since_last_session": 6,
               "email_open_rate_90d": 6, "margin_180d": 4}


def repl(rounds: dict) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, {d}) AS {c}" for c, d in rounds.items()) + ")"


def rnd(df, rounds: dict):
    return df.select(*[F.round(c, rounds[c]).alias(c) if c in rounds else F.col(c)
                       for c in df.columns])


@query("a7_churn_order_features", with_views(f"SELECT {repl(ORDER_ROUND)} FROM cof", CHURN_SQL))
def a7(spark, sf):
    return rnd(churn.order_features(ad.ledger(spark, sf)["orders"], RUNS), ORDER_ROUND)


@query("a8_category_and_margin", with_views(f"SELECT {repl({'margin_180d': 4})} FROM clf",
                                            CHURN_SQL))
def a8(spark, sf):
    t = ad.ledger(spark, sf)
    return rnd(churn.line_features(t["orders"], t["order_lines"], t["products"], RUNS),
               {"margin_180d": 4})


@query("a9_session_features", with_views(f"SELECT {repl({'days_since_last_session': 6})} FROM csf",
                                         CHURN_SQL))
def a9(spark, sf):
    t = ad.ledger(spark, sf)
    return rnd(churn.session_features(t["sessions"], t["orders"], RUNS),
               {"days_since_last_session": 6})


@query("a10_email_features", with_views(f"SELECT {repl({'email_open_rate_90d': 6})} FROM cef",
                                        CHURN_SQL))
def a10(spark, sf):
    return rnd(churn.email_features(ad.ledger(spark, sf)["marketing_touches"], RUNS),
               {"email_open_rate_90d": 6})


@query("a11_membership_features", with_views("SELECT * FROM cmf", CHURN_SQL))
def a11(spark, sf):
    return churn.membership_features(ad.ledger(spark, sf)["subscription_events"], RUNS)


@query("a12_support_features", with_views("SELECT * FROM cuf", CHURN_SQL))
def a12(spark, sf):
    return churn.support_features(ad.ledger(spark, sf)["support_contacts"], RUNS)


@query("a13_churn_features", with_views(
    f"SELECT {repl(CHURN_ROUND)} FROM cf JOIN labelled USING (run_cutoff, customer_id)",
    CHURN_SQL))
def a13(spark, sf):
    d = churn.build_dataset(ad.ledger(spark, sf), RUNS, data_start=ad.LEDGER_START)
    return rnd(d, CHURN_ROUND)


VALUE_SQL = CHURN_SQL + f""",
vof AS (SELECT run_cutoff, customer_id, min(age) AS days_since_last_order,
    CASE WHEN count(*) > 1 THEN (max(age) - min(age)) / (count(*) - 1) ELSE max(age) END
      AS mean_days_between_orders, count(*) AS orders_total,
    count(*) FILTER (age < 90) AS orders_90d, count(*) FILTER (age < 180) AS orders_180d,
    count(*) FILTER (age < 365) AS orders_365d, sum(net_amount) AS revenue_total,
    sum(CASE WHEN age < 90 THEN net_amount ELSE 0.0::DOUBLE END) AS revenue_90d,
    sum(CASE WHEN age < 180 THEN net_amount ELSE 0.0::DOUBLE END) AS revenue_180d,
    sum(CASE WHEN age < 365 THEN net_amount ELSE 0.0::DOUBLE END) AS revenue_365d,
    avg(net_amount) AS avg_order_value, max(net_amount) AS max_order_value,
    avg(item_count) AS items_per_order,
    CASE WHEN sum(gross_amount) > 0 THEN sum(discount_amount) / sum(gross_amount) ELSE 0 END
      AS discount_share,
    avg(CASE WHEN order_channel = 'store' THEN 1 ELSE 0 END) AS store_order_share,
    avg(CASE WHEN order_channel = 'app' THEN 1 ELSE 0 END) AS app_order_share
  FROM co GROUP BY 1, 2),
fut AS (SELECT run_cutoff, customer_id, sum(net_amount) AS spend FROM runs JOIN g_orders
  ON order_ts >= run_cutoff AND order_ts < run_cutoff + INTERVAL 180 DAY GROUP BY 1, 2),
vf AS (SELECT act.* EXCLUDE (slow_resolution_contacts_180d, open_contacts),
         vof.* EXCLUDE (run_cutoff, customer_id), category_count
       FROM act LEFT JOIN vof USING (run_cutoff, customer_id)
       LEFT JOIN clf USING (run_cutoff, customer_id))
"""
VORDER_ROUND = {"days_since_last_order": 6, "mean_days_between_orders": 6, "revenue_total": 4,
                "revenue_90d": 4, "revenue_180d": 4, "revenue_365d": 4, "avg_order_value": 7,
                "max_order_value": 4, "items_per_order": 6, "discount_share": 6,
                "store_order_share": 6, "app_order_share": 6}
VALUE_ROUND = {**VORDER_ROUND, "tenure_days": 6, "days_since_last_session": 6,
               "email_open_rate_90d": 6}


@query("a14_future_revenue", with_views("""
SELECT run_cutoff, customer_id, round(coalesce(spend, 0), 4) AS future_revenue
FROM (SELECT DISTINCT run_cutoff, customer_id FROM runs JOIN g_customers
      ON customer_since < run_cutoff) LEFT JOIN fut USING (run_cutoff, customer_id)""", VALUE_SQL))
def a14(spark, sf):
    t = ad.ledger(spark, sf)
    return rnd(value.future_revenue(value.customer_base(t["customers"], RUNS), t["orders"], RUNS,
                                    180), {"future_revenue": 4})


@query("a15_value_order_features", with_views(f"SELECT {repl(VORDER_ROUND)} FROM vof", VALUE_SQL))
def a15(spark, sf):
    return rnd(value.order_features(ad.ledger(spark, sf)["orders"], RUNS), VORDER_ROUND)


@query("a16_value_features", with_views(f"SELECT {repl(VALUE_ROUND)} FROM vf", VALUE_SQL))
def a16(spark, sf):
    return rnd(value.build_features(ad.ledger(spark, sf), RUNS), VALUE_ROUND)


@query("a16_value_rows_with_clv")
def a16_clv(spark, sf):
    rows = value.build_rows(ad.ledger(spark, sf), RUNS)
    return rounded(rnd(rows, VALUE_ROUND), 4)


@query("a18_conversion_within", with_views("""
SELECT p.prospect_id, coalesce(customer_since < created_at + INTERVAL 60 DAY, false) AS converted
FROM g_prospects p LEFT JOIN g_customers c USING (prospect_id)
WHERE created_at < TIMESTAMP '2001-08-02' - INTERVAL 60 DAY"""))
def a18(spark, sf):
    from tidemark.operators.kpis import conversion_within
    t = ad.ledger(spark, sf)
    return conversion_within(t["prospects"], t["customers"], 60, ad.LEDGER_END).select(
        "prospect_id", "converted")


# ------------------------------------------------------------------ audits
LEAD_TRAIN, LEAD_HOLD = LEAD_RUNS[:1], LEAD_RUNS[3:]
ZERO = "SELECT unnest([{}]) AS check_name, 0::BIGINT AS violations"


def zero_checks(*names: str) -> str:
    return ZERO.format(", ".join(f"'{n}'" for n in names))


@query("a22_lead_leakage_audit", with_views("""
SELECT 'features_only_from_pre_cutoff_rows' AS check_name, 0::BIGINT AS violations
UNION ALL SELECT 'features_unchanged_when_future_rows_removed', 0
UNION ALL SELECT 'no_pipeline_lead_converted_before_cutoff', count(*) FROM lead
  JOIN j_customers USING (prospect_id) WHERE customer_since < run_cutoff
UNION ALL SELECT 'no_customer_linked_rows_in_feature_inputs', sum(n) FROM (
  SELECT count(*) AS n FROM lead l JOIN j_sessions s ON s.prospect_id = l.prospect_id
    AND session_start < run_cutoff WHERE customer_id IS NOT NULL
  UNION ALL SELECT count(*) FROM lead l JOIN j_touches t ON t.prospect_id = l.prospect_id
    AND touch_at < run_cutoff WHERE customer_id IS NOT NULL)
UNION ALL SELECT 'train_labels_end_before_holdout_starts', count(*) FROM lead
  WHERE run_cutoff = TIMESTAMP '2024-01-02' AND run_cutoff + INTERVAL 6 DAY > TIMESTAMP '2024-01-08'
UNION ALL SELECT 'no_single_feature_suspiciously_predictive', 0""", LEAD_SQL))
def a22(spark, sf):
    t = ad.journey(spark, sf)
    data = leads.build_dataset(t, LEAD_RUNS, 6)
    return leads.leakage_audit(t, data, LEAD_RUNS, LEAD_RUNS[2], 6, LEAD_TRAIN, LEAD_HOLD)


@query("a23_churn_leakage_audit", with_views(zero_checks(
    "features_only_from_pre_cutoff_rows", "features_unchanged_when_future_rows_removed",
    "labels_only_from_prediction_window", "every_scored_customer_active_at_cutoff",
    "every_scored_customer_acquired_before_cutoff", "train_labels_end_before_holdout_starts",
    "no_single_feature_suspiciously_predictive")))
def a23(spark, sf):
    t = ad.ledger(spark, sf)
    data = churn.build_dataset(t, RUNS)
    return churn.leakage_audit(t, data, RUNS, PROBE, 90, RUNS[:2], RUNS[2:])


def poisoned(data):
    """Later orders seen by every tenth customer, labels of every seventh turned round."""
    n = F.col("customer_id")
    return data.withColumn("days_since_last_order", F.when(n % 10 == 0, F.col("days_since_last_order") - 1)
                           .otherwise(F.col("days_since_last_order"))).withColumn(
        "churned", F.when(n % 7 == 0, 1 - F.col("churned")).otherwise(F.col("churned")))


@query("a23_churn_audit_poisoned", with_views(f"""
SELECT 'features_only_from_pre_cutoff_rows' AS check_name, count(*) AS violations FROM labelled
  WHERE customer_id % 10 = 0
UNION ALL SELECT 'features_unchanged_when_future_rows_removed', 2 * count(*) FROM labelled
  WHERE customer_id % 10 = 0 AND run_cutoff = TIMESTAMP '{PROBE}'
UNION ALL SELECT 'labels_only_from_prediction_window', count(*) FROM labelled WHERE customer_id % 7 = 0
UNION ALL SELECT 'every_scored_customer_active_at_cutoff', count(*) FROM labelled l WHERE NOT EXISTS (
  SELECT 1 FROM g_orders o WHERE o.customer_id = l.customer_id AND o.order_ts < l.run_cutoff
    AND o.order_ts >= l.run_cutoff - INTERVAL 180 DAY)
UNION ALL SELECT 'every_scored_customer_acquired_before_cutoff', count(*) FROM labelled
  JOIN g_customers USING (customer_id) WHERE customer_since >= run_cutoff
UNION ALL SELECT 'train_labels_end_before_holdout_starts', count(*) FROM labelled
  WHERE run_cutoff IN (TIMESTAMP '{RUNS[0]}', TIMESTAMP '{RUNS[1]}')
    AND run_cutoff + INTERVAL 90 DAY > TIMESTAMP '{RUNS[2]}'
UNION ALL SELECT 'no_single_feature_suspiciously_predictive', 0""", runs_cte(RUNS) + "," + CHURN_LABEL))
def a23_poisoned(spark, sf):
    t = ad.ledger(spark, sf)
    return churn.leakage_audit(t, poisoned(churn.build_dataset(t, RUNS)), RUNS, PROBE, 90, RUNS[:2], RUNS[2:])


@query("a24_value_leakage_audit", with_views(zero_checks(
    "features_only_from_pre_cutoff_rows", "features_unchanged_when_future_rows_removed",
    "labels_only_from_prediction_window", "historical_spend_excludes_target_period",
    "every_scored_customer_acquired_before_cutoff", "train_labels_end_before_holdout_starts",
    "no_single_feature_suspiciously_predictive")))
def a24(spark, sf):
    t = ad.ledger(spark, sf)
    data = value.build_dataset(t, RUNS, clv=False)
    return value.leakage_audit(t, data, RUNS, PROBE, 180, RUNS[:1], RUNS[2:])


@query("a25_pipeline_coverage", with_views("""
SELECT source, count(*) AS first_orders, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6)
  AS share FROM (
  SELECT CASE WHEN created_at >= run_cutoff THEN 'leads_created_in_window'
              WHEN created_at >= run_cutoff - INTERVAL 90 DAY THEN 'open_pipeline'
              ELSE 'older_leads' END AS source
  FROM runs JOIN g_customers ON customer_since >= run_cutoff
       AND customer_since < run_cutoff + INTERVAL 30 DAY
  JOIN g_prospects USING (prospect_id)) GROUP BY 1""",
                                           runs_cte(tw.monthly_runs("1995-03-01", "2001-07-01"))))
def a25(spark, sf):
    t = ad.ledger(spark, sf)
    return rounded(leads.pipeline_coverage(
        t["prospects"], t["customers"], tw.monthly_runs("1995-03-01", "2001-07-01"), 30), 6)

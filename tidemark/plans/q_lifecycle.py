"""Lifecycle, cohort and segment queries on the ledger world."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cols import rounded
from tidemark.functions.lineage import cut
from tidemark.operators import cohorts as co
from tidemark.operators import lifecycle as lc
from tidemark.operators import segments as sg
from tidemark.plans.q_features import CHURN_LABEL, CHURN_SQL, runs_cte
from tidemark.plans.registry import query
from tidemark.sources import adapters as ad
from tidemark.sources.oracle_views import with_views

FIRST, LAST = "1995-01-01", "2001-07-01"  # every whole month of the ledger
W_FIRST, W_LAST = "2000-07-01", "2001-06-01"  # rates: the last twelve months with a next one
RULES = lc.Rules(loyal_min_orders=3)
AS_OF = "2001-07-01"
END = "2001-08-01"

PANEL = f"""
per AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}',
        INTERVAL 1 MONTH)) AS TIMESTAMP) AS period),
po AS (SELECT p.prospect_id, p.acquisition_channel, period, period + INTERVAL 1 MONTH AS as_of,
         p.created_at, o.order_ts, o.net_amount
       FROM per JOIN g_prospects p ON p.created_at < period + INTERVAL 1 MONTH
       LEFT JOIN g_customers c USING (prospect_id)
       LEFT JOIN g_orders o ON o.customer_id = c.customer_id
            AND o.order_ts < period + INTERVAL 1 MONTH),
pa AS (SELECT prospect_id, acquisition_channel, period, as_of, created_at,
         date_diff('day', min(order_ts), as_of)::DOUBLE AS tenure_days,
         date_diff('day', max(order_ts), as_of)::DOUBLE AS idle_days,
         count(*) FILTER (order_ts >= as_of - INTERVAL 365 DAY) AS orders_window,
         count(*) FILTER (order_ts >= period) AS orders,
         coalesce(sum(net_amount) FILTER (order_ts >= period), 0) AS revenue
       FROM po GROUP BY 1, 2, 3, 4, 5),
panel AS (SELECT *, date_diff('day', created_at, as_of)::DOUBLE AS lead_age_days,
    CASE WHEN tenure_days IS NULL THEN 'prospect' WHEN idle_days > 180 THEN 'churned'
         WHEN idle_days > 90 THEN 'at_risk' WHEN tenure_days <= 90 THEN 'new'
         WHEN orders_window >= 3 AND tenure_days > 180 THEN 'loyal' ELSE 'active' END AS state
  FROM pa),
pn AS (SELECT *, lead(state) OVER w AS next_state, lead(orders) OVER w AS next_orders,
         lead(revenue) OVER w AS next_revenue,
         sum(revenue) OVER (PARTITION BY prospect_id ORDER BY period ROWS BETWEEN 1 FOLLOWING
                            AND 3 FOLLOWING) AS revenue_after
       FROM panel WINDOW w AS (PARTITION BY prospect_id ORDER BY period)),
pw AS (SELECT * FROM pn WHERE next_state IS NOT NULL AND period BETWEEN TIMESTAMP '{W_FIRST}'
       AND TIMESTAMP '{W_LAST}')
"""


def panel(spark, sf):
    t = ad.ledger(spark, sf)
    return lc.build_panel(t["prospects"], t["customers"], t["orders"], FIRST, LAST, RULES)


@query("l1_classify", with_views("""
SELECT state, count(*) AS people, round(avg(idle_days), 6) AS mean_idle_days FROM (
  SELECT *, CASE WHEN idle_days > 180 THEN 'churned' WHEN idle_days > 90 THEN 'at_risk'
      WHEN tenure_days <= 90 THEN 'new' WHEN n >= 3 AND tenure_days > 180 THEN 'loyal'
      ELSE 'active' END AS state
  FROM (SELECT customer_id, date_diff('day', min(order_ts), TIMESTAMP '2000-07-01')::DOUBLE
      AS tenure_days, date_diff('day', max(order_ts), TIMESTAMP '2000-07-01')::DOUBLE AS idle_days,
      count(*) FILTER (order_ts >= TIMESTAMP '2000-07-01' - INTERVAL 365 DAY) AS n
    FROM g_orders WHERE order_ts < TIMESTAMP '2000-07-01' GROUP BY 1)) GROUP BY 1"""))
def l1(spark, sf):
    from tidemark.functions.cols import days_between, ts
    h = lc.order_history(ad.ledger(spark, sf)["orders"], "2000-07-01", 365)
    at = ts("2000-07-01")
    tenure, idle = days_between("first_ts", at), days_between("last_ts", at)
    return rounded(h.groupBy(lc.classify(tenure, idle, F.col("orders_window"), RULES)
                             .alias("state")).agg(F.count(F.lit(1)).alias("people"),
                                                  F.avg(idle).alias("mean_idle_days")), 6)


@query("l2_people_frame", with_views("""
SELECT p.prospect_id, created_at, p.acquisition_channel, customer_id, customer_since
FROM j_prospects p LEFT JOIN j_customers USING (prospect_id)"""))
def l2(spark, sf):
    t = ad.journey(spark, sf)
    return lc.people_frame(t["prospects"], t["customers"])


@query("l3_order_history", with_views("""
SELECT customer_id, min(order_ts) AS first_ts, max(order_ts) AS last_ts,
  count(*) FILTER (order_ts >= TIMESTAMP '2000-07-01' - INTERVAL 365 DAY) AS orders_window
FROM g_orders WHERE order_ts < TIMESTAMP '2000-07-01' GROUP BY 1"""))
def l3(spark, sf):
    return lc.order_history(ad.ledger(spark, sf)["orders"], "2000-07-01", 365)


@query("l4_assign_states", with_views(f"""
SELECT prospect_id, state, tenure_days, idle_days, lead_age_days, orders_window FROM panel
WHERE as_of = TIMESTAMP '{AS_OF}'""", PANEL))
def l4(spark, sf):
    t = ad.ledger(spark, sf)
    s = lc.assign_states(lc.people_frame(t["prospects"], t["customers"]), t["orders"], AS_OF,
                         RULES)
    return s.where("state is not null").select("prospect_id", "state", "tenure_days", "idle_days",
                                               "lead_age_days", "orders_window")


@query("l5_person_month_panel", with_views("""
SELECT prospect_id, CAST(period AS DATE) AS period, state, orders, round(revenue, 4) AS revenue,
  orders_window, tenure_days, idle_days, lead_age_days FROM panel""", PANEL))
def l5(spark, sf):
    return rounded(panel(spark, sf).select(
        "prospect_id", "period", "state", "orders", "revenue", "orders_window", "tenure_days",
        "idle_days", "lead_age_days"), 4)


COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in lc.STATES)


@query("l6_state_counts", with_views(
    f"SELECT CAST(period AS DATE) AS period, {COUNTS} FROM panel GROUP BY 1", PANEL))
def l6(spark, sf):
    return lc.state_counts(panel(spark, sf))


@query("l6_state_snapshot", with_views(f"""
SELECT period, prospect + c AS people, c AS customers, """ + ", ".join(
    f"round(CASE WHEN c > 0 THEN {s} / CAST(c AS DOUBLE) END, 6) AS share_{s}"
    for s in lc.CUSTOMER_STATES) + f""" FROM (SELECT *, "new" + active + loyal + at_risk + churned
  AS c FROM (SELECT CAST(period AS DATE) AS period, {COUNTS} FROM panel GROUP BY 1))
WHERE period IN (DATE '1995-12-01', DATE '1996-12-01')""", PANEL))
def l6s(spark, sf):
    return rounded(lc.state_snapshot(lc.state_counts(panel(spark, sf)),
                                     ["1995-12-01", "1996-12-01"]), 6)


GRID = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in lc.STATES) + "]) AS {})"
TC = PANEL + f""",
tc AS (SELECT from_state, to_state, count(period) AS people
  FROM {GRID.format('from_state')} CROSS JOIN {GRID.format('to_state')}
  LEFT JOIN pw ON state = from_state AND next_state = to_state GROUP BY 1, 2)"""


@query("l7_transition_counts", with_views("SELECT * FROM tc", TC))
def l7(spark, sf):
    return lc.transition_counts(panel(spark, sf), W_FIRST, W_LAST)


@query("l8_transition_matrix", with_views("""
SELECT from_state, to_state, round(CASE WHEN sum(people) OVER (PARTITION BY from_state) > 0
  THEN people / CAST(sum(people) OVER (PARTITION BY from_state) AS DOUBLE) END, 6) AS probability
FROM tc""", TC))
def l8(spark, sf):
    return rounded(lc.transition_matrix(lc.transition_counts(panel(spark, sf), W_FIRST, W_LAST)),
                   6)


@query("l9_transitions_by_period", with_views("""
SELECT CAST(period AS DATE) AS from_period, CAST(as_of AS DATE) AS to_period, state AS from_state,
  next_state AS to_state, count(*) AS people FROM pn WHERE next_state IS NOT NULL
GROUP BY ALL""", PANEL))
def l9(spark, sf):
    return lc.transitions_by_period(panel(spark, sf))


@query("l10_entries", with_views("""
SELECT period, state, count(*) AS people FROM (SELECT prospect_id, CAST(min(period) AS DATE)
  AS period, arg_min(state, period) AS state FROM panel GROUP BY 1) GROUP BY 1, 2""", PANEL))
def l10(spark, sf):
    return lc.entries(panel(spark, sf))


@query("l11_impossible_transitions", with_views("SELECT * FROM tc WHERE " + " OR ".join(
    f"(from_state = '{a}' AND to_state = '{b}')"
    for a, b in lc.impossible_transitions(RULES)), TC))
def l11(spark, sf):
    return lc.observed_impossible(lc.transition_counts(panel(spark, sf), W_FIRST, W_LAST), RULES)


DP = PANEL + ",\ndr AS (" + "\nUNION ALL ".join(
    f"SELECT '{k}' AS decision_point, prospect_id, acquisition_channel, period, revenue_after, "
    f"next_state IN {fav + ('_',)} AS favourable FROM pn WHERE state = '{o}' AND next_state IN "
    f"{fav + bad}" for k, o, fav, bad in lc.DECISION_POINTS) + f"""),
dw AS (SELECT decision_point, count(*) AS n, count(*) FILTER (favourable) AS k FROM dr
  WHERE period BETWEEN TIMESTAMP '{W_FIRST}' AND TIMESTAMP '{W_LAST}' GROUP BY 1),
df AS (SELECT decision_point, count(*) AS fn, avg(revenue_after) FILTER (favourable) AS good,
  avg(revenue_after) FILTER (NOT favourable) AS bad FROM dr
  WHERE period + INTERVAL 3 MONTH <= TIMESTAMP '{LAST}' GROUP BY 1)"""
Z = "1.959963984540054::DOUBLE"
CENTRE = f"((k / CAST(n AS DOUBLE) + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n))"
HALF = (f"({Z} * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + {Z} * {Z} / "
        f"(4.0::DOUBLE * n * n)) / (1 + {Z} * {Z} / n))")


@query("l12_wilson_interval", with_views(f"""
SELECT run_cutoff, n, k, round({CENTRE} - {HALF}, 6) AS low, round({CENTRE} + {HALF}, 6) AS high
FROM (SELECT run_cutoff, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM scored GROUP BY 1)"""))
def l12(spark, sf):
    t = ad.score_frame(spark, sf).groupBy("run_cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    low, high = lc.wilson(F.col("k"), F.col("n"))
    return rounded(t.withColumn("low", low).withColumn("high", high), 6)


@query("l13_decision_rows", with_views(f"""
SELECT decision_point, prospect_id, CAST(period AS DATE) AS period, favourable,
  round(revenue_after, 4) AS revenue_after FROM dr
WHERE period + INTERVAL 3 MONTH <= TIMESTAMP '{LAST}'""", DP))
def l13(spark, sf):
    return rounded(lc.decision_rows(panel(spark, sf), LAST, 3).select(
        "decision_point", "prospect_id", "period", "favourable", "revenue_after"), 4)


@query("l14_decision_points", with_views(f"""
SELECT decision_point, n AS resolved, k AS favourable_n, n - k AS unfavourable_n,
  round(k / CAST(n AS DOUBLE), 6) AS favourable_rate, round({CENTRE} - {HALF}, 6) AS rate_ci_low,
  round({CENTRE} + {HALF}, 6) AS rate_ci_high,
  round((n - k) / 12.0::DOUBLE, 6) AS unfavourable_per_month, fn AS follow_up_resolved,
  round(good, 3) AS revenue_after_favourable, round(bad, 3) AS revenue_after_unfavourable,
  round(good - bad, 3) AS revenue_gap, round((n - k) * (good - bad), 3) AS revenue_gap_per_year
FROM dw JOIN df USING (decision_point)""", DP))
def l14(spark, sf):
    t = lc.decision_point_table(panel(spark, sf), W_FIRST, W_LAST, LAST, 12, 3)
    three = [c for c in t.columns if c.startswith("revenue")]
    return t.select(*[F.round(c, 3 if c in three else 6).alias(c) if dict(t.dtypes)[c] == "double"
                      else F.col(c) for c in t.columns])


@query("l15_decision_points_by_group", with_views(f"""
SELECT decision_point, acquisition_channel, n AS resolved, k AS favourable_n,
  round(k / CAST(n AS DOUBLE), 6) AS favourable_rate, round({CENTRE} - {HALF}, 6) AS rate_ci_low,
  round({CENTRE} + {HALF}, 6) AS rate_ci_high
FROM (SELECT decision_point, acquisition_channel, count(*) AS n, count(*) FILTER (favourable) AS k
  FROM dr WHERE period BETWEEN TIMESTAMP '{W_FIRST}' AND TIMESTAMP '{W_LAST}' GROUP BY 1, 2)""",
                                                  DP))
def l15(spark, sf):
    return rounded(lc.decision_points_by_group(panel(spark, sf), W_FIRST, W_LAST, LAST,
                                               "acquisition_channel"), 6)


def bucket_sql(col: str, edges) -> str:
    whens = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b == float("inf"):
            whens.append(f"WHEN {col} >= {a} THEN '{a}+'")
        else:
            whens.append(f"WHEN {col} >= {a} AND {col} < {b} THEN '{a}-{b}'")
    return "CASE " + " ".join(whens) + " END"


@query("l16_repurchase_by_recency", with_views(f"""
SELECT {bucket_sql('idle_days', lc.RECENCY_EDGES)} AS days_since_last_order,
  count(*) AS customer_months, count(*) FILTER (next_orders > 0) AS buyers,
  round(avg(next_revenue), 4) AS next_month_revenue,
  round(count(*) FILTER (next_orders > 0) / CAST(count(*) AS DOUBLE), 6) AS repurchase_rate
FROM pw WHERE state <> 'prospect' GROUP BY 1""", PANEL))
def l16(spark, sf):
    t = lc.repurchase_by_recency(panel(spark, sf), W_FIRST, W_LAST)
    return t.withColumn("next_month_revenue", F.round("next_month_revenue", 4)).withColumn(
        "repurchase_rate", F.round("repurchase_rate", 6))


@query("l17_conversion_by_lead_age", with_views(f"""
SELECT {bucket_sql('lead_age_days', lc.LEAD_AGE_EDGES)} AS lead_age_days,
  count(*) AS prospect_months, count(*) FILTER (next_state = 'new') AS conversions,
  round(count(*) FILTER (next_state = 'new') / CAST(count(*) AS DOUBLE), 6) AS conversion_rate
FROM pn WHERE state = 'prospect' AND next_state IS NOT NULL GROUP BY 1""", PANEL))
def l17(spark, sf):
    return rounded(lc.conversion_by_lead_age(panel(spark, sf), FIRST, LAST), 6)


@query("l18_state_value", with_views("""
SELECT state, count(*) AS customer_months,
  round(avg(CASE WHEN next_orders > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS next_month_purchase_rate,
  round(avg(next_revenue), 4) AS next_month_revenue_per_customer,
  round(sum(next_revenue), 3) AS next_month_revenue,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share_of_customer_months,
  round(sum(next_revenue) / sum(sum(next_revenue)) OVER (), 6) AS share_of_next_month_revenue
FROM pw WHERE state <> 'prospect' GROUP BY 1""", PANEL))
def l18(spark, sf):
    t = lc.state_value(panel(spark, sf), W_FIRST, W_LAST)
    digits = {"next_month_revenue": 3, "next_month_revenue_per_customer": 4}
    return t.select(*[F.round(c, digits.get(c, 6)).alias(c) if dict(t.dtypes)[c] == "double"
                      else F.col(c) for c in t.columns])


COHORT = f"""
cc AS (SELECT customer_id, acquisition_channel, year(customer_since) * 12 + month(customer_since)
         - 1 AS ci FROM g_customers WHERE customer_since < TIMESTAMP '{END}'),
cz AS (SELECT ci, count(*) AS cohort_size FROM cc GROUP BY 1),
cg AS (SELECT ci, cohort_size, k, ci + k <= 2001 * 12 + 6 AS observed
       FROM cz, (SELECT unnest(generate_series(0, 78)) AS k)),
ca AS (SELECT ci, year(order_ts) * 12 + month(order_ts) - 1 - ci AS k,
         count(DISTINCT customer_id) AS buyers, sum(net_amount) AS revenue
       FROM g_orders JOIN cc USING (customer_id) WHERE order_ts < TIMESTAMP '{END}' GROUP BY 1, 2),
ct AS (SELECT make_date(CAST(ci // 12 AS INT), CAST(ci % 12 + 1 AS INT), 1) AS cohort, k, observed,
         cohort_size, CASE WHEN observed THEN coalesce(buyers, 0) END AS buyers,
         CASE WHEN observed THEN coalesce(revenue, 0) END AS revenue
       FROM cg LEFT JOIN ca USING (ci, k))
"""


def cohort_table(spark, sf, by=()):
    t = ad.ledger(spark, sf)
    from tidemark.operators.timewin import events_before
    return co.cohort_retention(events_before(t["customers"], "customer_since", END), t["orders"],
                               "1995-01-01", END, by)


@query("l19_cohort_retention", with_views("""
SELECT cohort, k AS months_since_acquisition, observed, cohort_size, buyers,
  round(buyers / CAST(cohort_size AS DOUBLE), 6) AS retention, round(revenue, 3) AS revenue,
  (revenue / cohort_size)::FLOAT::DOUBLE AS revenue_per_customer,
  (CASE WHEN observed THEN sum(revenue / cohort_size) OVER (PARTITION BY cohort ORDER BY k)
   END)::FLOAT::DOUBLE AS cumulative_revenue_per_customer FROM ct""", COHORT))
def l19(spark, sf):
    t = cohort_table(spark, sf)
    # Money per head often ends in an exact 5, so it is published in single precision, not rounded.
    single = ("revenue_per_customer", "cumulative_revenue_per_customer")
    return t.select(*[F.col(c).cast("float").cast("double").alias(c) if c in single
                      else F.round(c, 3 if c == "revenue" else 6).alias(c)
                      if dict(t.dtypes)[c] == "double" else F.col(c) for c in t.columns])


@query("l20_pooled_retention", with_views("""
SELECT k AS months_since_acquisition, count(DISTINCT cohort) AS cohorts, min(cohort) AS
  first_cohort, max(cohort) AS last_cohort, CAST(sum(cohort_size) AS BIGINT) AS customers,
  CAST(sum(buyers) AS BIGINT) AS buyers, round(sum(revenue), 1) AS revenue,
  round(sum(buyers) / CAST(sum(cohort_size) AS DOUBLE), 6) AS retention,
  round(sum(revenue) / sum(cohort_size), 5) AS revenue_per_customer,
  round(sum(sum(revenue) / sum(cohort_size)) OVER (ORDER BY k), 5)
    AS cumulative_revenue_per_customer
FROM (SELECT *, max(k) FILTER (observed) OVER (PARTITION BY cohort) AS seen FROM ct)
WHERE seen >= 12 AND k <= 12 GROUP BY k""", COHORT))
def l20(spark, sf):
    t = co.pooled_retention(cohort_table(spark, sf), 12)
    d = {"revenue": 1, "retention": 6}  # sums can end on half a cent
    return t.select(*[F.round(c, d.get(c, 5)).alias(c) if dict(t.dtypes)[c] == "double"
                      else F.col(c) for c in t.columns])


PROF_RUN = ["2000-07-01"]
PROFILE = CHURN_SQL.replace(runs_cte(["2000-01-01", "2000-04-01", "2000-07-01", "2000-10-01"]),
                            runs_cte(PROF_RUN)) + """,
fo AS (SELECT customer_id,
    date_diff('day', min(order_ts) FILTER (order_ts < TIMESTAMP '2000-07-01'),
              TIMESTAMP '2000-07-01')::DOUBLE AS tenure_days,
    date_diff('day', max(order_ts) FILTER (order_ts < TIMESTAMP '2000-07-01'),
              TIMESTAMP '2000-07-01')::DOUBLE AS idle_days,
    count(*) FILTER (order_ts >= TIMESTAMP '2000-07-01' - INTERVAL 365 DAY AND
                     order_ts < TIMESTAMP '2000-07-01') AS orders_365d,
    round(coalesce(sum(net_amount) FILTER (order_ts >= TIMESTAMP '2000-07-01' - INTERVAL 365 DAY
                   AND order_ts < TIMESTAMP '2000-07-01'), 0), 4) AS revenue_365d,
    count(*) FILTER (order_ts < TIMESTAMP '2000-07-01') AS orders_total,
    avg(net_amount) FILTER (order_ts < TIMESTAMP '2000-07-01') AS avg_order_value,
    count(*) FILTER (order_ts >= TIMESTAMP '2000-07-01') AS next_orders,
    coalesce(sum(net_amount) FILTER (order_ts >= TIMESTAMP '2000-07-01'), 0) AS next_revenue
  FROM g_orders WHERE order_ts < TIMESTAMP '2000-07-01' + INTERVAL 90 DAY GROUP BY 1),
pb AS (SELECT c.customer_id, c.acquisition_channel, fo.* EXCLUDE (customer_id),
    CASE WHEN idle_days > 180 THEN 'churned' WHEN idle_days > 90 THEN 'at_risk'
         WHEN fo.tenure_days <= 90 THEN 'new'
         WHEN orders_365d >= 3 AND fo.tenure_days > 180 THEN 'loyal' ELSE 'active' END AS state,
    coalesce(browse_sessions_30d, 0) AS browse_sessions_30d,
    coalesce(browse_sessions_90d, 0) AS browse_sessions_90d,
    coalesce(emails_received_90d, 0) AS emails_received_90d,
    coalesce(email_open_rate_90d, 0) AS email_open_rate_90d,
    coalesce(email_clicks_90d, 0) AS email_clicks_90d,
    coalesce(plus_member, 0) AS plus_member, coalesce(plus_cancelled_180d, 0)
      AS plus_cancelled_180d
  FROM g_customers c JOIN fo USING (customer_id) LEFT JOIN csf USING (customer_id)
  LEFT JOIN cef USING (customer_id) LEFT JOIN cmf USING (customer_id)
  WHERE c.customer_since < TIMESTAMP '2000-07-01'),
q1 AS (SELECT *, (rank() OVER (ORDER BY idle_days DESC) + (count(*) OVER (PARTITION BY idle_days)
      - 1) / 2.0::DOUBLE) / count(*) OVER () AS rp,
    (rank() OVER (ORDER BY orders_365d) + (count(*) OVER (PARTITION BY orders_365d) - 1)
      / 2.0::DOUBLE) / count(*) OVER () AS fp,
    (rank() OVER (ORDER BY revenue_365d) + (count(*) OVER (PARTITION BY revenue_365d) - 1)
      / 2.0::DOUBLE) / count(*) OVER () AS mp FROM pb),
q2 AS (SELECT *, CAST(greatest(1, least(5, ceil(rp * 5))) AS INT) AS r_score,
    CAST(greatest(1, least(5, ceil(fp * 5))) AS INT) AS f_score,
    CAST(greatest(1, least(5, ceil(mp * 5))) AS INT) AS m_score FROM q1),
q3 AS (SELECT *, CAST(ceil((f_score + m_score) / 2.0::DOUBLE) AS INT) AS fm_score FROM q2),
prof AS (SELECT *, CASE WHEN r_score >= 4 AND fm_score >= 4 THEN 'champions'
    WHEN (r_score >= 4 AND fm_score = 3) OR (r_score = 3 AND fm_score >= 3) THEN 'loyalists'
    WHEN r_score >= 4 THEN 'promising' WHEN r_score = 3 THEN 'needs_attention'
    WHEN fm_score >= 4 THEN 'cannot_lose' WHEN fm_score = 3 THEN 'slipping'
    ELSE 'hibernating' END AS rfm_segment FROM q3)
"""


def profile(spark, sf):
    return sg.customer_profile(ad.ledger(spark, sf), PROF_RUN[0], RULES)


@query("l21_quintile_scores", with_views(
    "SELECT customer_id, r_score, f_score, m_score FROM prof", PROFILE))
def l21(spark, sf):
    return profile(spark, sf).select("customer_id", "r_score", "f_score", "m_score")


@query("l22_rfm_segments", with_views("""
SELECT rfm_segment, r_score, fm_score, count(*) AS customers FROM prof GROUP BY ALL""", PROFILE))
def l22(spark, sf):
    return profile(spark, sf).groupBy("rfm_segment", "r_score", "fm_score").agg(
        F.count(F.lit(1)).alias("customers"))


PROF_COLS = ["customer_id", "acquisition_channel", "state", "tenure_days", "idle_days",
             "orders_365d", "revenue_365d", "orders_total", "avg_order_value",
             "browse_sessions_30d", "browse_sessions_90d", "emails_received_90d",
             "email_open_rate_90d", "plus_member", "plus_cancelled_180d", "rfm_segment",
             "next_orders", "next_revenue"]
PROF_ROUND = {"revenue_365d": 4, "avg_order_value": 7, "email_open_rate_90d": 6,
              "next_revenue": 4}


@query("l23_customer_profile", with_views("SELECT " + ", ".join(
    f"round({c}, {PROF_ROUND[c]}) AS {c}" if c in PROF_ROUND else c for c in PROF_COLS)
    + " FROM prof", PROFILE))
def l23(spark, sf):
    from tidemark.plans.q_features import rnd
    return rnd(profile(spark, sf).select(*PROF_COLS), PROF_ROUND)


def summary_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS customers, round(sum(revenue_365d), 3) AS revenue_365d,
  round(avg(orders_365d), 6) AS orders_365d, median(idle_days) AS median_days_since_order,
  round(avg(avg_order_value), 4) AS avg_order_value,
  round(avg(browse_sessions_90d), 6) AS browse_sessions_90d,
  round(avg(email_open_rate_90d) FILTER (emails_received_90d > 0), 6) AS email_open_rate_90d,
  round(avg(plus_member), 6) AS plus_member_rate,
  round(avg(CASE WHEN next_orders > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS next_purchase_rate,
  round(sum(next_revenue), 3) AS next_revenue,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share_of_customers,
  round(sum(revenue_365d) / sum(sum(revenue_365d)) OVER (), 6) AS share_of_revenue_365d,
  round(sum(next_revenue) / sum(sum(next_revenue)) OVER (), 6) AS share_of_next_revenue,
  round(sum(revenue_365d) / count(*), 4) AS revenue_365d_per_customer,
  round(sum(next_revenue) / count(*), 4) AS next_revenue_per_customer FROM prof GROUP BY 1"""


SUM_ROUND = {"revenue_365d": 3, "next_revenue": 3, "avg_order_value": 4,
             "revenue_365d_per_customer": 4, "next_revenue_per_customer": 4}


def _summary(df, by):
    t = sg.segment_summary(df, by)
    return t.select(*[F.round(c, SUM_ROUND.get(c, 6)).alias(c) if dict(t.dtypes)[c] == "double"
                      else F.col(c) for c in t.columns])


@query("l24_segment_summary", with_views(summary_sql("rfm_segment"), PROFILE))
def l24(spark, sf):
    return _summary(profile(spark, sf), "rfm_segment")


@query("l24_state_summary", with_views(summary_sql("state"), PROFILE))
def l24s(spark, sf):
    return _summary(profile(spark, sf), "state")


@query("l25_state_segment_crosstab", with_views("SELECT state, " + ", ".join(
    f"count(*) FILTER (rfm_segment = '{s}') AS {s}" for s in sg.SEGMENTS)
    + " FROM prof GROUP BY 1", PROFILE))
def l25(spark, sf):
    return sg.crosstab(profile(spark, sf), "state", "rfm_segment", sg.SEGMENTS)


@query("l26_integrity_audit", with_views("""
SELECT unnest(['every_person_has_one_valid_state_once_created', 'every_created_person_is_present',
  'people_never_leave_the_panel', 'transitions_out_of_each_state_sum_to_its_population',
  'no_transition_the_state_rules_forbid', 'states_unchanged_when_later_orders_removed',
  'segment_profile_uses_panel_states', 'cohort_denominator_fixed_at_acquisition_size',
  'unobserved_cohort_months_missing_not_zero', 'pooled_curve_uses_one_fixed_cohort_set'])
  AS check_name, 0::BIGINT AS violations"""))
def l26(spark, sf):
    from tidemark.operators.timewin import events_before
    t = dict(ad.ledger(spark, sf))
    t["customers"], t["prospects"] = cut(t["customers"]), cut(t["prospects"])  # read by every check
    cust = events_before(t["customers"], "customer_since", END)
    p = lc.build_panel(t["prospects"], t["customers"], t["orders"], FIRST, LAST, RULES)
    table = cut(co.cohort_retention(cust, t["orders"], "1995-01-01", END))
    prof = sg.customer_profile(t, AS_OF, RULES)
    return lc.integrity_audit(t["prospects"], cust, t["orders"], p, table,
                              co.pooled_retention(table, 12), prof, AS_OF, FIRST, LAST, RULES)


@query("l27_state_mix", with_views("""
SELECT period, customers, state, position, cnt AS count,
  round(CASE WHEN customers > 0 THEN cnt / CAST(customers AS DOUBLE) END, 6) AS share,
  round(CASE WHEN customers > 0 THEN cnt / CAST(customers AS DOUBLE) END, 6) AS value
FROM (SELECT CAST(period AS DATE) AS period, s.state, s.position,
        count(*) FILTER (panel.state = s.state) AS cnt,
        count(*) FILTER (panel.state <> 'prospect') AS customers
      FROM panel, (SELECT unnest(['new', 'active', 'loyal', 'at_risk', 'churned']) AS state,
                   unnest([0, 1, 2, 3, 4]) AS position) s GROUP BY 1, 2, 3)""", PANEL))
def l27(spark, sf):
    return rounded(lc.state_mix(lc.state_counts(panel(spark, sf)), True), 6)


@query("l27_largest_channels", with_views(f"""
SELECT acquisition_channel, count(*) AS customers FROM g_customers
WHERE customer_since < TIMESTAMP '2000-08-01' GROUP BY 1
ORDER BY customers DESC, acquisition_channel LIMIT 3"""))
def l27c(spark, sf):
    p = co.pooled_retention(cohort_table(spark, sf, ["acquisition_channel"]), 12,
                            ["acquisition_channel"])
    return lc.largest_channels(p, 3)

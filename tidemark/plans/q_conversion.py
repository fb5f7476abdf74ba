"""Funnel and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cols import rounded, ts
from tidemark.operators import experiment as ex
from tidemark.operators import funnel as fn
from tidemark.plans.registry import query
from tidemark.schema import STAGES
from tidemark.sources import adapters as ad
from tidemark.sources.oracle_views import with_views

START, END = "2024-01-05", "2024-01-26"
EXP, EXP_START, EXP_END = "EXP001", "2024-01-02", "2024-01-06"
DIMS = ["device_type", "platform", "traffic_source", "visit_number"]

DEPTH = """
sd AS (SELECT session_id, max(CASE WHEN stage_number = r THEN r ELSE 0 END) AS depth,
              max(stage_number) AS deepest
       FROM (SELECT session_id, stage_number, row_number() OVER (PARTITION BY session_id
                    ORDER BY stage_number) AS r
             FROM (SELECT DISTINCT session_id, stage_number FROM j_funnel)) GROUP BY 1)
"""
FRAME = DEPTH + """,
vn AS (SELECT session_id, CASE row_number() OVER (PARTITION BY prospect_id
              ORDER BY session_start, session_id) WHEN 1 THEN '1st visit' WHEN 2 THEN '2nd visit'
              ELSE '3rd+ visit' END AS visit_number FROM j_sessions WHERE customer_id IS NULL),
fr AS (SELECT s.*, depth, visit_number,
              CASE WHEN customer_id IS NULL THEN 'prospect' ELSE 'customer' END AS visitor_type
       FROM j_sessions s JOIN sd USING (session_id) LEFT JOIN vn USING (session_id)
       WHERE session_start >= TIMESTAMP '2024-01-05' AND session_start < TIMESTAMP '2024-01-26'
         AND depth >= 1)
"""


def stage_sql(src: str, key: str | None) -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    lst = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
    return f"""
SELECT {k}stage_number, list_extract({lst}, CAST(stage_number AS INT)) AS stage, reached,
  round(reached / CAST(first_value(reached) OVER w AS DOUBLE), 6) AS share_of_start,
  round(reached / CAST(coalesce(lag(reached) OVER w, reached) AS DOUBLE), 6) AS step_conversion,
  coalesce(lag(reached) OVER w, reached) - reached AS lost_at_step,
  round((coalesce(lag(reached) OVER w, reached) - reached) / CAST(max(reached) OVER p
        - min(reached) OVER p AS DOUBLE), 6) AS share_of_all_losses
FROM (SELECT {k}stage_number, count(*) FILTER (depth >= stage_number) AS reached
      FROM {src}, (SELECT unnest([1, 2, 3, 4, 5]::BIGINT[]) AS stage_number) GROUP BY ALL)
WINDOW w AS ({part}ORDER BY stage_number), p AS ({part.strip()})"""


SEG = FRAME + ",\nsg AS (" + "\nUNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS level, depth FROM fr WHERE visitor_type = 'prospect' "
    f"AND {d} IS NOT NULL" for d in DIMS) + "),\nsf AS (SELECT dimension, level, " + ", ".join(
    f"count(*) FILTER (depth >= {k}) AS r{k}" for k in range(1, 6)) + " FROM sg GROUP BY 1, 2)"


def _frame(spark, sf):
    t = ad.journey(spark, sf)
    return fn.session_frame(t["sessions"], t["funnel_events"], START, END)


def _prospects(spark, sf):
    return _frame(spark, sf).where("visitor_type = 'prospect'")


@query("c1_session_depth", with_views("""
SELECT session_id, CAST(depth AS BIGINT) AS depth FROM sd""", DEPTH))
def c1(spark, sf):
    d = fn.session_depth(ad.journey(spark, sf)["funnel_events"])
    return d.select("session_id", F.col("depth").cast("bigint").alias("depth"))


@query("c2_session_frame", with_views("""
SELECT session_id, CAST(depth AS BIGINT) AS depth, visitor_type, visit_number FROM fr""", FRAME))
def c2(spark, sf):
    return _frame(spark, sf).select("session_id", F.col("depth").cast("bigint").alias("depth"),
                                    "visitor_type", "visit_number")


@query("c3_stage_table", with_views(stage_sql("fr", "visitor_type"), FRAME))
def c3(spark, sf):
    return rounded(fn.stage_table(_frame(spark, sf), ["visitor_type"]), 6)


@query("c4_segment_funnel", with_views("SELECT dimension, level, r1 AS sessions, " + ", ".join(
    f"r{k} AS reached_{s}" for k, s in enumerate(STAGES, 1)) + ", " + ", ".join(
    f"round(CASE WHEN r{k} > 0 THEN r{k + 1} / CAST(r{k} AS DOUBLE) END, 6) AS "
    f"\"rate_{STAGES[k - 1]}->{STAGES[k]}\"" for k in range(1, 5))
    + ", round(r5 / CAST(r1 AS DOUBLE), 6) AS session_to_purchase FROM sf", SEG))
def c4(spark, sf):
    return rounded(fn.segment_funnel(_prospects(spark, sf), DIMS), 6)


_RATE = [f"(r{k + 1} / CAST(r{k} AS DOUBLE))" for k in range(1, 5)]


@query("c5_dropoff_opportunity", with_views("\nUNION ALL ".join(f"""
SELECT l.dimension, l.level, 'desktop' AS reference, '{fn.STEPS[k - 1]}' AS step,
  l.r{k} AS entering, round(l.r{k + 1} / CAST(l.r{k} AS DOUBLE), 6) AS level_rate,
  round(f.r{k + 1} / CAST(f.r{k} AS DOUBLE), 6) AS reference_rate,
  round(f.r{k + 1} / CAST(f.r{k} AS DOUBLE) - l.r{k + 1} / CAST(l.r{k} AS DOUBLE), 6) AS rate_gap,
  round(l.r{k} * (f.r{k + 1} / CAST(f.r{k} AS DOUBLE) - l.r{k + 1} / CAST(l.r{k} AS DOUBLE)), 6)
    AS extra_step_completions,
  round(l.r{k} * (f.r{k + 1} / CAST(f.r{k} AS DOUBLE) - l.r{k + 1} / CAST(l.r{k} AS DOUBLE))
    * {'1' if k == 4 else f'(CASE WHEN l.r4 > 0 THEN l.r5 / CAST(l.r{k + 1} AS DOUBLE) END)'}, 6)
    AS purchase_equivalents
FROM sf l JOIN sf f ON f.dimension = l.dimension AND f.level = 'desktop'
WHERE l.dimension = 'device_type' AND l.level <> 'desktop'""" for k in range(1, 5)), SEG))
def c5(spark, sf):
    seg = fn.segment_funnel(_prospects(spark, sf), DIMS)
    return rounded(fn.dropoff_opportunity(seg, "device_type", "desktop"), 6)


COHORT = DEPTH + """,
pf AS (SELECT p.prospect_id, acquisition_channel, CAST(coalesce(max(depth), 0) AS BIGINT) AS depth
  FROM j_prospects p LEFT JOIN j_sessions s ON s.prospect_id = p.prospect_id
    AND session_start >= created_at AND session_start < created_at + INTERVAL 7 DAY
  LEFT JOIN sd USING (session_id)
  WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-10'
  GROUP BY 1, 2)
"""


@query("c6_prospect_funnel", with_views("SELECT * FROM pf", COHORT))
def c6(spark, sf):
    t = ad.journey(spark, sf)
    return fn.prospect_funnel(t["prospects"], t["sessions"], t["funnel_events"], "2024-01-01",
                              "2024-01-10", 7).select("prospect_id", "acquisition_channel",
                                                      F.col("depth").cast("bigint")
                                                      .alias("depth"))


@query("c7_weakest_segment", with_views("""
SELECT step, dimension, level, round(rate, 6) AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY step ORDER BY enough DESC, rate, dimension, level) AS r
  FROM (""" + "\nUNION ALL ".join(
    f"SELECT '{fn.STEPS[k - 1]}' AS step, dimension, level, r{k} >= 50 AS enough, "
    f"r{k + 1} / CAST(r{k} AS DOUBLE) AS rate FROM sf WHERE r{k} > 0" for k in range(1, 5))
    + ")) WHERE r = 1", SEG))
def c7(spark, sf):
    seg = fn.segment_funnel(_prospects(spark, sf), DIMS)
    return rounded(fn.step_highlights(seg, min_entering=50), 6)


@query("c7_loss_summary", with_views("""
SELECT arg_max(step, (lost, -k)) AS largest_loss_step, arg_min(step, (conv, k))
       AS lowest_step_conversion FROM (""" + "\nUNION ALL ".join(
    f"SELECT {k} AS k, '{fn.STEPS[k - 1]}' AS step, count(*) FILTER (depth >= {k}) - "
    f"count(*) FILTER (depth >= {k + 1}) AS lost, count(*) FILTER (depth >= {k + 1}) / "
    f"CAST(count(*) FILTER (depth >= {k}) AS DOUBLE) AS conv FROM fr "
    "WHERE visitor_type = 'prospect'" for k in range(1, 5)) + ")", FRAME))
def c7l(spark, sf):
    return fn.loss_summary(fn.stage_table(_prospects(spark, sf)))


@query("c8_largest_segments_first", with_views("""
SELECT level, r1 AS sessions FROM sf WHERE dimension = 'traffic_source'
ORDER BY sessions DESC, level""", SEG))
def c8(spark, sf):
    seg = fn.segment_funnel(_prospects(spark, sf), DIMS).where("dimension = 'traffic_source'")
    return seg.orderBy(F.desc("sessions"), "level").select("level", "sessions")


@query("v24_funnel_integrity", with_views("""
SELECT 'sessions' AS defect, (SELECT count(*) FROM j_sessions) AS rows
UNION ALL SELECT 'events', count(*) FROM j_funnel
UNION ALL SELECT 'orphan_events', count(*) FROM j_funnel WHERE session_id NOT IN
  (SELECT session_id FROM j_sessions)
UNION ALL SELECT 'sessions_without_events', count(*) FROM j_sessions WHERE session_id NOT IN
  (SELECT session_id FROM j_funnel)
UNION ALL SELECT 'sessions_missing_session_start', count(*) FILTER (depth = 0) FROM sd
UNION ALL SELECT 'sessions_with_skipped_stages', count(*) FILTER (deepest > depth) FROM sd
UNION ALL SELECT 'duplicate_stage_events', CAST(sum(n - 1) AS BIGINT) FROM
  (SELECT count(*) AS n FROM j_funnel GROUP BY session_id, stage_number)
UNION ALL SELECT 'out_of_order_events', count(*) FILTER (event_ts < prev) FROM
  (SELECT event_ts, lag(event_ts) OVER (PARTITION BY session_id ORDER BY stage_number, event_ts)
          AS prev FROM j_funnel)""", DEPTH))
def v24(spark, sf):
    t = ad.journey(spark, sf)
    return fn.funnel_integrity(t["sessions"], t["funnel_events"])


@query("v25_monotone_funnel", with_views("""
SELECT visitor_type, count(*) FILTER (reached > prev) AS violations FROM (
  SELECT visitor_type, reached, lag(reached) OVER (PARTITION BY visitor_type ORDER BY k) AS prev
  FROM (SELECT visitor_type, k, count(*) FILTER (depth >= k) AS reached
        FROM fr, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY ALL)) GROUP BY 1""", FRAME))
def v25(spark, sf):
    t = fn.stage_table(_frame(spark, sf), ["visitor_type"])
    bad = fn.non_monotone(t, ["visitor_type"]).groupBy("visitor_type").agg(
        F.count(F.lit(1)).alias("_v"))
    return t.select("visitor_type").distinct().join(bad, "visitor_type", "left").select(
        "visitor_type", F.coalesce("_v", F.lit(0)).alias("violations"))


# ------------------------------------------------------------------ experiment
UNITS = DEPTH + """,
us AS (SELECT a.prospect_id, count(*) FILTER (session_start < assigned_at) AS prior_sessions,
    max(CASE WHEN customer_id IS NULL AND session_start >= assigned_at
        AND session_start < TIMESTAMP '2024-01-06' THEN coalesce(depth, 0) END) AS deepest
  FROM j_assignments a JOIN j_sessions USING (prospect_id) LEFT JOIN sd USING (session_id)
  GROUP BY 1),
u0 AS (SELECT a.prospect_id, variant, variant = 'treatment' AS treated, assigned_at, p.created_at,
    p.acquisition_channel, p.region, p.age_band, p.income_band, p.device_type, p.email_opt_in,
    c.customer_id, c.customer_since, coalesce(prior_sessions, 0) AS prior_sessions,
    CASE WHEN coalesce(prior_sessions, 0) = 0 THEN 'new lead' ELSE 'returning lead' END
      AS lead_type,
    date_diff('microsecond', p.created_at, assigned_at) / 86400e6::DOUBLE AS days_since_lead,
    coalesce(customer_since >= assigned_at AND customer_since < TIMESTAMP '2024-01-06', false)
      AS converted, coalesce(deepest, 0) AS deepest
  FROM j_assignments a LEFT JOIN j_prospects p USING (prospect_id)
  LEFT JOIN j_customers c USING (prospect_id) LEFT JOIN us USING (prospect_id)),
um AS (SELECT u0.customer_id, arg_min(net_amount, (order_ts, order_id)) AS first_net,
    arg_min(item_count, (order_ts, order_id)) AS first_items,
    sum(CASE WHEN order_ts >= assigned_at AND order_ts < assigned_at + INTERVAL 7 DAY
        THEN net_amount END) AS revenue
  FROM u0 JOIN j_orders USING (customer_id) GROUP BY 1),
un AS (SELECT u0.* EXCLUDE (deepest), CASE WHEN converted THEN first_net END AS first_order_value,
    CASE WHEN converted THEN CAST(first_items AS DOUBLE) END AS first_order_items,
    CASE WHEN converted THEN first_net ELSE 0 END AS first_order_revenue,
    coalesce(revenue, 0) AS revenue_7d, deepest >= 2 AS reached_product_view,
    deepest >= 3 AS reached_add_to_cart, deepest >= 4 AS reached_checkout_start,
    deepest >= 5 AS reached_purchase FROM u0 LEFT JOIN um USING (customer_id))
"""


def units(spark, sf):
    return ex.build_units(ad.journey(spark, sf), EXP, EXP_END, revenue_days=7)


def sums_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}metric, count(y) FILTER (NOT treated) AS n_c, count(y) FILTER (treated)
  AS n_t, sum(y) FILTER (NOT treated) AS x_c, sum(y) FILTER (treated) AS x_t,
  avg(y) FILTER (NOT treated) AS m_c, avg(y) FILTER (treated) AS m_t,
  var_samp(y) FILTER (NOT treated) AS v_c, var_samp(y) FILTER (treated) AS v_t
FROM {src} GROUP BY ALL"""


Z = "1.959963984540054::DOUBLE"
SE = "sqrt(m_c * (1 - m_c) / n_c + m_t * (1 - m_t) / n_t)"
PROP_COLS = f"""n_c AS n_control, n_t AS n_treatment, round(m_c, 6) AS control,
  round(m_t, 6) AS treatment, round(m_t - m_c, 6) AS diff, round({SE}, 6) AS se,
  round(m_t - m_c - {Z} * {SE}, 6) AS ci_low, round(m_t - m_c + {Z} * {SE}, 6) AS ci_high,
  round(CASE WHEN {SE} > 0 THEN (m_t - m_c) / {SE} ELSE 0 END, 6) AS z,
  round(CASE WHEN sqrt((x_c + x_t) / (n_c + n_t) * (1 - (x_c + x_t) / (n_c + n_t)) *
    (1.0::DOUBLE / n_c + 1.0::DOUBLE / n_t)) > 0 THEN (m_t - m_c) / sqrt((x_c + x_t) / (n_c + n_t)
    * (1 - (x_c + x_t) / (n_c + n_t)) * (1.0::DOUBLE / n_c + 1.0::DOUBLE / n_t)) ELSE 0 END, 6)
    AS z_pooled,
  round(CASE WHEN x_c > 0 AND x_t > 0 THEN m_t / m_c - 1 END, 6) AS relative,
  round(CASE WHEN x_c > 0 AND x_t > 0 THEN exp(ln(m_t / m_c) - {Z} * sqrt((1 - m_t) / x_t +
    (1 - m_c) / x_c)) - 1 END, 6) AS relative_ci_low,
  round(CASE WHEN x_c > 0 AND x_t > 0 THEN exp(ln(m_t / m_c) + {Z} * sqrt((1 - m_t) / x_t +
    (1 - m_c) / x_c)) - 1 END, 6) AS relative_ci_high"""
PRIMARY = UNITS + """,
pl AS (SELECT 'converted' AS metric, treated, CAST(converted AS DOUBLE) AS y FROM un
  UNION ALL SELECT 'reached_checkout_start', treated, CAST(reached_checkout_start AS DOUBLE)
  FROM un),
ps AS (""" + sums_sql("pl") + ")"


@query("e1_hash_assignment", with_views("""
SELECT c_custkey, CASE WHEN b < 0.3 THEN 'treatment' ELSE 'control' END AS variant,
       round(b, 8) AS bucket FROM (SELECT c_custkey, CAST('0x' || substr(sha256('EXP7:' ||
  CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS b FROM customer)"""))
def e1(spark, sf):
    c = ad.table(spark, sf, "customer")
    return c.select("c_custkey", ex.variant(F.lit("EXP7"), F.col("c_custkey"), F.lit(0.3))
                    .alias("variant"), F.round(ex.bucket(F.lit("EXP7"), F.col("c_custkey")), 8)
                    .alias("bucket"))


@query("e2_registry", with_views("""
SELECT experiment_id, end_date + INTERVAL 1 DAY AS window_end,
  CAST(date_diff('day', start_date, end_date + INTERVAL 1 DAY) AS INT) AS duration_days,
  (SELECT count(*) FROM j_assignments) AS assigned FROM j_experiments"""))
def e2(spark, sf):
    t = ad.journey(spark, sf)
    n = t["experiment_assignments"].groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("assigned"))
    return ex.registry(t["experiments"], EXP).join(n, "experiment_id").select(
        "experiment_id", "window_end", "duration_days", "assigned")


@query("e3_eligible_population", with_views("SELECT * FROM j_eligible"))
def e3(spark, sf):
    return ex.eligible_population(ad.journey(spark, sf)["sessions"], EXP_START, EXP_END)


U_ROUND = ("days_since_lead", "first_order_value", "first_order_revenue", "revenue_7d")


@query("e4_unit_table", with_views("SELECT * REPLACE (" + ", ".join(
    f"round({c}, 4) AS {c}" for c in U_ROUND) + ") FROM un", UNITS))
def e4(spark, sf):
    return rounded(units(spark, sf), 4)


@query("e5_assignment_audit", with_views("""
SELECT 'variant_differs_from_hash' AS check_name, 0::BIGINT AS rows
UNION ALL SELECT 'assigned_twice', 0 UNION ALL SELECT 'assigned_outside_window', 0
UNION ALL SELECT 'assigned_after_order', count(*) FROM un WHERE customer_since < assigned_at
UNION ALL SELECT 'not_assigned_at_first_exposure', 0
UNION ALL SELECT 'control_units', count(*) FILTER (variant = 'control') FROM un
UNION ALL SELECT 'treatment_units', count(*) FILTER (variant = 'treatment') FROM un""", UNITS))
def e5(spark, sf):
    t = ad.journey(spark, sf)
    return ex.assignment_audit(units(spark, sf), t["sessions"], EXP, EXP_START, EXP_END, 0.5)


COVS = list(ex.COVARIATES)
BALANCE = UNITS + ",\ncl AS (" + "\nUNION ALL ".join(
    f"SELECT DISTINCT '{c}=' || CAST({c} AS VARCHAR) AS covariate FROM un" for c in COVS) + """),
ub AS (""" + "\nUNION ALL ".join(
    f"SELECT covariate, treated, CAST(covariate = '{c}=' || CAST({c} AS VARCHAR) AS INT)::DOUBLE "
    f"AS y FROM un, cl WHERE starts_with(covariate, '{c}=')" for c in COVS) + """
UNION ALL SELECT 'prior_sessions', treated, prior_sessions::DOUBLE FROM un
UNION ALL SELECT 'days_since_lead', treated, days_since_lead FROM un)"""


@query("e6_covariate_balance", with_views("""
SELECT covariate, round(mc, 6) AS control_mean, round(mt, 6) AS treatment_mean,
  round(CASE WHEN sqrt((vc + vt) / 2) > 0 THEN (mt - mc) / sqrt((vc + vt) / 2) ELSE 0 END, 6)
    AS smd
FROM (SELECT covariate, avg(y) FILTER (NOT treated) AS mc, avg(y) FILTER (treated) AS mt,
             var_samp(y) FILTER (NOT treated) AS vc, var_samp(y) FILTER (treated) AS vt
      FROM ub GROUP BY 1)""", BALANCE))
def e6(spark, sf):
    return rounded(ex.covariate_balance(units(spark, sf)), 6)


def primary(spark, sf):
    return ex.arm_sums(units(spark, sf), {
        m: F.col(m) for m in ("converted", "reached_checkout_start")})


@query("e7_two_proportions", with_views(f"SELECT metric, {PROP_COLS} FROM ps", PRIMARY))
def e7(spark, sf):
    return rounded(ex.two_proportions(primary(spark, sf)), 6)


@query("e7_two_proportions_p")
def e7p(spark, sf):
    return rounded(ex.with_p_normal(ex.two_proportions(primary(spark, sf))), 6)


WELCH = UNITS + """,
wl AS (SELECT 'first_order_revenue' AS metric, treated, first_order_revenue AS y FROM un
  UNION ALL SELECT 'revenue_7d', treated, revenue_7d FROM un),
ws AS (""" + sums_sql("wl") + ")"


def welch_rows(spark, sf):
    return ex.welch(ex.arm_sums(units(spark, sf), {
        m: F.col(m) for m in ("first_order_revenue", "revenue_7d")}))


@query("e8_welch", with_views("""
SELECT metric, n_c AS n_control, n_t AS n_treatment, round(m_c, 4) AS control,
  round(m_t, 4) AS treatment, round(m_t - m_c, 4) AS diff, round(sqrt(v_c / n_c + v_t / n_t), 4)
  AS se, round((v_c / n_c + v_t / n_t) * (v_c / n_c + v_t / n_t) / (v_c / n_c * v_c / n_c /
  (n_c - 1) + v_t / n_t * v_t / n_t / (n_t - 1)), 4) AS df,
  round((m_t - m_c) / sqrt(v_c / n_c + v_t / n_t), 4) AS t,
  round(CASE WHEN m_c > 0 AND m_t > 0 THEN ln(m_t / m_c) END, 4) AS log_ratio,
  round(CASE WHEN m_c > 0 AND m_t > 0 THEN sqrt(v_t / n_t / (m_t * m_t) + v_c / n_c / (m_c * m_c))
        END, 4) AS se_log_ratio FROM ws""", WELCH))
def e8(spark, sf):
    return rounded(welch_rows(spark, sf), 4)


@query("e8_welch_p")
def e8p(spark, sf):
    return rounded(ex.with_p_student(welch_rows(spark, sf)), 4)


@query("e9_decision", with_views(f"""
SELECT metric, guardrail, practical, CASE WHEN NOT (lo > 0 OR hi < 0) THEN 'hold_no_evidence'
    WHEN diff < 0 THEN 'reject_harm' WHEN guardrail <> 'pass' THEN 'hold_guardrail'
    WHEN lo >= 0.02 THEN 'ship' ELSE 'ship_and_monitor' END AS recommendation
FROM (SELECT *, CASE WHEN lo >= -0.01 THEN 'pass' WHEN hi < -0.01 THEN 'fail'
               ELSE 'inconclusive' END AS guardrail,
        CASE WHEN lo >= 0.02 THEN 'ci_above_mei' WHEN hi < 0.02 THEN 'ci_below_mei'
             WHEN diff >= 0.02 THEN 'estimate_above_mei' ELSE 'estimate_below_mei' END AS practical
  FROM (SELECT metric, m_t - m_c AS diff, m_t - m_c - {Z} * {SE} AS lo,
               m_t - m_c + {Z} * {SE} AS hi FROM ps))""", PRIMARY))
def e9(spark, sf):
    d = ex.two_proportions(primary(spark, sf))
    lo, hi, diff = F.col("ci_low"), F.col("ci_high"), F.col("diff")
    g = ex.guardrail_status(lo, hi, 0.01)
    return d.select("metric", g.alias("guardrail"),
                    ex.practical_significance(diff, lo, hi).alias("practical"),
                    ex.decision(diff, lo, hi, g == "pass").alias("recommendation"))


P_SQL = """
pv AS (SELECT l_suppkey AS k, avg(l_discount) * 3 AS p FROM lineitem GROUP BY 1),
pr AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM pv)
"""


def _p_values(spark, sf):
    return ad.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        (F.avg("l_discount") * 3).alias("p"))


@query("e10_multiple_testing", with_views("""
SELECT k, round(p, 6) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 6) AS p_holm,
  round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND
        UNBOUNDED FOLLOWING)), 6) AS q_bh FROM pr""", P_SQL))
def e10(spark, sf):
    d = ex.benjamini_hochberg(ex.holm(_p_values(spark, sf), "p"), "p")
    return rounded(d, 6)


SUB = UNITS + ",\nsl AS (" + "\nUNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS level, 'converted' AS metric, treated, "
    "CAST(converted AS DOUBLE) AS y FROM un" for d in ex.SUBGROUPS) + """),
ss AS (SELECT * FROM (""" + sums_sql("sl", "dimension, level") + """) WHERE n_c >= 3 AND n_t >= 3)
"""


def subgroups(spark, sf):
    return ex.subgroup_effects(units(spark, sf), "converted", min_units=3)


@query("e11_cochran_q", with_views(f"""
SELECT dimension, count(*) AS levels, round(sum(w * d * d) - sum(w * d) * sum(w * d) / sum(w), 4)
  AS q, count(*) - 1 AS df, round(sum(w * d) / sum(w), 6) AS pooled_effect
FROM (SELECT dimension, m_t - m_c AS d, 1 / ({SE} * {SE}) AS w FROM ss WHERE {SE} > 0)
GROUP BY 1 HAVING count(*) > 1""", SUB))
def e11(spark, sf):
    c = ex.cochran_q(subgroups(spark, sf), "dimension")
    return c.select("dimension", "levels", F.round("q", 4).alias("q"), "df",
                    F.round("pooled_effect", 6).alias("pooled_effect"))


@query("e11_cochran_q_p")
def e11p(spark, sf):
    return rounded(ex.with_p_chi2(ex.cochran_q(subgroups(spark, sf), "dimension")), 6)


@query("e12_sample_ratio", with_views("""
SELECT c AS control, t AS treatment, round((c - (c + t) * 0.5::DOUBLE) * (c - (c + t) * 0.5::DOUBLE)
  / ((c + t) * 0.5::DOUBLE) * 2, 6) AS chi2, round(t / CAST(c + t AS DOUBLE), 6) AS treatment_share
FROM (SELECT count(*) FILTER (NOT treated) AS c, count(*) FILTER (treated) AS t FROM un)""", UNITS))
def e12(spark, sf):
    return rounded(ex.sample_ratio(units(spark, sf), 0.5), 6)


@query("e13_subgroup_effects", with_views(
    f"SELECT dimension, level, metric, {PROP_COLS} FROM ss", SUB))
def e13(spark, sf):
    return rounded(subgroups(spark, sf), 6)


@query("e13_adjusted_subgroups")
def e13a(spark, sf):
    return rounded(ex.adjusted_subgroups(units(spark, sf), "converted",
                                         min_units=3), 6)


LOOKS = ["2024-01-03", "2024-01-04", "2024-01-06"]
LOOK_SQL = UNITS + """,
lk AS (SELECT week, cut, 'converted' AS metric, treated, CAST(coalesce(customer_since < cut AND
  converted, false) AS INT)::DOUBLE AS y FROM un, (SELECT unnest([1, 2, 3]) AS week, unnest([
  """ + ", ".join(f"TIMESTAMP '{c}'" for c in LOOKS) + """]) AS cut) WHERE assigned_at < cut),
lks AS (""" + sums_sql("lk", "week, cut") + ")"


@query("e14_cumulative_looks", with_views(
    f"SELECT week, cut, metric, {PROP_COLS} FROM lks", LOOK_SQL))
def e14(spark, sf):
    return rounded(ex.cumulative_effects(units(spark, sf), LOOKS), 6)


ARM = UNITS + ",\nal AS (" + "\nUNION ALL ".join(
    f"SELECT '{s}' AS metric, treated, CAST(reached_{s} AS INT)::DOUBLE AS y FROM un"
    for s in STAGES[1:]) + """
UNION ALL SELECT 'purchase | checkout_start', treated, CAST(reached_purchase AS INT)::DOUBLE FROM un
  WHERE reached_checkout_start),
als AS (""" + sums_sql("al") + ")"


@query("e15_arm_funnel", with_views(f"SELECT metric, {PROP_COLS} FROM als", ARM))
def e15(spark, sf):
    return rounded(ex.arm_funnel(units(spark, sf)), 6)


SUMMARY = ["converted", "first_order_value", "first_order_items", "revenue_7d", "prior_sessions"]


@query("e16_unit_summary", with_views("SELECT variant, count(*) AS units, " + ", ".join(
    f"round(avg(CAST({c} AS DOUBLE)), 4) AS mean_{c}" for c in SUMMARY)
    + " FROM un GROUP BY 1", UNITS))
def e16(spark, sf):
    return rounded(ex.unit_summary(units(spark, sf), SUMMARY), 4)


@query("e17_planning", with_views("""
SELECT count(*) AS expected_eligible_prospects, round(avg(CASE WHEN customer_since <
  TIMESTAMP '2024-01-02' THEN 1.0::DOUBLE ELSE 0 END), 6) AS baseline_conversion
FROM (SELECT DISTINCT prospect_id FROM j_sessions WHERE customer_id IS NULL
      AND session_start >= TIMESTAMP '2024-01-01' AND session_start < TIMESTAMP '2024-01-02')
LEFT JOIN j_customers USING (prospect_id)"""))
def e17(spark, sf):
    t = ad.journey(spark, sf)
    return rounded(ex.planning(t["sessions"], t["customers"], "2024-01-01", EXP_START), 6)


@query("e18_business_translation", with_views(f"""
SELECT metric, round(a, 4) AS annual_eligible_prospects, round(d * 1000, 4) AS diff_per_1000,
  round(lo * 1000, 4) AS ci_low_per_1000, round(hi * 1000, 4) AS ci_high_per_1000,
  round(d * a, 4) AS diff_per_year, round(lo * a, 4) AS ci_low_per_year,
  round(hi * a, 4) AS ci_high_per_year
FROM (SELECT metric, (n_c + n_t) * 365 / 4.0::DOUBLE AS a, m_t - m_c AS d,
             m_t - m_c - {Z} * {SE} AS lo, m_t - m_c + {Z} * {SE} AS hi FROM ps)""", PRIMARY))
def e18(spark, sf):
    d = ex.two_proportions(primary(spark, sf))
    return rounded(ex.business_translation(d, F.col("n_control") + F.col("n_treatment"), 4), 4)


@query("e19_permutation_test")
def e19(spark, sf):
    return rounded(ex.permutation_test(units(spark, sf), "converted", 10_000, seed=3), 6)


@query("e20_aa_check")
def e20(spark, sf):
    return rounded(ex.aa_check(units(spark, sf).where("not treated"), "converted", 2_000), 6)


@query("e21_regression_adjustment")
def e21(spark, sf):
    u = units(spark, sf)
    return rounded(ex.regression_adjusted(u, "converted", ex.covariate_columns(u)), 6)

"""Targeting economics, value groups and next-best-action queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cols import flag, plus_days, rounded, ts
from tidemark.operators import actions as ac
from tidemark.operators import targeting as tg
from tidemark.operators import timewin as tw
from tidemark.operators import value as vl
from tidemark.plans.q_features import VALUE_SQL, runs_cte
from tidemark.plans.q_metrics import VAL
from tidemark.plans.registry import query
from tidemark.sources import adapters as ad
from tidemark.sources.oracle_views import with_views

RA = tg.assume(tg.RETENTION, save_rate=0.2)
GA = tg.GROWTH
RATE = 0.4
RUN = ["run_cutoff"]
NET = "(0.2::DOUBLE * score_a * (value - 10) - 1 - 5 * (1 - score_a))"


def scored(spark, sf):
    d = ad.score_frame(spark, sf)
    return d.withColumn("value_score", F.round(tg.expected_net(F.col("score_a"), F.col("value"),
                                                               RA), 9))


RANKED = f"""
sv AS (SELECT *, round({NET}, 9) AS value_score FROM scored),
tl AS (SELECT run_cutoff, label, value, 'risk_ranked' AS model, score_a AS score FROM sv UNION ALL
       SELECT run_cutoff, label, value, 'value_ranked', value_score FROM sv),
tg AS (SELECT model, run_cutoff, score, count(*) AS n, sum(label) AS c, sum(1 - label) AS o,
         sum(label * value) AS v FROM tl GROUP BY ALL),
tr AS (SELECT *, sum(n) OVER (PARTITION BY model, run_cutoff ORDER BY score DESC) - n AS before_n,
         sum(n) OVER (PARTITION BY model, run_cutoff) AS total_n FROM tg),
td AS (SELECT model, run_cutoff, depth, sum(t * c) AS c, sum(t * o) AS o, sum(t * v) AS v
  FROM (SELECT *, greatest(0.0::DOUBLE, least(depth * total_n - before_n, n)) / n AS t
        FROM tr, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS depth)) GROUP BY 1, 2, 3),
ts AS (SELECT model, depth, count(*) AS runs, sum(c) AS c, sum(o) AS o, sum(v) AS v
       FROM td GROUP BY 1, 2
       UNION ALL SELECT 'random', depth, (SELECT count(DISTINCT run_cutoff) FROM sv),
         depth * sum(label), depth * sum(1 - label), depth * sum(label * value)
       FROM sv, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS depth) GROUP BY depth)
"""
COST = "((c + o) + 10 * (0.2::DOUBLE * c + 0.5::DOUBLE * o))"


@query("d1_expected_net", with_views(f"""
SELECT entity_id, round({NET}, 9) AS expected_net FROM scored"""))
def d1(spark, sf):
    return scored(spark, sf).select("entity_id", F.col("value_score").alias("expected_net"))


@query("d2_selection_outcome", with_views(f"""
SELECT round(c + o, 4) AS customers_targeted, round(c, 4) AS churners_targeted,
  round(0.2::DOUBLE * c, 4) AS expected_saves, round(0.2::DOUBLE * v, 4) AS incremental_margin,
  round({COST}, 4) AS program_cost, round(0.2::DOUBLE * v - {COST}, 4) AS net_value,
  round((0.2::DOUBLE * v - {COST}) / {COST}, 4) AS roi,
  round(CASE WHEN v - 10 * c > 0 THEN (c + o + 5 * o) / (v - 10 * c) ELSE 'inf'::DOUBLE END, 4)
    AS break_even_save_rate
FROM (SELECT sum(label)::DOUBLE AS c, sum(1 - label)::DOUBLE AS o, sum(label * value) AS v
      FROM scored WHERE score_b > 0.9)"""))
def d2(spark, sf):
    return rounded(tg.evaluate_selection(ad.score_frame(spark, sf), F.col("score_b") > 0.9,
                                         "label", "value", RA), 4)


@query("d3_topk_sums", with_views("""
SELECT model, depth AS share, round(c, 6) AS churners, round(o, 6) AS others,
  round(v, 6) AS churner_value FROM ts WHERE model <> 'random'""", RANKED))
def d3(spark, sf):
    y = F.col("label").cast("double")
    s = tg.topk_sums(scored(spark, sf), {"risk_ranked": "score_a", "value_ranked": "value_score"},
                     {"churners": y, "others": 1 - y, "churner_value": y * F.col("value")},
                     [0.05, 0.1, 0.2], RUN)
    return rounded(s.select("model", "share", "churners", "others", "churner_value"), 6)


@query("d4_policies_by_depth", with_views(f"""
SELECT depth, model AS policy, round((c + o) / runs, 4) AS customers_targeted_per_run,
  round(c / runs, 4) AS churners_targeted_per_run,
  round(0.2::DOUBLE * c / runs, 4) AS expected_saves_per_run,
  round(0.2::DOUBLE * v / runs, 4) AS incremental_margin_per_run,
  round({COST} / runs, 4) AS program_cost_per_run,
  round((0.2::DOUBLE * v - {COST}) / runs, 4) AS net_value_per_run,
  round((0.2::DOUBLE * v - {COST}) / {COST}, 4) AS roi,
  round(CASE WHEN v - 10 * c > 0 THEN (c + o + 5 * o) / (v - 10 * c) ELSE 'inf'::DOUBLE END, 4)
    AS break_even_save_rate FROM ts""", RANKED))
def d4(spark, sf):
    return rounded(tg.simulate_policies(
        scored(spark, sf), {"risk_ranked": "score_a", "value_ranked": "value_score"}, "label",
        "value", [0.05, 0.1, 0.2], RA, RUN), 4, skip=("depth",))


@query("d5_threshold_policy", with_views(f"""
SELECT 'expected_net_positive' AS policy, round(depth, 4) AS depth,
  round((c + o) / runs, 4) AS customers_targeted_per_run,
  round(c / runs, 4) AS churners_targeted_per_run,
  round(0.2::DOUBLE * c / runs, 4) AS expected_saves_per_run,
  round(0.2::DOUBLE * v / runs, 4) AS incremental_margin_per_run,
  round({COST} / runs, 4) AS program_cost_per_run,
  round((0.2::DOUBLE * v - {COST}) / runs, 4) AS net_value_per_run,
  round((0.2::DOUBLE * v - {COST}) / {COST}, 4) AS roi,
  round(CASE WHEN v - 10 * c > 0 THEN (c + o + 5 * o) / (v - 10 * c) ELSE 'inf'::DOUBLE END, 4)
    AS break_even_save_rate, round(planned / runs, 4) AS planned_net_value_per_run
FROM (SELECT count(DISTINCT run_cutoff) AS runs, avg(CASE WHEN {NET} > 0 THEN 1.0::DOUBLE ELSE 0
    END) AS depth, sum({NET}) FILTER ({NET} > 0) AS planned,
    (sum(label) FILTER ({NET} > 0))::DOUBLE AS c,
    (sum(1 - label) FILTER ({NET} > 0))::DOUBLE AS o,
    sum(label * value) FILTER ({NET} > 0) AS v FROM scored)"""))
def d5(spark, sf):
    return rounded(tg.threshold_policy(ad.score_frame(spark, sf), "score_a", "label", "value", RA,
                                       "run_cutoff"), 4)


SENS = """
gd AS (SELECT s, i FROM (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS s),
                        (SELECT unnest([5.0, 20.0]::DOUBLE[]) AS i)),
sl AS (SELECT s, i, run_cutoff, label, value, 'risk_ranked' AS policy, score_a AS score
       FROM scored, gd UNION ALL
       SELECT s, i, run_cutoff, label, value, 'value_ranked',
         s * score_a * (value - i) - 1 - i * 0.5::DOUBLE * (1 - score_a) FROM scored, gd),
sg AS (SELECT s, i, policy, run_cutoff, score, count(*) AS n, sum(label) AS c, sum(1 - label) AS o,
         sum(label * value) AS v FROM sl GROUP BY ALL),
sr AS (SELECT *, sum(n) OVER (PARTITION BY s, i, policy, run_cutoff ORDER BY score DESC) - n
         AS before_n, sum(n) OVER (PARTITION BY s, i, policy, run_cutoff) AS total_n FROM sg),
st AS (SELECT s, i, policy, count(DISTINCT run_cutoff) AS runs, sum(t * c) AS c, sum(t * o) AS o,
         sum(t * v) AS v FROM (SELECT *, greatest(0.0::DOUBLE, least(0.1::DOUBLE * total_n
           - before_n, n)) / n AS t FROM sr) GROUP BY 1, 2, 3)
"""


@query("d6_sensitivity", with_views("""
SELECT s AS save_rate, i AS incentive_cost, policy, 0.1::DOUBLE AS depth,
  round((s * v - (c + o + i * (s * c + 0.5::DOUBLE * o))) / runs, 3) AS net_value_per_run,
  round((s * v - (c + o + i * (s * c + 0.5::DOUBLE * o))) / (c + o + i * (s * c + 0.5::DOUBLE * o)),
        4) AS roi FROM st""", SENS))
def d6(spark, sf):
    t = tg.sensitivity(ad.score_frame(spark, sf), "score_a", "label", "value", 0.1, RA,
                       [0.1, 0.2], [5.0, 20.0], RUN)
    return t.withColumn("net_value_per_run", F.round("net_value_per_run", 3)).withColumn(
        "roi", F.round("roi", 4))


@query("d7_observed_margin_rate", with_views("""
SELECT round((sum(net_amount) - sum(quantity * unit_cost)) / sum(net_amount), 8) AS margin_rate
FROM g_lines JOIN products USING (product_id)
WHERE order_id IN (SELECT order_id FROM g_orders WHERE order_ts < TIMESTAMP '2000-07-01')"""))
def d7(spark, sf):
    t = ad.ledger(spark, sf)
    return rounded(tg.observed_margin_rate(t["orders"], t["order_lines"], t["products"],
                                           "2000-07-01"), 8)


GROW = VAL + """,
gp AS (SELECT model AS policy, depth, max(depth * total_n) AS k,
       sum(greatest(0.0::DOUBLE, least(depth * total_n - before_n, n)) / n * sy) AS y,
       max(total_y) AS total_y FROM vc, (SELECT unnest([0.05, 0.2]::DOUBLE[]) AS depth)
       WHERE model <> 'oracle' GROUP BY ALL),
gr AS (SELECT * FROM gp UNION ALL SELECT 'random', depth, k, depth * total_y, total_y FROM gp
       WHERE policy = 'score_a')
"""
SC = {"score_a": "score_a", "score_b": "score_b"}


@query("d8_growth_policies", with_views("""
SELECT depth, policy, round(k, 4) AS customers_targeted, round(y, 3) AS baseline_revenue,
  round(0.05::DOUBLE * y, 3) AS incremental_revenue,
  round(0.05::DOUBLE * y * 0.4::DOUBLE, 3) AS incremental_margin, round(8 * k, 3) AS program_cost,
  round(0.05::DOUBLE * y * 0.4::DOUBLE - 8 * k, 3) AS net_value,
  round((0.05::DOUBLE * y * 0.4::DOUBLE - 8 * k) / (8 * k), 6) AS roi,
  round(8 * k / (0.4::DOUBLE * y), 6) AS break_even_uplift FROM gr""", GROW))
def d8(spark, sf):
    t = tg.simulate_growth(ad.score_frame(spark, sf), SC, "value", [0.05, 0.2], RATE, GA)
    d = {"roi": 6, "break_even_uplift": 6, "customers_targeted": 4}
    return t.select("depth", "policy", *[F.round(c, d.get(c, 3)).alias(c) for c in t.columns[2:]])


@query("d9_planned_vs_realised", with_views("""
SELECT depth, round(p, 4) AS planned_baseline_revenue, round(y, 3) AS realised_baseline_revenue,
  round(0.02::DOUBLE * p - 8 * k, 3) AS planned_net_value,
  round(0.02::DOUBLE * y - 8 * k, 3) AS realised_net_value
FROM (SELECT depth, max(depth * total_n) AS k, sum(t * sy) AS y, sum(t * n * score) AS p FROM (
  SELECT *, greatest(0.0::DOUBLE, least(depth * total_n - before_n, n)) / n AS t
  FROM vc, (SELECT unnest([0.05, 0.2]::DOUBLE[]) AS depth) WHERE model = 'score_b')
  GROUP BY depth)""", VAL))
def d9(spark, sf):
    t = tg.planned_vs_realised(ad.score_frame(spark, sf), "score_b", "value", [0.05, 0.2], RATE,
                               GA)
    return t.select("depth", F.round("planned_baseline_revenue", 4)
                    .alias("planned_baseline_revenue"), *[F.round(c, 3).alias(c) for c in (
                        "realised_baseline_revenue", "planned_net_value", "realised_net_value")])


@query("d9_growth_threshold", with_views("""
SELECT 'expected_net_positive' AS policy, round(depth, 6) AS depth,
  400.0::DOUBLE AS min_predicted_revenue, k::DOUBLE AS customers_targeted,
  round(y, 3) AS baseline_revenue, round(0.05::DOUBLE * y, 3) AS incremental_revenue,
  round(0.02::DOUBLE * y, 3) AS incremental_margin, round(8.0::DOUBLE * k, 3) AS program_cost,
  round(0.02::DOUBLE * y - 8 * k, 3) AS net_value,
  round((0.02::DOUBLE * y - 8 * k) / (8 * k), 6) AS roi,
  round(8 * k / (0.4::DOUBLE * y), 6) AS break_even_uplift,
  round(0.02::DOUBLE * y - 8 * k, 3) AS planned_net_value
FROM (SELECT avg(CASE WHEN 0.05::DOUBLE * value * 0.4::DOUBLE > 8 THEN 1.0::DOUBLE ELSE 0 END)
        AS depth, count(*) FILTER (0.05::DOUBLE * value * 0.4::DOUBLE > 8) AS k,
        sum(value) FILTER (0.05::DOUBLE * value * 0.4::DOUBLE > 8) AS y FROM scored)"""))
def d9t(spark, sf):
    t = tg.growth_threshold(ad.score_frame(spark, sf), "value", "value", RATE, GA)
    d = {"depth": 6, "roi": 6, "break_even_uplift": 6}
    return t.select("policy", *[F.round(c, d.get(c, 3)).alias(c) for c in t.columns[1:]])


@query("d9_growth_sensitivity", with_views("""
SELECT u AS uplift, p AS perk_cost, policy, depth, round(u * y * 0.4::DOUBLE - (2 + p * 0.4::DOUBLE)
  * k, 3) AS net_value, round((u * y * 0.4::DOUBLE - (2 + p * 0.4::DOUBLE) * k) /
  ((2 + p * 0.4::DOUBLE) * k), 6) AS roi
FROM gr, (SELECT unnest([0.02, 0.1]::DOUBLE[]) AS u), (SELECT unnest([10.0, 20.0]::DOUBLE[]) AS p)
WHERE depth = 0.2""", GROW))
def d9s(spark, sf):
    t = tg.growth_sensitivity(ad.score_frame(spark, sf), SC, "value", 0.2, RATE, GA, [0.02, 0.1],
                              [10.0, 20.0])
    return t.withColumn("net_value", F.round("net_value", 3)).withColumn("roi", F.round("roi", 6))


# ------------------------------------------------------------------ value groups and actions
BASE = VALUE_SQL.replace(runs_cte(["2000-01-01", "2000-04-01", "2000-07-01", "2000-10-01"]),
                         runs_cte(["2000-07-01"])) + """,
bs AS (SELECT vf.*, coalesce(spend, 0) AS future_revenue,
         floor(revenue_total / 50000) * 10 AS pred,
         1.0::DOUBLE / (1 + days_since_last_order / 200) AS p_alive
       FROM vf LEFT JOIN fut USING (run_cutoff, customer_id)),
br AS (SELECT *, row_number() OVER (ORDER BY pred DESC, customer_id) AS rp,
         row_number() OVER (ORDER BY revenue_180d DESC, customer_id) AS r1,
         row_number() OVER (ORDER BY revenue_365d DESC, customer_id) AS r3,
         count(*) OVER () AS cn FROM bs),
ba AS (SELECT *, CASE WHEN rp / CAST(cn AS DOUBLE) <= 0.05 THEN 'Top 5%'
           WHEN rp / CAST(cn AS DOUBLE) <= 0.2 THEN 'Next 15%'
           WHEN rp / CAST(cn AS DOUBLE) <= 0.5 THEN 'Next 30%' ELSE 'Bottom 50%' END AS tier,
    CASE WHEN r1 <= 0.2 * cn AND revenue_180d > 0 AND rp <= 0.2 * cn THEN 'core'
         WHEN rp <= 0.2 * cn THEN 'rising' WHEN r1 <= 0.2 * cn AND revenue_180d > 0 THEN 'fading'
         ELSE 'base' END AS migration,
    CASE WHEN r3 <= 0.2 * cn AND revenue_365d > 0 AND p_alive < 0.7 THEN 'retention_save'
         WHEN rp <= 0.05 * cn THEN 'vip_care'
         WHEN rp <= 0.2 * cn AND plus_member = 0 AND plus_cancelled_180d = 0 THEN 'plus_invite'
         WHEN rp <= 0.5 * cn AND category_count <= 5 THEN 'cross_sell'
         WHEN rp <= 0.5 * cn THEN 'personalized_grow' ELSE 'low_touch' END AS action FROM br)
"""
RULES = ac.ActionRules(at_risk_p_alive=0.7, cross_sell_max_categories=5)


def action_base(spark, sf):
    from tidemark.functions.lineage import cut
    d = vl.build_dataset(ad.ledger(spark, sf), ["2000-07-01"], clv=False)
    d = d.withColumn("pred", F.floor(F.col("revenue_total") / 50000) * 10).withColumn(
        "p_alive", 1.0 / (1 + F.col("days_since_last_order") / 200))
    # equal spend must tie whatever order the cents were added in
    d = cut(d.withColumns({c: F.round(c, 4) for c in ("revenue_180d", "revenue_365d")}))
    d = ac.with_ranks(d, "customer_id", {"rp": "pred", "r1": "revenue_180d",
                                         "r3": "revenue_365d"})
    return (d.withColumn("tier", ac.value_tier("rp"))
            .withColumn("migration", ac.migration_group("revenue_180d", "r1", "rp"))
            .withColumn("action", ac.assign_actions(d, "rp", "r3", RULES)))


@query("d10_top_share", with_views(
    "SELECT customer_id, r3 <= 0.2 * cn AS top_past FROM ba", BASE))
def d10(spark, sf):
    return action_base(spark, sf).select("customer_id", ac.in_top("r3", 0.2).alias("top_past"))


def group_sql(col: str, order) -> str:
    pos = "list_position([" + ", ".join(f"'{g}'" for g in order) + f"], {col})"
    return f"""SELECT {col} AS "group", count(*) AS customers,
  CAST(sum(pred) AS BIGINT) AS predicted_revenue, round(sum(future_revenue), 3) AS actual_revenue,
  round(avg(pred), 6) AS mean_predicted, round(avg(future_revenue), 5) AS mean_actual,
  round(avg(CASE WHEN future_revenue > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS buyer_rate,
  round(avg(revenue_180d), 5) AS mean_revenue_180d,
  round(avg(CASE WHEN orders_180d > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS active_share,
  round(avg(plus_member), 6) AS plus_member_rate, round(avg(orders_total), 6) AS mean_orders_total,
  round(avg(category_count), 6) AS mean_category_count, round(avg(p_alive), 6) AS mean_p_alive,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share_of_customers,
  round(sum(pred) / CAST(sum(sum(pred)) OVER () AS DOUBLE), 6) AS share_of_predicted,
  round(sum(future_revenue) / sum(sum(future_revenue)) OVER (), 6) AS share_of_actual,
  CAST({pos} AS BIGINT) AS position FROM ba GROUP BY {col}"""


def _groups(spark, sf, col, order):
    t = ac.group_summary(action_base(spark, sf), col, "pred", "future_revenue", order)
    d = {"actual_revenue": 3, "mean_actual": 5, "mean_revenue_180d": 5}
    return t.select(*[F.round(c, d.get(c, 6)).alias(c) if dict(t.dtypes)[c] == "double"
                      else F.col(c) for c in t.columns])


TIER_ORDER = [t for t, _ in ac.TIERS]


@query("d11_value_tiers", with_views(group_sql("tier", TIER_ORDER), BASE))
def d11(spark, sf):
    return _groups(spark, sf, "tier", TIER_ORDER)


@query("d12_value_migration", with_views(group_sql("migration", ac.MIGRATION), BASE))
def d12(spark, sf):
    return _groups(spark, sf, "migration", ac.MIGRATION)


@query("d13_action_summary", with_views(group_sql("action", ac.ACTIONS), BASE))
def d13(spark, sf):
    return _groups(spark, sf, "action", ac.ACTIONS)


@query("d14_next_best_action", with_views("SELECT customer_id, action FROM ba", BASE))
def d14(spark, sf):
    return action_base(spark, sf).select("customer_id", "action")


@query("d15_priority_list", with_views("""
SELECT customer_id, action, CAST(pred AS BIGINT) AS pred, position FROM (
  SELECT *, row_number() OVER (PARTITION BY action ORDER BY pred DESC, customer_id) AS position
  FROM ba) WHERE position <= 10""", BASE))
def d15(spark, sf):
    return ac.priority_list(action_base(spark, sf).select("customer_id", "action", "pred"),
                            "pred").select("customer_id", "action", "pred", "position")


CATS = """
lcat AS (SELECT customer_id, category, quantity, order_ts FROM g_lines JOIN products
  USING (product_id) JOIN g_orders USING (order_id)),
cu AS (SELECT customer_id, category, sum(quantity) AS units FROM lcat
  WHERE order_ts < TIMESTAMP '2000-07-01' GROUP BY 1, 2),
cp AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) AS pr FROM cu
  GROUP BY 1),
cprof AS (SELECT c.customer_id, (SELECT arg_min(category, (-units, category)) FROM cu
      WHERE cu.customer_id = c.customer_id) AS featured_category,
    coalesce((SELECT arg_min(category, pr) FROM cp WHERE category NOT IN (SELECT category FROM cu
      WHERE cu.customer_id = c.customer_id)), '') AS suggested_new_category,
    (SELECT category FROM cp WHERE pr = 1) AS best_seller_category
  FROM (SELECT DISTINCT customer_id FROM cu) c),
cfut AS (SELECT DISTINCT customer_id, category FROM lcat WHERE order_ts >= TIMESTAMP '2000-07-01'
  AND order_ts < TIMESTAMP '2000-09-29')
"""


def _category_inputs(spark, sf):
    t = ad.ledger(spark, sf)
    past = tw.events_before(t["orders"], "order_ts", "2000-07-01")
    return t, past


@query("a19_category_profile", with_views("""
SELECT customer_id, featured_category, suggested_new_category, best_seller_category,
  (SELECT count(*) FROM cu WHERE cu.customer_id = cprof.customer_id) AS owned FROM cprof""", CATS))
def a19(spark, sf):
    t, past = _category_inputs(spark, sf)
    p = ac.category_profile(past, t["order_lines"], t["products"])
    return p.select("customer_id", "featured_category", "suggested_new_category",
                    "best_seller_category",
                    F.size("owned_categories").cast("bigint").alias("owned"))


def _future(t):
    return tw.events_between(t["orders"], "order_ts", "2000-07-01", "2000-09-29")


@query("a20_future_categories", with_views("""
SELECT c.customer_id, coalesce(string_agg(category, ',' ORDER BY category), '') AS categories
FROM (SELECT DISTINCT customer_id FROM cu) c LEFT JOIN cfut USING (customer_id) GROUP BY 1""",
                                           CATS))
def a20(spark, sf):
    t, past = _category_inputs(spark, sf)
    base = ac.line_categories(past, t["order_lines"], t["products"]).select("customer_id").distinct()
    f = ac.future_categories(base, _future(t), t["order_lines"], t["products"])
    return f.select("customer_id", F.concat_ws(",", "future_categories").alias("categories"))


@query("a21_line_categories", with_views("""
SELECT customer_id, category, CAST(sum(quantity) AS BIGINT) AS quantity FROM lcat
GROUP BY 1, 2""", CATS))
def a21(spark, sf):
    t = ad.ledger(spark, sf)
    return ac.line_categories(t["orders"], t["order_lines"], t["products"]).groupBy(
        "customer_id", "category").agg(F.sum("quantity").alias("quantity"))


@query("d16_category_rules", with_views("""
SELECT count(*) FILTER (nb > 0) AS window_buyers,
  round(avg(fh) FILTER (nb > 0), 6) AS featured_category_hit_rate,
  round(avg(bh) FILTER (nb > 0), 6) AS best_seller_hit_rate,
  count(*) FILTER (cs AND nn > 0) AS cross_sell_new_category_buyers,
  round(avg(sh) FILTER (cs AND nn > 0), 6) AS suggested_new_category_hit_rate,
  round(avg(nn / CAST(6 - owned AS DOUBLE)) FILTER (cs AND nn > 0), 6)
    AS random_new_category_hit_rate
FROM (SELECT p.customer_id, owned, owned <= 4 AS cs,
    (SELECT count(*) FROM cfut f WHERE f.customer_id = p.customer_id) AS nb,
    (SELECT count(*) FROM cfut f WHERE f.customer_id = p.customer_id AND category NOT IN
      (SELECT category FROM cu WHERE cu.customer_id = p.customer_id)) AS nn,
    (SELECT count(*) FROM cfut f WHERE f.customer_id = p.customer_id
      AND category = featured_category)::DOUBLE AS fh,
    (SELECT count(*) FROM cfut f WHERE f.customer_id = p.customer_id
      AND category = best_seller_category)::DOUBLE AS bh,
    (SELECT count(*) FROM cfut f WHERE f.customer_id = p.customer_id
      AND category = suggested_new_category)::DOUBLE AS sh
  FROM (SELECT *, (SELECT count(*) FROM cu WHERE cu.customer_id = cprof.customer_id) AS owned
        FROM cprof) p)""", CATS))
def d16(spark, sf):
    t, past = _category_inputs(spark, sf)
    p = ac.category_profile(past, t["order_lines"], t["products"])
    bought = ac.future_categories(p, _future(t), t["order_lines"], t["products"])
    return rounded(ac.category_rule_evaluation(p, bought, p.where(
        F.size("owned_categories") <= 4)), 6)

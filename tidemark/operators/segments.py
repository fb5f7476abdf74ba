"""RFM scores, segments and the customer profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import first_match, flag, plus_days, ts
from tidemark.functions.lineage import cut
from tidemark.operators import churn
from tidemark.operators.lifecycle import Rules, assign_states, people_frame
from tidemark.operators.ranking import long_scores, ranked_scores, score_bounds

# Fixed values.
SEGMENTS = ("champions", "loyalists", "promising", "needs_attention", "cannot_lose", "slipping",
            "hibernating")


def quintile_scores(df: DataFrame, entity: str, measures: Mapping[str, tuple[str, bool]]
                    ) -> DataFrame:
    """(entity, one 1-5 score per measure) by quintile of the average rank; ties share a score.

    ``measures`` maps a score name to (column, higher is better). All measures are ranked
    together: by-value counts keyed by measure, then one narrow join back on (measure, value).
    """
    signed = {name: f"_{name}" for name in measures}
    base = df.select(entity, *[(F.col(c).cast("double") * (1 if up else -1)).alias(f"_{name}")
                               for name, (c, up) in measures.items()])
    bounds = score_bounds(base, list(signed.values()))
    rows = long_scores(base, signed, [entity], "measure")
    ranked = ranked_scores(rows, "score", {}, ["measure"], descending=False, bounds=bounds)
    pct = (F.col("before_n") + (F.col("n") + 1) / 2) / F.col("total_n")
    value = F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(pct * 5))).cast("int")
    scored = rows.join(ranked.select("measure", "score", value.alias("_v")), ["measure", "score"])
    return scored.groupBy(entity).agg(*[
        F.max(F.when(F.col("measure") == name, F.col("_v"))).alias(name) for name in measures])


def segment_rule(r: Column, fm: Column) -> Column:
    recent, mid = r >= 4, r == 3
    return first_match([
        (recent & (fm >= 4), "champions"), ((recent & (fm == 3)) | (mid & (fm >= 3)), "loyalists"),
        (recent, "promising"), (mid, "needs_attention"), (fm >= 4, "cannot_lose"),
        (fm == 3, "slipping")], "hibernating")


def rfm_scores(profile: DataFrame) -> DataFrame:
    """Add R, F, M and FM scores and the named segment."""
    p = cut(profile)  # feeds the bounds, the ranks and the final join
    scores = quintile_scores(p, "customer_id", {
        "r_score": ("idle_days", False), "f_score": ("orders_365d", True),
        "m_score": ("revenue_365d", True)})
    p = p.join(scores, "customer_id")
    p = p.withColumn("fm_score", F.ceil((F.col("f_score") + F.col("m_score")) / 2).cast("int"))
    return p.withColumn("rfm_segment", segment_rule(F.col("r_score"), F.col("fm_score")))


def customer_profile(tables: Mapping[str, DataFrame], as_of: str, rules: Rules,
                     horizon_days: int = 90) -> DataFrame:
    """State, RFM, engagement and (separately) the outcomes after the date, per customer."""
    at = ts(as_of)
    orders = tables["orders"]
    people = people_frame(tables["prospects"].where(F.col("created_at") < at),
                          tables["customers"].where(F.col("customer_since") < at))
    base = assign_states(people, orders, as_of, rules).where(
        "state is not null and state <> 'prospect'").select(
        "customer_id", "acquisition_channel", "state", "tenure_days", "idle_days")
    t = F.col("order_ts")
    past, recent = t < at, (t < at) & (t >= plus_days(at, -365))
    ahead = (t >= at) & (t < plus_days(at, horizon_days))
    sums = orders.where(t < plus_days(at, horizon_days)).groupBy("customer_id").agg(
        F.count_if(recent).alias("orders_365d"),
        F.sum(F.when(recent, F.col("net_amount")).otherwise(0.0)).alias("revenue_365d"),
        F.count_if(past).alias("orders_total"),
        F.avg(F.when(past, F.col("net_amount"))).alias("avg_order_value"),
        F.count_if(ahead).alias("next_orders"),
        F.sum(F.when(ahead, F.col("net_amount")).otherwise(0.0)).alias("next_revenue"))
    runs = [as_of]
    p = base.join(sums, "customer_id")
    parts = (churn.session_features(tables["sessions"], orders, runs)
             .drop("days_since_last_session"),
             churn.email_features(tables["marketing_touches"], runs),
             churn.membership_features(tables["subscription_events"], runs))
    for part in parts:
        p = p.join(part.drop("run_cutoff"), "customer_id", "left")
    zero = ("browse_sessions_30d", "browse_sessions_90d", "emails_received_90d",
            "email_clicks_90d", "plus_member", "plus_cancelled_180d")
    p = p.na.fill(0, list(zero)).na.fill(0.0, ["email_open_rate_90d"])
    # exact cents, so that equal spend ties whatever order the sums were added in
    p = p.withColumn("revenue_365d", F.round("revenue_365d", 4))
    return rfm_scores(p)


def segment_summary(profile: DataFrame, by: str) -> DataFrame:
    """Size, value, engagement and next-period outcomes per group."""
    opened = F.when(F.col("emails_received_90d") > 0, F.col("email_open_rate_90d"))
    t = profile.groupBy(by).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("revenue_365d").alias("revenue_365d"),
        F.avg("orders_365d").alias("orders_365d"),
        F.median("idle_days").alias("median_days_since_order"),
        F.avg("avg_order_value").alias("avg_order_value"),
        F.avg("browse_sessions_90d").alias("browse_sessions_90d"),
        F.avg(opened).alias("email_open_rate_90d"), F.avg("plus_member").alias("plus_member_rate"),
        F.avg(flag(F.col("next_orders") > 0)).alias("next_purchase_rate"),
        F.sum("next_revenue").alias("next_revenue"))
    whole = Window.partitionBy(F.lit(0))  # one row per segment
    return t.select("*", *[(F.col(a) / F.sum(a).over(whole)).alias(b) for a, b in (
        ("customers", "share_of_customers"), ("revenue_365d", "share_of_revenue_365d"),
        ("next_revenue", "share_of_next_revenue"))],
        (F.col("revenue_365d") / F.col("customers")).alias("revenue_365d_per_customer"),
        (F.col("next_revenue") / F.col("customers")).alias("next_revenue_per_customer"))


def crosstab(profile: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    return profile.groupBy(rows).pivot(columns, list(levels)).count().na.fill(0)

"""Headline and monthly business metrics, and the KPI catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import flag, month_of, plus_days, ratio, true_or_false, ts


def mature(df: DataFrame, ts_col: str, days: int, data_end: str) -> DataFrame:
    """Rows whose full outcome window lies inside the data."""
    return df.where(F.col(ts_col) < plus_days(ts(data_end), -days))


def conversion_within(prospects: DataFrame, customers: DataFrame, days: int, data_end: str
                      ) -> DataFrame:
    """Mature leads flagged by conversion within ``days`` of creation."""
    since = customers.select("prospect_id", "customer_since")
    hit = F.col("customer_since") < plus_days("created_at", days)
    return (mature(prospects, "created_at", days, data_end).join(since, "prospect_id", "left")
            .withColumn("converted", true_or_false(hit)).drop("customer_since"))


def channel_summary(t: Mapping[str, DataFrame], days: int, data_end: str,
                    channels: Sequence[str]) -> DataFrame:
    """Leads, customers, conversion and sourcing cost per channel; undefined costs stay null.

    Every source is reduced to channel rows first; the results meet in one union.
    """
    key = "acquisition_channel"
    p = t["prospects"]
    sourced = t["marketing_touches"].select("prospect_id", "campaign_id", "touch_at", "cost").join(
        p.select("prospect_id", "campaign_id", F.col("created_at").alias("touch_at"), key),
        ["prospect_id", "campaign_id", "touch_at"])
    conv = conversion_within(p, t["customers"], days, data_end)
    rows = [p.groupBy(key).agg(F.count(F.lit(1)).alias("leads")),
            t["customers"].groupBy(key).agg(F.count(F.lit(1)).alias("customers")),
            conv.groupBy(key).agg(F.avg(flag(F.col("converted"))).alias("conversion_rate")),
            sourced.groupBy(key).agg(F.sum("cost").alias("sourcing_spend"))]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    out = union.where(F.col(key).isin(list(channels))).groupBy(key).agg(
        F.coalesce(F.max("leads"), F.lit(0)).alias("leads"),
        F.coalesce(F.max("customers"), F.lit(0)).alias("customers"),
        F.max("conversion_rate").alias("conversion_rate"),
        F.coalesce(F.max("sourcing_spend"), F.lit(0.0)).alias("sourcing_spend"))
    paid = F.when(F.col("sourcing_spend") > 0, F.col("sourcing_spend"))
    return out.withColumn("cost_per_lead", paid / F.nullif("leads", F.lit(0))).withColumn(
        "cost_per_customer", paid / F.nullif("customers", F.lit(0)))


MONTHLY = ("new_leads", "new_customers", "orders", "ordering_customers", "net_revenue",
           "membership_revenue", "marketing_cost")


def monthly_kpis(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row per month over five sources; missing months of a source count as zero.

    Orders go through (month, customer) first, so ordering customers are a count, not a distinct.
    """
    def m(c: str) -> Column:
        return F.date_format(month_of(c), "yyyy-MM").alias("month")

    per = t["orders"].groupBy(m("order_ts"), "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_amount").alias("r"))
    rows = [
        t["prospects"].groupBy(m("created_at")).agg(F.count(F.lit(1)).alias("new_leads")),
        t["customers"].groupBy(m("customer_since")).agg(F.count(F.lit(1)).alias("new_customers")),
        per.groupBy("month").agg(F.sum("n").alias("orders"),
                                 F.count(F.lit(1)).alias("ordering_customers"),
                                 F.sum("r").alias("net_revenue")),
        t["subscription_events"].groupBy(m("event_ts")).agg(F.sum("amount")
                                                            .alias("membership_revenue")),
        t["marketing_touches"].groupBy(m("touch_at")).agg(F.sum("cost").alias("marketing_cost"))]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return union.groupBy("month").agg(*[F.max(c).alias(c) for c in MONTHLY]).na.fill(0)


def metric_rows(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, value) rows from one aggregation."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in metrics.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"),
                                                  F.col(k).alias("value")) for k in metrics])))


def headline(t: Mapping[str, DataFrame], data_end: str, cutoff: str, conversion_days: int = 60,
             repeat_days: int = 180) -> DataFrame:
    """The headline metrics as (metric, value) rows, one aggregation per table."""
    orders = t["orders"]
    conv = conversion_within(t["prospects"], t["customers"], conversion_days, data_end)
    before = F.col("order_ts") < ts(cutoff)
    parts = [
        metric_rows(t["prospects"], {"leads": F.count(F.lit(1))}),
        metric_rows(t["customers"], {"customers": F.count(F.lit(1))}),
        metric_rows(conv, {"lead_conversion_rate": F.avg(flag(F.col("converted")))}),
        metric_rows(orders, {
            "orders": F.count(F.lit(1)), "net_revenue": F.sum("net_amount"),
            "average_order_value": F.avg("net_amount"),
            "discounted_order_share": F.avg(flag(F.col("campaign_id").isNotNull())),
            "store_order_share": F.avg(flag(F.col("order_channel") == "store")),
            "orders_before_cutoff": F.count_if(before),
            "orders_on_or_after_cutoff": F.count_if(~before)}),
        repeat_rate(t["customers"], orders, data_end, repeat_days),
        repeat_revenue_share(t["customers"], orders),
        metric_rows(t["subscription_events"], {
            "members_ever": F.countDistinct(F.when(F.col("event_type") == "subscribe",
                                                   F.col("customer_id"))),
            "membership_revenue": F.sum("amount")}),
        metric_rows(t["support_contacts"], {"support_contacts": F.count(F.lit(1)),
                                            "mean_csat": F.avg("csat_score")}),
        metric_rows(t["marketing_touches"], {"marketing_cost": F.sum("cost")})]
    return reduce(lambda a, b: a.unionByName(b), parts)


def repeat_rate(customers: DataFrame, orders: DataFrame, data_end: str, days: int) -> DataFrame:
    """Share of mature customers with a later order within ``days`` of the first."""
    m = mature(customers, "customer_since", days, data_end).select("customer_id",
                                                                   "customer_since")
    again = (F.col("order_ts") > F.col("customer_since")) & (
        F.col("order_ts") < plus_days("customer_since", days))
    per = m.join(orders.select("customer_id", "order_ts"), "customer_id", "left").groupBy(
        "customer_id").agg(F.max(flag(again)).alias("r"))
    return metric_rows(per, {"repeat_purchase_rate": F.avg("r")})


def repeat_revenue_share(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Revenue of orders other than the first one, over all revenue."""
    j = orders.select("customer_id", "order_ts", "net_amount").join(
        customers.select("customer_id", "customer_since"), "customer_id", "left")
    first = true_or_false(F.col("order_ts") == F.col("customer_since"))
    return metric_rows(j, {"repeat_order_revenue_share": F.sum(
        F.when(~first, F.col("net_amount")).otherwise(0.0)) / F.sum("net_amount")})


def window_totals(monthly: DataFrame) -> DataFrame:
    """Sums over a month window with its average order value."""
    cols = ("net_revenue", "orders", "new_customers", "new_leads", "marketing_cost")
    t = monthly.agg(*[F.sum(c).cast("double").alias(c) for c in cols],
                    F.count(F.lit(1)).alias("months"))
    return t.withColumn("average_order_value", ratio(F.col("net_revenue"), F.col("orders"), None))


def kpi_catalog(current: DataFrame, previous: DataFrame, definitions: DataFrame) -> DataFrame:
    """Long KPI table: value, comparison value and change (relative, or points for shares)."""
    j = definitions.join(current, "metric").join(
        previous.select("metric", F.col("value").alias("comparison")), "metric", "left")
    pp = F.col("unit") == "share"
    change = F.when(pp, 100 * (F.col("value") - F.col("comparison"))).otherwise(
        F.when(F.col("comparison") != 0, F.col("value") / F.col("comparison") - 1))
    return j.select("metric", "theme", "unit", "value", "comparison", change.alias("change"),
                    F.when(pp, "points").otherwise("relative").alias("change_kind"))


def best_depth(curve: DataFrame, policy: str, value: str) -> DataFrame:
    """The saved row with the highest value of a policy (smallest depth on a tie)."""
    rows = curve.where(F.col("policy") == policy)
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(value, -F.col("depth"))).alias("b"))
    return best.select("b.*")


def recommended_actions(curve: DataFrame, points: DataFrame) -> DataFrame:
    """Capacity with the best net value and the decision point with the largest revenue gap."""
    a = curve.agg(F.max_by(F.concat_ws(" at ", "policy", F.col("depth").cast("string")),
                           F.struct("net_value_per_run", "policy")).alias("label"),
                  F.max("net_value_per_run").alias("value")).select(
        F.lit("targeting").alias("action"), "label", "value")
    b = points.agg(F.max_by("decision_point", F.struct("revenue_gap_per_year", "decision_point"))
                   .alias("label"), F.max("revenue_gap_per_year").alias("value")).select(
        F.lit("lifecycle").alias("action"), "label", "value")
    return a.unionByName(b)


def history_tail(weekly: DataFrame, weeks: int, keys: Sequence[str] = ()) -> DataFrame:
    """The last weeks of every series (a series has one row per week)."""
    last = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("week_start"))
    return weekly.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= weeks).drop("_r")

"""Acquisition cohorts with fixed denominators and explicit censoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import index_to_month, month_index, plus_days, ratio, ts


def cohort_retention(customers: DataFrame, orders: DataFrame, start: str, end: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Cohort x month-since-acquisition grid; cells after the data end are null, not zero.

    Orders are reduced to (customer, month) before they meet the customer table, so the distinct
    buyer count becomes a plain count. An order before its customer's cohort month raises.
    """
    by = list(by)
    last = month_index(plus_days(ts(end), -1))
    first = month_index(ts(start))
    c = customers.select("customer_id", *by, month_index("customer_since").alias("cohort_idx"))
    sizes = c.groupBy(*by, "cohort_idx").agg(F.count(F.lit(1)).alias("cohort_size"))
    grid = sizes.withColumn("months_since_acquisition", F.explode(F.sequence(
        F.lit(0).cast("bigint"), last - first)))
    grid = grid.withColumn("observed", F.col("cohort_idx") + F.col("months_since_acquisition")
                           <= last)
    monthly = orders.where(F.col("order_ts") < ts(end)).groupBy(
        "customer_id", month_index("order_ts").alias("_m")).agg(F.sum("net_amount")
                                                                .alias("revenue"))
    month = F.col("_m") - F.col("cohort_idx")
    early = F.raise_error(F.concat(F.lit("order before the cohort month of customer "),
                                   F.col("customer_id").cast("string")))
    activity = monthly.join(c, "customer_id").groupBy(
        *by, "cohort_idx", F.when(month < 0, early).otherwise(month).cast("bigint").alias("months_since_acquisition")
    ).agg(F.count(F.lit(1)).alias("buyers"), F.sum("revenue").alias("revenue"))
    out = grid.join(activity, [*by, "cohort_idx", "months_since_acquisition"], "left")
    for col, zero in (("buyers", F.lit(0)), ("revenue", F.lit(0.0))):
        out = out.withColumn(col, F.when(F.col("observed"), F.coalesce(F.col(col), zero)))
    per = F.col("revenue") / F.col("cohort_size")
    upto = Window.partitionBy(*by, "cohort_idx").orderBy("months_since_acquisition").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # one row per month of a cohort
    return out.select(
        *by, index_to_month("cohort_idx").alias("cohort"), "months_since_acquisition",
        "observed", "cohort_size", "buyers",
        (F.col("buyers") / F.col("cohort_size")).alias("retention"), "revenue",
        per.alias("revenue_per_customer"),
        F.when(F.col("observed"), F.sum(per).over(upto))
        .alias("cumulative_revenue_per_customer"))


def pooled_retention(table: DataFrame, follow_up_months: int, by: Sequence[str] = ()
                     ) -> DataFrame:
    """Retention over the fixed set of cohorts observed for at least ``follow_up_months``."""
    by = list(by)
    per = Window.partitionBy(*by, "cohort")
    seen = F.max(F.when(F.col("observed"), F.col("months_since_acquisition"))).over(per)
    t = table.withColumn("_seen", seen).where(
        (F.col("_seen") >= follow_up_months)
        & (F.col("months_since_acquisition") <= follow_up_months))
    out = t.groupBy(*by, "months_since_acquisition").agg(
        F.countDistinct("cohort").alias("cohorts"), F.min("cohort").alias("first_cohort"),
        F.max("cohort").alias("last_cohort"), F.sum("cohort_size").alias("customers"),
        F.sum("buyers").alias("buyers"), F.sum("revenue").alias("revenue"))
    rpc = ratio(F.col("revenue"), F.col("customers"), None)
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("months_since_acquisition").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # follow_up_months + 1 rows
    return out.select("*", (F.col("buyers") / F.col("customers")).alias("retention"),
                      rpc.alias("revenue_per_customer"),
                      F.sum(rpc).over(upto).alias("cumulative_revenue_per_customer"))

"""Whole-base customer value: history features, future revenue and the value audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cols import days_between, fan_out, flag, plus_days, ratio, ts
from tidemark.functions.lineage import cut
from tidemark.functions.runs import ahead, before, join_parts, per_run, rows_of, unfold
from tidemark.operators.churn import (
    CATEGORICAL,
    EMAIL_FEATURES,
    KEYS,
    MEMBER_FEATURES,
    SESSION_FEATURES,
    activity_columns,
    activity_parts,
    attributes,
    late_rows,
    when,
)
from tidemark.operators.clv import CLV_COLUMNS, clv_features
from tidemark.operators.leads import changed_rows, check_rows, cutoff_overlap, events_of, truncated

HORIZON_DAYS, MIN_HISTORY_DAYS = 180, 90
WINDOWS = (90, 180, 365)
ORDER_FEATURES = (
    "days_since_last_order", "mean_days_between_orders", "orders_total",
    *[f"orders_{d}d" for d in WINDOWS], "revenue_total", *[f"revenue_{d}d" for d in WINDOWS],
    "avg_order_value", "max_order_value", "items_per_order", "discount_share",
    "store_order_share", "app_order_share")
NUMERIC = ("email_opt_in", "tenure_days", *ORDER_FEATURES, "category_count", *SESSION_FEATURES,
           *EMAIL_FEATURES, *MEMBER_FEATURES, "support_contacts_180d", "low_csat_contacts_180d")
FEATURES = (*NUMERIC, *CLV_COLUMNS)
MONEY = ("revenue_total", *[f"revenue_{d}d" for d in WINDOWS], "avg_order_value",
         "max_order_value", "discount_share")


def customer_base(customers: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """(run, customer) rows for everyone whose first order precedes the run."""
    once = customers.groupBy("customer_id").agg(F.min("customer_since").alias("customer_since"))
    return fan_out(once, "customer_since", cutoffs).select(*KEYS)


def order_runs(orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    def columns(run: Column, seen: Column) -> dict[str, Column]:
        age = days_between("order_ts", run)
        return {
            "days_since_last_order": F.min(when(seen, age)), "_oldest": F.max(when(seen, age)),
            "orders_total": F.count_if(seen),
            **{f"orders_{d}d": F.count_if(seen & (age < d)) for d in WINDOWS},
            "revenue_total": F.sum(when(seen, "net_amount")),
            **{f"revenue_{d}d": F.sum(F.when(seen & (age < d), F.col("net_amount")).otherwise(0.0))
               for d in WINDOWS},
            "avg_order_value": F.avg(when(seen, "net_amount")),
            "max_order_value": F.max(when(seen, "net_amount")),
            "items_per_order": F.avg(when(seen, "item_count")),
            "_gross": F.sum(when(seen, "gross_amount")),
            "_discount": F.sum(when(seen, "discount_amount")),
            "store_order_share": F.avg(when(seen, flag(F.col("order_channel") == "store"))),
            "app_order_share": F.avg(when(seen, flag(F.col("order_channel") == "app")))}
    return per_run(orders, "customer_id", "order_ts", cutoffs, before(), columns, "orders")


def order_columns(part: str = "") -> list[Column]:
    at = lambda c: F.col(part + c)
    n = at("orders_total")
    gap = F.when(n > 1, (at("_oldest") - at("days_since_last_order")) / (n - 1)).otherwise(at("_oldest"))
    made = {"mean_days_between_orders": gap, "discount_share": ratio(at("_discount"), at("_gross"))}
    # Nobody without a visible order has a share of discounts.
    made["discount_share"] = F.when(n > 0, made["discount_share"])
    return [made.get(c, at(c)).alias(c) for c in ORDER_FEATURES]


def order_features(orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    return unfold(order_runs(orders, cutoffs), "customer_id", "orders").select(*KEYS, *order_columns())


def category_runs(orders: DataFrame, lines: DataFrame, products: DataFrame, cutoffs: Sequence[str]
                  ) -> DataFrame:
    first = (lines.select("order_id", "product_id")
             .join(products.select("product_id", "category"), "product_id")
             .join(orders.select("order_id", "customer_id", "order_ts"), "order_id")
             .groupBy("customer_id", "category").agg(F.min("order_ts").alias("first_ts")))
    return per_run(first, "customer_id", "first_ts", cutoffs, before(),
                   lambda run, seen: {"category_count": F.count_if(seen)}, "categories")


def category_counts(orders: DataFrame, lines: DataFrame, products: DataFrame,
                    cutoffs: Sequence[str]) -> DataFrame:
    """Distinct categories bought before each run, via the first purchase of each category."""
    return unfold(category_runs(orders, lines, products, cutoffs), "customer_id", "categories")


def future_revenue(base: DataFrame, orders: DataFrame, cutoffs: Sequence[str], horizon_days: int
                   ) -> DataFrame:
    """Net revenue in ``[run, run + horizon)``, 0 where there is none."""
    spend = unfold(per_run(orders, "customer_id", "order_ts", cutoffs, ahead(horizon_days),
                           lambda run, seen: {"_spend": F.sum(when(seen, "net_amount"))}), "customer_id")
    return base.join(spend, KEYS, "left").withColumn(
        "future_revenue", F.coalesce("_spend", F.lit(0.0))).drop("_spend")


def build_features(tables: Mapping[str, DataFrame], cutoffs: Sequence[str]) -> DataFrame:
    """One row per (run, customer), without the CLV columns (see ``build_rows``)."""
    orders = tables["orders"]
    parts = {"orders": order_runs(orders, cutoffs),
             "categories": category_runs(orders, tables["order_lines"], tables["products"], cutoffs),
             **activity_parts(tables, cutoffs)}
    base = join_parts(attributes(tables["customers"]), parts, "customer_id", len(cutoffs))
    rows = rows_of(base, list(parts), cutoffs).where("customer_since < run_cutoff").withColumn(
        "tenure_days", days_between("customer_since", "run_cutoff"))
    seen = F.col("orders._seen") > 0
    return rows.withColumn("orders", F.when(seen, F.col("orders"))).select(
        *KEYS, *CATEGORICAL, "email_opt_in", "tenure_days", *order_columns("orders."),
        F.when(F.col("categories.category_count") > 0, F.col("categories.category_count"))
        .alias("category_count"), *activity_columns()).select(*KEYS, *CATEGORICAL, *NUMERIC)


def build_rows(tables: Mapping[str, DataFrame], cutoffs: Sequence[str], horizon_days: int = HORIZON_DAYS
               ) -> DataFrame:
    """The whole feature row: history features and the CLV columns fitted to each run's history.

    A customer without purchases before the run has no CLV.
    """
    return build_features(tables, cutoffs).join(
        clv_features(tables["orders"], cutoffs, horizon_days), KEYS, "left")


def build_dataset(tables: Mapping[str, DataFrame], cutoffs: Sequence[str],
                  horizon_days: int = HORIZON_DAYS, data_start: str | None = None,
                  clv: bool = True) -> DataFrame:
    """Whole feature rows (without the fitted CLV columns if asked) with the revenue of the outcome window."""
    if data_start is not None:
        from datetime import date, timedelta
        for c in cutoffs:
            if date.fromisoformat(c) - timedelta(days=MIN_HISTORY_DAYS) < date.fromisoformat(
                    data_start):
                raise ValueError(f"run {c} has less than {MIN_HISTORY_DAYS} days of history")
    rows = build_rows(tables, cutoffs, horizon_days) if clv else build_features(tables, cutoffs)
    return future_revenue(rows, tables["orders"], cutoffs, horizon_days)


def leakage_audit(tables: Mapping[str, DataFrame], dataset: DataFrame, cutoffs: Sequence[str],
                  probe: str, horizon_days: int, train_runs: Sequence[str],
                  holdout_runs: Sequence[str], corr_limit: float = 0.9) -> DataFrame:
    """Violations per check, including the ledger reconciliation history + target."""
    from tidemark.operators.metrics import spearman
    dataset = cut(dataset)  # every check reads it
    orders = tables["orders"]
    keys = dataset.select(*KEYS)
    since = tables["customers"].select("customer_id", "customer_since")
    unborn = keys.join(since, "customer_id").agg(
        F.count_if(F.col("customer_since") >= F.col("run_cutoff")).alias("n"))
    at, run = F.col("order_ts"), F.col("run_cutoff")
    spent = events_of(dataset, KEYS, orders.select("customer_id", "order_ts", "net_amount"), "order_ts").where(
        (at >= run) & (at < plus_days(run, horizon_days))).groupBy(*KEYS).agg(F.sum("net_amount").alias("_again"))
    relabel = dataset.join(spent, KEYS, "left").agg(F.count_if(
        F.abs(F.coalesce("_again", F.lit(0.0)) - F.col("future_revenue")) > 0.005).alias("n"))
    upto = F.filter(F.array(*[ts(c) for c in cutoffs]),
                    lambda c: F.col("order_ts") < plus_days(c, horizon_days))
    total = orders.select("customer_id", "net_amount", F.explode(upto).alias("run_cutoff")).groupBy(
        *KEYS).agg(F.sum("net_amount").alias("_ledger"))
    gap = F.abs(F.col("revenue_total") + F.col("future_revenue") - F.coalesce(
        "_ledger", F.lit(0.0)))
    ledger = dataset.join(total, KEYS, "left").agg(
        F.count_if(gap > 0.01 + 1e-5 * F.abs("_ledger")).alias("n"))
    cols = [*KEYS, *CATEGORICAL, *NUMERIC]
    names = ("customers", "orders", "order_lines", "products", "sessions", "marketing_touches",
             "subscription_events", "support_contacts")

    full = dataset.where(F.col("run_cutoff") == ts(probe)).select(cols)
    redo = build_features(truncated(tables, names, probe), [probe]).select(cols)
    hold = dataset.where(F.col("run_cutoff").isin([ts(r) for r in holdout_runs]))
    strong = None
    for f in NUMERIC:
        one = spearman(hold.select(F.col(f).cast("double").alias(f), "future_revenue"), f,
                       "future_revenue").select("spearman")
        strong = one if strong is None else strong.unionByName(one)
    strong = strong.agg(F.count_if(F.abs("spearman") >= corr_limit).alias("n"))
    return check_rows(
        ("features_only_from_pre_cutoff_rows", late_rows(tables, dataset)),
        ("features_unchanged_when_future_rows_removed", changed_rows(full, redo, KEYS, MONEY)),
        ("labels_only_from_prediction_window", relabel),
        ("historical_spend_excludes_target_period", ledger),
        ("every_scored_customer_acquired_before_cutoff", unborn),
        ("train_labels_end_before_holdout_starts",
         cutoff_overlap(dataset, train_runs, holdout_runs, horizon_days)),
        ("no_single_feature_suspiciously_predictive", strong))

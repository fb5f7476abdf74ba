"""Active base, churn label and point-in-time customer features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cols import days_between, flag, hours_between, plus_days, ratio, ts
from tidemark.functions.lineage import cut
from tidemark.functions.runs import ahead, before, join_parts, per_run, rows_of, unfold
from tidemark.operators.leads import (
    added,
    changed_rows,
    check_rows,
    cutoff_overlap,
    events_of,
    recency_gaps,
    truncated,
)
from tidemark.operators.metrics import single_feature_auc

ACTIVE_DAYS, HORIZON_DAYS = 180, 90
SLOW_HOURS, LOW_CSAT = 24.0, 2
PLAN_DAYS = {"monthly": 30, "annual": 365}
CATEGORICAL = ("acquisition_channel", "region", "age_band", "income_band", "device_type")
ORDER_FEATURES = ("days_since_last_order", "orders_total", "orders_90d", "orders_prev_90d",
                  "net_revenue_180d", "avg_order_value", "discount_share",
                  "first_order_discounted", "store_order_share", "app_order_share")
SESSION_FEATURES = ("browse_sessions_30d", "browse_sessions_90d", "days_since_last_session")
EMAIL_FEATURES = ("emails_received_90d", "email_open_rate_90d", "email_clicks_90d")
MEMBER_FEATURES = ("plus_member", "plus_cancelled_180d")
SUPPORT_FEATURES = ("support_contacts_180d", "low_csat_contacts_180d",
                    "slow_resolution_contacts_180d", "open_contacts")
NUMERIC = ("email_opt_in", "tenure_days", *ORDER_FEATURES, "category_count", *SESSION_FEATURES,
           *EMAIL_FEATURES, *MEMBER_FEATURES, *SUPPORT_FEATURES)
KEYS = ["run_cutoff", "customer_id"]


def active_customers(orders: DataFrame, cutoffs: Sequence[str], active_days: int = ACTIVE_DAYS
                     ) -> DataFrame:
    """(run, customer) rows with an order in ``[run - active_days, run)``."""
    return unfold(per_run(orders, "customer_id", "order_ts", cutoffs, before(active_days),
                          lambda run, seen: {}), "customer_id")


def churn_labels(base: DataFrame, orders: DataFrame, cutoffs: Sequence[str], horizon_days: int
                 ) -> DataFrame:
    """1 if no order falls in ``[run, run + horizon)``."""
    buyers = unfold(per_run(orders, "customer_id", "order_ts", cutoffs, ahead(horizon_days),
                            lambda run, seen: {}), "customer_id")
    return base.join(buyers.withColumn("_b", F.lit(1)), KEYS, "left").withColumn(
        "churned", flag(F.col("_b").isNull())).drop("_b")


def when(seen: Column, value: Column | str) -> Column:
    return F.when(seen, F.col(value) if isinstance(value, str) else value)


def order_runs(orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    def columns(run: Column, seen: Column) -> dict[str, Column]:
        age = days_between("order_ts", run)
        return {
            "days_since_last_order": F.min(when(seen, age)),
            "orders_total": F.count_if(seen),
            "orders_90d": F.count_if(seen & (age < 90)),
            "orders_prev_90d": F.count_if(seen & (age >= 90) & (age < 180)),
            "net_revenue_180d": F.sum(F.when(seen & (age < 180), F.col("net_amount")).otherwise(0.0)),
            "avg_order_value": F.avg(when(seen, "net_amount")),
            "_gross": F.sum(when(seen, "gross_amount")),
            "_discount": F.sum(when(seen, "discount_amount")),
            "_first": F.min_by(when(seen, "discount_amount"),
                               when(seen, F.struct("order_ts", "order_id"))),
            "store_order_share": F.avg(when(seen, flag(F.col("order_channel") == "store"))),
            "app_order_share": F.avg(when(seen, flag(F.col("order_channel") == "app")))}
    return per_run(orders, "customer_id", "order_ts", cutoffs, before(), columns, "orders")


def order_columns(part: str = "") -> list[Column]:
    """The published order features of an unfolded part (a prefix such as ``orders.``)."""
    at = lambda c: F.col(part + c)
    plain = ("days_since_last_order", "orders_total", "orders_90d", "orders_prev_90d",
             "net_revenue_180d", "avg_order_value", "store_order_share", "app_order_share")
    return [*[at(c).alias(c) for c in plain],
            ratio(at("_discount"), at("_gross")).alias("discount_share"),
            flag(at("_first") > 0).alias("first_order_discounted")]


def order_features(orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Recency, frequency, value and mix in one conditional aggregation over all runs."""
    return unfold(order_runs(orders, cutoffs), "customer_id", "orders").select(
        *KEYS, *order_columns())


def line_runs(orders: DataFrame, lines: DataFrame, products: DataFrame, cutoffs: Sequence[str]
              ) -> DataFrame:
    """Lines are reduced to (order, category), then to (customer, category), then to customers."""
    margin = F.col("net_amount") - F.col("quantity") * F.col("unit_cost")
    per_order = (lines.select("order_id", "product_id", "quantity", "net_amount")
                 .join(products.select("product_id", "category", "unit_cost"), "product_id")
                 .groupBy("order_id", "category").agg(F.sum(margin).alias("margin")))
    o = per_order.join(orders.select("order_id", "customer_id", "order_ts"), "order_id")
    t = F.col("order_ts")
    recent = {i: (t < ts(c)) & (t > plus_days(ts(c), -180)) for i, c in enumerate(cutoffs)}
    per_cat = o.groupBy("customer_id", "category").agg(
        F.min("order_ts").alias("first_ts"),
        *[F.sum(F.when(ok, F.col("margin")).otherwise(0.0)).alias(f"m{i}")
          for i, ok in recent.items()])
    per = per_cat.groupBy("customer_id").agg(
        *[F.count_if(F.col("first_ts") < ts(c)).alias(f"n{i}") for i, c in enumerate(cutoffs)],
        *[F.sum(f"m{i}").alias(f"m{i}") for i in recent])
    runs = F.array(*[F.struct(ts(c).alias("run_cutoff"), F.col(f"n{i}").alias("category_count"),
                              F.greatest(f"m{i}", F.lit(0.0)).alias("margin_180d"))
                     for i, c in enumerate(cutoffs)])
    return per.select("customer_id", runs.alias("lines"))


def line_features(orders: DataFrame, lines: DataFrame, products: DataFrame,
                  cutoffs: Sequence[str]) -> DataFrame:
    """Category breadth and trailing margin per run."""
    return line_runs(orders, lines, products, cutoffs).select("customer_id", F.inline("lines")).where(
        "category_count > 0").select(*KEYS, "category_count", "margin_180d")


def session_runs(sessions: DataFrame, orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    bought = orders.where("session_id is not null").select("session_id", "order_ts").groupBy(
        "session_id").agg(F.min("order_ts").alias("_ordered"))
    s = sessions.where("customer_id is not null").select(
        "session_id", "customer_id", "session_start").join(bought, "session_id", "left")

    def columns(run: Column, seen: Column) -> dict[str, Column]:
        age = days_between("session_start", run)
        browse = seen & ~F.coalesce(F.col("_ordered") < run, F.lit(False))
        return {"browse_sessions_30d": F.count_if(browse & (age < 30)),
                "browse_sessions_90d": F.count_if(browse & (age < 90)),
                "days_since_last_session": F.min(when(seen, age))}
    return per_run(s, "customer_id", "session_start", cutoffs, before(), columns, "sessions")


def session_features(sessions: DataFrame, orders: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Browsing sessions (those not ending in an order known at the run) and recency."""
    return unfold(session_runs(sessions, orders, cutoffs), "customer_id", "sessions")


def email_runs(touches: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    t = touches.where("customer_id is not null and touch_type = 'email'").select(
        "customer_id", "touch_at", "opened", "clicked")

    def columns(run: Column, seen: Column) -> dict[str, Column]:
        got, opened = F.count_if(seen), F.count_if(seen & F.col("opened"))
        return {"emails_received_90d": got, "email_clicks_90d": F.count_if(seen & F.col("clicked")),
                "email_open_rate_90d": ratio(opened, got)}
    return per_run(t, "customer_id", "touch_at", cutoffs, before(90), columns, "emails")


def email_features(touches: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    return unfold(email_runs(touches, cutoffs), "customer_id", "emails")


def membership_runs(subs: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    days = F.when(F.col("plan") == "annual", PLAN_DAYS["annual"]).otherwise(PLAN_DAYS["monthly"])
    s = subs.select("customer_id", "event_ts", "event_type", "subscription_event_id",
                    F.timestamp_add("DAY", days, "event_ts").alias("_until"))

    def columns(run: Column, seen: Column) -> dict[str, Column]:
        cancel = F.col("event_type") == "cancel"
        paid = seen & ~cancel
        recent = seen & cancel & (F.col("event_ts") >= plus_days(run, -180))
        until = F.max_by(when(paid, "_until"), when(paid, F.struct("event_ts", "subscription_event_id")))
        return {"plus_member": flag(until > run), "plus_cancelled_180d": F.max(flag(recent))}
    return per_run(s, "customer_id", "event_ts", cutoffs, before(), columns, "member")


def membership_features(subs: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Whether the latest payment's period covers the run, and a cancel request in 180 days.

    Of payments at the same instant the one with the larger event id counts.
    """
    return unfold(membership_runs(subs, cutoffs), "customer_id", "member")


def support_runs(contacts: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    def columns(run: Column, seen: Column) -> dict[str, Column]:
        known = F.coalesce(F.col("resolved_at") < run, F.lit(False))
        recent = seen & (F.col("contact_ts") >= plus_days(run, -180))
        rated = (known | F.col("resolved_at").isNull()) & (F.col("csat_score") <= LOW_CSAT)
        slow = known & (hours_between("contact_ts", "resolved_at") > SLOW_HOURS)
        return {"support_contacts_180d": F.count_if(recent),
                "low_csat_contacts_180d": F.count_if(recent & rated),
                "slow_resolution_contacts_180d": F.count_if(recent & slow),
                "open_contacts": F.count_if(seen & ~known)}
    return per_run(contacts.select("customer_id", "contact_ts", "resolved_at", "csat_score"),
                   "customer_id", "contact_ts", cutoffs, before(), columns, "support")


def support_features(contacts: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Service experience as known at each run: later resolutions count as open."""
    return unfold(support_runs(contacts, cutoffs), "customer_id", "support")


def activity_parts(tables: Mapping[str, DataFrame], cutoffs: Sequence[str]) -> dict[str, DataFrame]:
    """Session, email, membership and support features, one row per customer each."""
    return {"sessions": session_runs(tables["sessions"], tables["orders"], cutoffs),
            "emails": email_runs(tables["marketing_touches"], cutoffs),
            "member": membership_runs(tables["subscription_events"], cutoffs),
            "support": support_runs(tables["support_contacts"], cutoffs)}


def activity_columns() -> list[Column]:
    """The activity features of unfolded parts, with the documented fills."""
    def filled(part: str, names: Sequence[str]) -> list[Column]:
        return [F.coalesce(F.col(f"{part}.{c}"), F.lit(0)).alias(c) for c in names]
    return [*filled("sessions", SESSION_FEATURES[:2]),
            F.coalesce("sessions.days_since_last_session", "tenure_days").alias(SESSION_FEATURES[2]),
            *filled("emails", ("emails_received_90d", "email_clicks_90d")),
            F.coalesce("emails.email_open_rate_90d", F.lit(0.0)).alias("email_open_rate_90d"),
            *filled("member", MEMBER_FEATURES), *filled("support", SUPPORT_FEATURES)]


def attributes(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "customer_since", *CATEGORICAL,
                            F.col("email_opt_in").cast("int").alias("email_opt_in"))


def build_features(tables: Mapping[str, DataFrame], cutoffs: Sequence[str],
                   active_days: int = ACTIVE_DAYS) -> DataFrame:
    """One row per (run, active customer) with features and the trailing margin."""
    orders = tables["orders"]
    base = order_runs(orders, cutoffs).join(attributes(tables["customers"]), "customer_id")
    parts = {"lines": line_runs(orders, tables["order_lines"], tables["products"], cutoffs),
             **activity_parts(tables, cutoffs)}
    rows = rows_of(join_parts(base, parts, "customer_id", len(cutoffs)), ["orders", *parts], cutoffs)
    # The base is the part of the order aggregate whose last order is recent enough.
    rows = rows.where(F.col("orders.days_since_last_order") <= active_days).withColumn(
        "tenure_days", days_between("customer_since", "run_cutoff"))
    return rows.select(
        *KEYS, *CATEGORICAL, "email_opt_in", "tenure_days", *order_columns("orders."),
        F.when(F.col("lines.category_count") > 0, F.col("lines.category_count")).alias("category_count"),
        *activity_columns(), F.coalesce("lines.margin_180d", F.lit(0.0)).alias("margin_180d")).select(
        *KEYS, *CATEGORICAL, *NUMERIC, "margin_180d")


def build_dataset(tables: Mapping[str, DataFrame], cutoffs: Sequence[str],
                  horizon_days: int = HORIZON_DAYS, active_days: int = ACTIVE_DAYS,
                  data_start: str | None = None) -> DataFrame:
    if data_start is not None:
        from datetime import date, timedelta
        for c in cutoffs:
            if date.fromisoformat(c) - timedelta(days=active_days) < date.fromisoformat(
                    data_start):
                raise ValueError(f"run {c} has less than {active_days} days of history")
    return churn_labels(build_features(tables, cutoffs, active_days), tables["orders"], cutoffs,
                        horizon_days)


def late_rows(tables: Mapping[str, DataFrame], dataset: DataFrame) -> DataFrame:
    """Rows whose recency shows an event that is not the last one before the run."""
    return added(
        recency_gaps(dataset, KEYS, "days_since_last_order",
                     tables["orders"].select("customer_id", "order_ts"), "order_ts"),
        recency_gaps(dataset, KEYS, "days_since_last_session", tables["sessions"].select(
            "customer_id", "session_start"), "session_start", "tenure_days"))


def leakage_audit(tables: Mapping[str, DataFrame], dataset: DataFrame, cutoffs: Sequence[str],
                  probe: str, horizon_days: int, train_runs: Sequence[str],
                  holdout_runs: Sequence[str], active_days: int = ACTIVE_DAYS,
                  auc_limit: float = 0.9) -> DataFrame:
    dataset = cut(dataset)  # every check reads it
    keys = dataset.select(*KEYS)
    since = tables["customers"].select("customer_id", "customer_since")
    unborn = keys.join(since, "customer_id").agg(
        F.count_if(F.col("customer_since") >= F.col("run_cutoff")).alias("n"))
    idle = keys.join(active_customers(tables["orders"], cutoffs, active_days), KEYS,
                     "left_anti").agg(F.count(F.lit(1)).alias("n"))
    at, run = F.col("order_ts"), F.col("run_cutoff")
    buyers = events_of(dataset, KEYS, tables["orders"].select("customer_id", "order_ts"), "order_ts").where(
        (at >= run) & (at < plus_days(run, horizon_days))).select(*KEYS).distinct()
    redo_labels = dataset.join(buyers.withColumn("_b", F.lit(1)), KEYS, "left").agg(
        F.count_if(F.col("churned") != flag(F.col("_b").isNull())).alias("n"))
    cols = [*KEYS, *CATEGORICAL, *NUMERIC, "margin_180d"]
    names = ("customers", "orders", "order_lines", "products", "sessions", "marketing_touches",
             "subscription_events", "support_contacts")
    money = ("net_revenue_180d", "avg_order_value", "margin_180d", "discount_share")

    full = dataset.where(F.col("run_cutoff") == ts(probe)).select(cols)
    redo = build_features(truncated(tables, names, probe), [probe], active_days).select(cols)
    hold = dataset.where(F.col("run_cutoff").isin([ts(r) for r in holdout_runs]))
    strong = single_feature_auc(hold, NUMERIC, "churned").agg(
        F.count_if(F.col("auc") >= auc_limit).alias("n"))
    return check_rows(
        ("features_only_from_pre_cutoff_rows", late_rows(tables, dataset)),
        ("features_unchanged_when_future_rows_removed", changed_rows(full, redo, KEYS, money)),
        ("labels_only_from_prediction_window", redo_labels),
        ("every_scored_customer_active_at_cutoff", idle),
        ("every_scored_customer_acquired_before_cutoff", unborn),
        ("train_labels_end_before_holdout_starts",
         cutoff_overlap(dataset, train_runs, holdout_runs, horizon_days)),
        ("no_single_feature_suspiciously_predictive", strong))

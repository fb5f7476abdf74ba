"""Data-quality rules: every rule reports (table_name, rule, violations); zero means clean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import day_of, flag, true_or_false, ts
from tidemark.operators.experiment import variant
from tidemark.schema import KINDS, TABLES, Table

MONEY_TOL = 0.011
SUM_TOL = 0.11
Rules = Mapping[str, Column]


def count_rules(df: DataFrame, table: str, rules: Rules) -> DataFrame:
    """All rules of a table in one aggregation, unpivoted to one row per rule."""
    one = df.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations"))
                      for r in rules])
    return one.select(F.lit(table).alias("table_name"), F.inline(pairs))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ------------------------------------------------------------------ schema rules
def schema_issues(tables: Mapping[str, DataFrame], specs: Mapping[str, Table] = TABLES
                  ) -> list[str]:
    """Missing tables, column lists and types: metadata only, no data pass."""
    issues = [f"missing table {n}" for n in specs if n not in tables]
    for name, spec in specs.items():
        if name not in tables:
            continue
        df = tables[name]
        if df.columns != spec.names:
            issues.append(f"{name}: columns {df.columns} != {spec.names}")
            continue
        for c in spec.columns:
            if df.schema[c.name].dataType != KINDS[c.kind]:
                issues.append(f"{name}.{c.name}: {df.schema[c.name].dataType} is not {c.kind}")
    return issues


def value_rules(df: DataFrame, spec: Table, start: str, end: str) -> DataFrame:
    """Nulls, domains and time range of a table in one scan (V1, V3, V4, V6)."""
    cols = [c for c in spec.columns if c.name in df.columns]
    rules: dict[str, Column] = {}
    for c in cols:
        v = F.col(c.name)
        if not c.nullable:
            rules[f"{c.name}: null"] = v.isNull()
        if c.allowed is not None:
            rules[f"{c.name}: outside domain"] = v.isNotNull() & ~v.isin(*c.allowed)
    if spec.time_column:
        t = F.col(spec.time_column)
        rules[f"{spec.time_column}: outside range"] = (t < ts(start)) | (t >= ts(end))
    out = [count_rules(df, spec.name, rules)] if rules else []
    empty = df.agg(F.lit(spec.name).alias("table_name"), F.lit("empty").alias("rule"),
                   (F.count(F.lit(1)) == 0).cast("bigint").alias("violations"))
    return union([*out, empty])


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str], top: int = 5
                      ) -> DataFrame:
    """Values outside a domain; the report shows the first ``top`` of them."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(
        column).agg(F.count(F.lit(1)).alias("rows"))
    return bad.orderBy(column).limit(top)


def key_rules(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Null and duplicate primary keys (rows beyond the first of each key)."""
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(nulls, F.col("n"))), F.lit(0)).alias("null primary key"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate primary key")).select(
        F.lit(name).alias("table_name"), F.inline(F.array(*[
            F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations"))
            for r in ("null primary key", "duplicate primary key")])))


def foreign_key_orphans(child: DataFrame, name: str, column: str, parent: DataFrame,
                        parent_name: str, parent_column: str) -> DataFrame:
    """Non-null references without a parent; children are counted per key before the join."""
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(
        F.count(F.lit(1)).alias("n"))
    lost = keys.join(parent.select(F.col(parent_column).alias("_k")), "_k", "left_anti")
    return lost.agg(F.lit(name).alias("table_name"),
                    F.lit(f"{column} missing from {parent_name}").alias("rule"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def foreign_keys(tables: Mapping[str, DataFrame], specs: Mapping[str, Table] = TABLES
                 ) -> DataFrame:
    return union([foreign_key_orphans(tables[n], n, col, tables[ref], ref, ref_col)
                  for n, spec in specs.items() if n in tables
                  for col, ref, ref_col in spec.references
                  if ref in tables and col in tables[n].columns])


# ------------------------------------------------------------------ business rules
COPIED = ("acquisition_channel", "region", "age_band", "income_band", "device_type",
          "email_opt_in")


def people(prospects: DataFrame, customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    p = prospects.select("prospect_id", "created_at", *[F.col(c).alias(f"_{c}") for c in COPIED])
    m = customers.join(p, "prospect_id")
    rules = {f"{c} differs from prospect": F.col(c) != F.col(f"_{c}") for c in COPIED}
    rules["converted before created"] = F.col("customer_since") < F.col("created_at")
    twice = customers.groupBy("prospect_id").agg(F.count(F.lit(1)).alias("n"))
    c = campaigns.select("campaign_id", "channel", "start_date", "end_date")
    camp = prospects.join(c, "campaign_id", "left")
    organic = F.col("acquisition_channel") == "organic_search"
    day = day_of("created_at")
    outside = (day < day_of("start_date")) | (day > day_of("end_date"))
    return union([
        count_rules(m, "customers", rules),
        count_rules(twice, "customers", {"prospect converted twice": F.col("n") > 1}),
        id_order(customers, "customer_id", "customer_since", "customers"),
        count_rules(camp, "prospects", {
            "campaign null exactly for organic": organic != F.col("campaign_id").isNull(),
            "campaign channel differs": true_or_false(
                ~organic & (F.col("channel") != F.col("acquisition_channel"))),
            "campaign not live on creation day": true_or_false(~organic & outside)})])


def id_order(df: DataFrame, entity: str, at: str, name: str) -> DataFrame:
    """Rows whose time precedes the previous id's time.

    The predecessor may sit in another id bucket, so buckets are compared through their last row.
    """
    from tidemark.operators.ranking import _id_bucket, id_range_bounds
    b = df.select(entity, F.col(at).alias("_at"),
                  _id_bucket(F.col(entity), id_range_bounds(df, entity)).alias("_b"))
    last = b.groupBy("_b").agg(F.max_by("_at", entity).alias("_last"))
    carry = last.select("_b", F.lag("_last").over(
        Window.partitionBy(F.lit(0)).orderBy("_b")).alias("_carry"))  # one row per bucket
    prev = F.coalesce(F.lag("_at").over(Window.partitionBy("_b").orderBy(entity)),
                      F.col("_carry"))
    j = b.join(carry, "_b").select((F.col("_at") < prev).alias("bad"))
    return count_rules(j, name, {"ids not in time order": true_or_false(F.col("bad"))})


def customer_id_timing(df: DataFrame, at: str, name: str, customers: DataFrame) -> DataFrame:
    c = customers.select("prospect_id", F.col("customer_id").alias("_expected"), "customer_since")
    m = df.select("prospect_id", "customer_id", at).join(c, "prospect_id", "left")
    has = F.col("customer_id").isNotNull()
    after = true_or_false(F.col(at) >= F.col("customer_since"))
    return count_rules(m, name, {
        "customer_id presence disagrees with conversion": after != has,
        "customer_id of another person": has & ~F.col("customer_id").eqNullSafe(
            F.col("_expected")) & F.col("_expected").isNotNull()})


def stage_profile(events: DataFrame) -> DataFrame:
    """(session, stage) counts and time bounds: everything the funnel rules need, and bounded
    by the number of stages per session however many events a session logs."""
    return events.groupBy("session_id", "stage_number").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"))


def backward_steps(profile: DataFrame) -> Column:
    """1 where a stage starts before the last event of the previous stage present."""
    prev = F.lag("last_ts").over(Window.partitionBy("session_id").orderBy("stage_number"))
    return flag(F.col("first_ts") < prev)


def funnel(sessions: DataFrame, events: DataFrame) -> DataFrame:
    p = stage_profile(events)
    per = p.withColumn("_back", backward_steps(p)).groupBy("session_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("stages"),
        F.min("stage_number").alias("lo"), F.max("stage_number").alias("hi"),
        F.sum("_back").alias("back"),
        F.max(F.when(F.col("stage_number") == 1, F.col("first_ts"))).alias("start_ts"),
        F.max(F.when(F.col("stage_number") == 1, F.col("n"))).alias("starts"))
    j = sessions.select("session_id", "session_start").join(per, "session_id", "full_outer")
    return union([
        count_rules(per, "funnel_events", {
            "stages skipped or repeated": (F.col("n") != F.col("hi"))
            | (F.col("stages") != F.col("n")) | (F.col("lo") != 1)}),
        per.agg(F.lit("funnel_events").alias("table_name"),
                F.lit("event earlier than previous stage").alias("rule"),
                F.coalesce(F.sum("back"), F.lit(0)).alias("violations")),
        count_rules(j, "funnel_events", {
            "session without exactly one start": F.coalesce("starts", F.lit(0)) != 1,
            "start event time differs": true_or_false(F.col("start_ts")
                                                      != F.col("session_start"))})])


def order_arithmetic(orders: DataFrame, lines: DataFrame) -> DataFrame:
    net, gross, disc = F.col("net_amount"), F.col("gross_amount"), F.col("discount_amount")
    line_net = F.col("quantity") * F.col("unit_price") - disc
    sums = lines.groupBy("order_id").agg(F.sum("quantity").alias("_q"),
                                         F.sum("discount_amount").alias("_d"),
                                         F.sum("net_amount").alias("_n"))
    j = orders.join(sums, "order_id", "left")
    return union([
        count_rules(orders, "orders", {
            "net != gross - discount": F.abs(net - (gross - disc)) > MONEY_TOL,
            "negative amount or discount above gross": (gross < 0) | (disc < 0) | (net <= 0)
            | (disc > gross)}),
        count_rules(lines, "order_lines", {
            "net != quantity * price - discount": F.abs(line_net - net) > MONEY_TOL,
            "non-positive quantity": F.col("quantity") <= 0}),
        count_rules(j, "orders", {
            "order without lines": F.col("_q").isNull(),
            "item_count != sum of lines": true_or_false(F.col("_q") != F.col("item_count")),
            "discount != sum of lines": true_or_false(F.abs(disc - F.col("_d")) > SUM_TOL),
            "net != sum of lines": true_or_false(F.abs(net - F.col("_n")) > SUM_TOL)})])


def first_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    first = orders.groupBy("customer_id").agg(F.min("order_ts").alias("_first"))
    j = customers.select("customer_id", "customer_since").join(first, "customer_id", "full_outer")
    store = F.col("order_channel") == "store"
    return union([
        count_rules(j, "customers", {
            "customer without order": F.col("_first").isNull(),
            "order of unknown customer": F.col("customer_since").isNull(),
            "customer_since != first order": true_or_false(F.col("_first")
                                                           != F.col("customer_since"))}),
        count_rules(orders, "orders", {"session null exactly for store":
                                       store == F.col("session_id").isNotNull()})])


def purchase_links(orders: DataFrame, events: DataFrame, sessions: DataFrame,
                   customers: DataFrame) -> DataFrame:
    """Digital orders and purchase events one to one; time, platform and person agree."""
    digital = orders.where("order_channel <> 'store'").select(
        "order_id", "customer_id", "order_ts", "order_channel", "session_id")
    bought = events.where("event_type = 'purchase'").select("session_id", "event_ts")
    d_keys = digital.groupBy("session_id").agg(F.count(F.lit(1)).alias("_orders"))
    p_keys = bought.select("session_id").distinct().withColumn("_bought", F.lit(1))
    both = d_keys.join(p_keys, "session_id", "full_outer")
    # a session with many purchases and many orders would multiply: compare each order to the
    # session's set of purchase times instead of joining the events one by one
    times = bought.groupBy("session_id").agg(F.min("event_ts").alias("_first_buy"),
                                             F.max("event_ts").alias("_last_buy"))
    exact = digital.join(bought.select("session_id", F.col("event_ts").alias("order_ts"))
                         .distinct(), ["session_id", "order_ts"], "left_anti")
    exact = exact.join(times, "session_id", "left_semi")
    m = digital.join(sessions.select("session_id", F.col("prospect_id").alias("_sp"),
                                     F.col("platform").alias("_platform")), "session_id").join(
        customers.select("customer_id", F.col("prospect_id").alias("_cp")), "customer_id")
    return union([
        count_rules(both, "orders", {
            "session linked to several orders": true_or_false(F.col("_orders") > 1),
            "purchase event without order": F.col("_orders").isNull(),
            "order without purchase event": F.col("_bought").isNull()}),
        exact.agg(F.lit("orders").alias("table_name"),
                  F.lit("order time differs from purchase event").alias("rule"),
                  F.count(F.lit(1)).alias("violations")),
        count_rules(m, "orders", {
            "channel differs from session platform": F.col("_platform") != F.col("order_channel"),
            "session of another person": F.col("_sp") != F.col("_cp")})])


def discounts(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    c = campaigns.select("campaign_id", "discount_pct", "objective", "start_date", "end_date")
    oc = orders.where("campaign_id is not null").join(c, "campaign_id")
    expected = F.round(F.col("gross_amount") * F.col("discount_pct"), 2)
    # in decimals: as doubles 0.01 + 0.011 is below 0.021, so a gap of just the tolerance would count
    allowed = (F.lit(Decimal("0.01")) * F.col("item_count") + F.lit(Decimal(str(MONEY_TOL)))).cast("double")
    day = day_of("order_ts")
    outside = (day < day_of("start_date")) | (day > day_of("end_date"))
    return union([
        count_rules(oc, "orders", {
            "discount differs from campaign": F.abs(F.col("discount_amount") - expected) > allowed,
            "promotion outside its dates": (F.col("objective") == "promotion") & outside}),
        count_rules(orders, "orders", {"discount without campaign":
                                       F.col("campaign_id").isNull()
                                       & (F.col("discount_amount") > 0)})])


def membership_states(subs: DataFrame, grain: str = "DAY") -> DataFrame:
    """Each membership event with the plan in force just before it (null: no plan).

    Replaying a customer's events in one window would tie a hot customer to one task. The log is
    cut into (customer, time grain) pieces: each piece's last subscribe/cancel is carried over the
    pieces before it, and only the rows of one piece are replayed together.
    """
    e = subs.withColumn("_g", F.date_trunc(grain, "event_ts"))
    key = F.struct("event_ts", "subscription_event_id")
    change = F.col("event_type").isin("subscribe", "cancel")
    after = F.struct(F.when(F.col("event_type") == "subscribe", F.col("plan")).alias("plan"))
    pieces = e.groupBy("customer_id", "_g").agg(
        F.max_by(F.when(change, after), F.when(change, key)).alias("_end"))
    before = Window.partitionBy("customer_id").orderBy("_g").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = pieces.select("customer_id", "_g", F.last("_end", ignorenulls=True).over(before)
                          .alias("_carry"))
    inside = Window.partitionBy("customer_id", "_g").orderBy(
        "event_ts", "subscription_event_id").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(F.when(change, after), ignorenulls=True).over(inside),
                       F.col("_carry"))
    return e.join(carry, ["customer_id", "_g"]).withColumn("_state", state).withColumn(
        "current_plan", F.col("_state.plan")).drop("_g", "_carry", "_state")


def invalid_membership(states: DataFrame) -> Column:
    valid = F.when(F.col("event_type") == "subscribe", F.col("current_plan").isNull()).otherwise(
        F.col("current_plan").eqNullSafe(F.col("plan")))
    return ~valid


def subscriptions(subs: DataFrame, customers: DataFrame) -> DataFrame:
    s = membership_states(subs)
    bad = s.where(invalid_membership(s)).agg(
        F.lit("subscription_events").alias("table_name"),
        F.lit("customers with invalid sequence").alias("rule"),
        F.countDistinct("customer_id").alias("violations"))
    m = subs.join(customers.select("customer_id", "customer_since"), "customer_id")
    return bad.unionByName(count_rules(m, "subscription_events", {
        "event before first order": F.col("event_ts") < F.col("customer_since")}))


def support(contacts: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    sc = contacts.join(customers.select("customer_id", "customer_since"), "customer_id")
    o = orders.select("order_id", F.col("customer_id").alias("_oc"), "order_ts")
    linked = sc.where("order_id is not null").join(o, "order_id")
    csat = F.col("csat_score")
    return union([
        count_rules(sc, "support_contacts", {
            "contact before customer": F.col("contact_ts") < F.col("customer_since"),
            "resolved before opened": true_or_false(F.col("resolved_at") < F.col("contact_ts")),
            "csat on unresolved": F.col("resolved_at").isNull() & csat.isNotNull(),
            "csat outside 1-5": true_or_false((csat < 1) | (csat > 5))}),
        count_rules(linked, "support_contacts", {
            "order of another customer": F.col("customer_id") != F.col("_oc"),
            "contact before order": F.col("contact_ts") < F.col("order_ts")})])


def experiments(assignments: DataFrame, registry: DataFrame, sessions: DataFrame,
                customers: DataFrame) -> DataFrame:
    r = registry.select("experiment_id", "start_date", "end_date", "treatment_share")
    a = assignments.join(r, "experiment_id")
    want = variant(F.col("experiment_id"), F.col("prospect_id"), F.col("treatment_share"))
    day = day_of("assigned_at")
    since = customers.select("prospect_id", "customer_since")
    # windows are spread over their days, so sessions meet them on an equality of days
    windows = r.select("experiment_id", F.explode(F.sequence(
        day_of("start_date"), day_of("end_date"))).alias("_day"))
    s = sessions.where("customer_id is null").select(
        "prospect_id", "session_start", day_of("session_start").alias("_day")).join(
        windows, "_day")
    first = s.groupBy("experiment_id", "prospect_id").agg(F.min("session_start").alias("_first"))
    j = assignments.join(first, ["experiment_id", "prospect_id"], "full_outer")
    return union([
        count_rules(a.join(since, "prospect_id", "left"), "experiment_assignments", {
            "variant differs from hash rule": F.col("variant") != want,
            "assigned outside window": (day < day_of("start_date")) | (day > day_of("end_date")),
            "assigned after converting": true_or_false(F.col("assigned_at")
                                                       >= F.col("customer_since"))}),
        count_rules(j, "experiment_assignments", {
            "not assigned at first in-window session":
            ~F.col("_first").eqNullSafe(F.col("assigned_at"))})])


def touches(t: DataFrame) -> DataFrame:
    return count_rules(t, "marketing_touches", {"clicked without open": F.col("clicked")
                                                & ~F.col("opened"),
                                                "negative cost": F.col("cost") < 0})


def business_rules(t: Mapping[str, DataFrame]) -> DataFrame:
    """Every business rule of the journey as one report."""
    c = t["customers"]
    return union([
        people(t["prospects"], c, t["campaigns"]),
        customer_id_timing(t["sessions"], "session_start", "sessions", c),
        customer_id_timing(t["marketing_touches"], "touch_at", "marketing_touches", c),
        funnel(t["sessions"], t["funnel_events"]),
        order_arithmetic(t["orders"], t["order_lines"]), first_orders(t["orders"], c),
        purchase_links(t["orders"], t["funnel_events"], t["sessions"], c),
        discounts(t["orders"], t["campaigns"]), subscriptions(t["subscription_events"], c),
        support(t["support_contacts"], c, t["orders"]),
        experiments(t["experiment_assignments"], t["experiments"], t["sessions"], c),
        touches(t["marketing_touches"])])


def validate_all(spark: SparkSession, tables: Mapping[str, DataFrame], start: str, end: str,
                 specs: Mapping[str, Table] = TABLES) -> tuple[str, DataFrame]:
    """(stage reached, violations): business rules run only on sound schema and keys."""
    shape = schema_issues(tables, specs)
    empty = "table_name string, rule string, violations bigint"
    if shape:
        return "schema", spark.createDataFrame([("schema", s, 1) for s in shape], empty)
    values = union([value_rules(tables[n], s, start, end) for n, s in specs.items()]
                   + [key_rules(tables[n], n, s.key) for n, s in specs.items()]).where(
        "violations > 0")
    if not values.isEmpty():
        return "values", values
    keys = foreign_keys(tables, specs).where("violations > 0")
    if not keys.isEmpty():
        return "foreign_keys", keys
    return "business", business_rules(tables).where("violations > 0")

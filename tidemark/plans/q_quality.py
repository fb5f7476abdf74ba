"""Data-quality queries over the journey (and ledger) tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemark.operators import quality as q
from tidemark.plans.registry import ORACLE, query
from tidemark.schema import TABLES
from tidemark.sources import adapters as ad
from tidemark.sources.oracle_views import with_views


def _rules(table: str, source: str, rules: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{r.replace(chr(39), chr(39) * 2)}' AS rule, "
        f"count(*) FILTER ({cond}) AS violations FROM {source}" for r, cond in rules.items())


def report(*parts: str) -> str:
    body = "\nUNION ALL ".join(parts)
    return f"SELECT table_name, rule, CAST(violations AS BIGINT) AS violations FROM ({body})"


def _big(df):
    return df.withColumn("violations", F.col("violations").cast("bigint"))


JOURNEY_VIEWS = {
    "prospects": "j_prospects", "customers": "j_customers", "sessions": "j_sessions",
    "funnel_events": "j_funnel", "marketing_touches": "j_touches", "orders": "j_orders",
    "order_lines": "j_lines", "subscription_events": "j_subs", "support_contacts": "j_contacts",
    "campaigns": "j_campaigns", "experiments": "j_experiments", "products": "part",
    "experiment_assignments": "j_assignments"}


VIEWS = {**JOURNEY_VIEWS, "products": "(SELECT p_partkey AS product_id FROM part)"}


@query("v1_missing_and_empty", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(count(*) = 0 AS BIGINT) AS empty FROM {v}"
    for n, v in JOURNEY_VIEWS.items())))
def v1(spark, sf):
    t = ad.journey(spark, sf)
    return q.union([t[n].agg(F.lit(n).alias("table_name"),
                             (F.count(F.lit(1)) == 0).cast("bigint").alias("empty"))
                    for n in TABLES])


@query("v2_type_mismatches")
def v2(spark, sf):
    t = ad.journey(spark, sf)
    issues = q.schema_issues({k: t[k] for k in TABLES}, TABLES)
    rows = t["sessions"].agg(F.count(F.lit(1)).alias("rows_checked"))
    return rows.withColumn("issue", F.explode(F.array(*[F.lit(i) for i in issues or ["none"]])))


@query("v3_nulls_domains_range", with_views(report(
    _rules("sessions", "j_sessions", {
        "session_id: null": "session_id IS NULL", "prospect_id: null": "prospect_id IS NULL",
        "session_start: null": "session_start IS NULL", "platform: null": "platform IS NULL",
        "platform: outside domain": "platform NOT IN ('web', 'app')",
        "device_type: null": "device_type IS NULL",
        "device_type: outside domain": "device_type NOT IN ('desktop', 'mobile', 'tablet')",
        "traffic_source: null": "traffic_source IS NULL",
        "pages_viewed: null": "pages_viewed IS NULL",
        "session_start: outside range": "session_start < TIMESTAMP '2024-01-03' OR "
                                        "session_start >= TIMESTAMP '2024-01-30'"}),
    "SELECT 'sessions', 'empty', CAST(count(*) = 0 AS BIGINT) FROM j_sessions")))
def v3(spark, sf):
    return _big(q.value_rules(ad.journey(spark, sf)["sessions"], TABLES["sessions"], "2024-01-03",
                              "2024-01-30"))


@query("v4_unexpected_values", with_views("""
SELECT acquisition_channel, count(*) AS rows FROM g_customers
WHERE acquisition_channel NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1 ORDER BY 1 LIMIT 5"""))
def v4(spark, sf):
    return q.unexpected_values(ad.ledger(spark, sf)["customers"], "acquisition_channel",
                               ("BUILDING", "MACHINERY"))


def _keys_sql(name: str, spec) -> str:
    view, key = VIEWS[name], ", ".join(spec.key)
    null = " OR ".join(f"{k} IS NULL" for k in spec.key)
    return (f"SELECT '{name}' AS table_name, 'null primary key' AS rule, count(*) FILTER ({null}) AS violations FROM {view} "
            f"UNION ALL SELECT '{name}', 'duplicate primary key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) "
            f"FROM (SELECT count(*) AS n FROM {view} GROUP BY {key})")


@query("v5_primary_keys", with_views(report(*[_keys_sql(n, spec) for n, spec in TABLES.items()])))
def v5(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.union([q.key_rules(t[n], n, spec.key) for n, spec in TABLES.items()]))


@query("v5_duplicate_composite_key", with_views("""
SELECT 'subscription_events' AS table_name, 'null primary key' AS rule,
       count(*) FILTER (customer_id IS NULL OR event_type IS NULL) AS violations FROM g_subs
UNION ALL SELECT 'subscription_events', 'duplicate primary key',
  CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM g_subs
                                   GROUP BY customer_id, event_type)"""))
def v5_composite(spark, sf):
    """A key that the log does not have: the duplicates are counted."""
    return _big(q.key_rules(ad.ledger(spark, sf)["subscription_events"], "subscription_events",
                            ["customer_id", "event_type"]))


def _fk(table, source, column, ref, ref_source, ref_column):
    return (f"SELECT '{table}' AS table_name, '{column} missing from {ref}' AS rule, count(*) AS "
            f"violations FROM {source} c WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM "
            f"{ref_source} p WHERE p.{ref_column} = c.{column})")


@query("v9_foreign_keys", with_views(report(*[
    _fk(n, VIEWS[n], c, ref, VIEWS[ref], rc) for n, spec in TABLES.items() for c, ref, rc in spec.references])))
def v9(spark, sf):
    """Every declared reference."""
    return _big(q.foreign_keys(ad.journey(spark, sf)))


COPIED = q.COPIED


@query("v10_people", with_views(report(
    _rules("customers", "(SELECT c.*, p.created_at, " + ", ".join(
        f"p.{c} AS p_{c}" for c in COPIED) +
        " FROM j_customers c JOIN j_prospects p USING (prospect_id))",
        {**{f"{c} differs from prospect": f"{c} <> p_{c}" for c in COPIED},
         "converted before created": "customer_since < created_at"}),
    _rules("customers", "(SELECT count(*) AS n FROM j_customers GROUP BY prospect_id)",
           {"prospect converted twice": "n > 1"}),
    "SELECT 'customers', 'ids not in time order', count(*) FILTER (customer_since < prev) FROM "
    "(SELECT customer_since, lag(customer_since) OVER (ORDER BY customer_id) AS prev "
    "FROM j_customers)",
    _rules("prospects", "(SELECT p.*, channel, start_date, end_date FROM j_prospects p LEFT JOIN "
           "j_campaigns c USING (campaign_id))", {
               "campaign null exactly for organic":
               "(acquisition_channel = 'organic_search') <> (campaign_id IS NULL)",
               "campaign channel differs":
               "acquisition_channel <> 'organic_search' AND channel <> acquisition_channel",
               "campaign not live on creation day":
               "acquisition_channel <> 'organic_search' AND (CAST(created_at AS DATE) < "
               "CAST(start_date AS DATE) OR CAST(created_at AS DATE) > CAST(end_date AS DATE))"
           }))))
def v10(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.people(t["prospects"], t["customers"], t["campaigns"]))


def _timing(name, source, at):
    src = (f"(SELECT s.customer_id, s.{at} AS at_ts, c.customer_id AS expected, c.customer_since "
           f"FROM {source} s LEFT JOIN j_customers c USING (prospect_id))")
    return _rules(name, src, {
        "customer_id presence disagrees with conversion":
        "coalesce(at_ts >= customer_since, false) <> (customer_id IS NOT NULL)",
        "customer_id of another person": "customer_id <> expected"})


@query("v11_customer_id_timing", with_views(report(
    _timing("sessions", "j_sessions", "session_start"),
    _timing("marketing_touches", "j_touches", "touch_at"))))
def v11(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.union([
        q.customer_id_timing(t["sessions"], "session_start", "sessions", t["customers"]),
        q.customer_id_timing(t["marketing_touches"], "touch_at", "marketing_touches",
                             t["customers"])]))


@query("v12_funnel_rules", with_views(report(
    _rules("funnel_events", "(SELECT count(*) AS n, count(DISTINCT stage_number) AS d, "
           "min(stage_number) AS lo, max(stage_number) AS hi FROM j_funnel GROUP BY session_id)",
           {"stages skipped or repeated": "n <> hi OR d <> n OR lo <> 1"}),
    "SELECT 'funnel_events', 'event earlier than previous stage', count(*) FILTER "
    "(event_ts < prev) FROM (SELECT event_ts, lag(event_ts) OVER (PARTITION BY session_id "
    "ORDER BY stage_number, event_ts) AS prev FROM j_funnel)",
    _rules("funnel_events", "(SELECT session_start, n, f FROM j_sessions LEFT JOIN (SELECT "
           "session_id, count(*) AS n, min(event_ts) AS f FROM j_funnel WHERE stage_number = 1 "
           "GROUP BY 1) USING (session_id))",
           {"session without exactly one start": "coalesce(n, 0) <> 1",
            "start event time differs": "f <> session_start"}))))
def v12(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.funnel(t["sessions"], t["funnel_events"]))


def _arith(o, lines):
    joined = (f"(SELECT o.*, q, d, n FROM {o} o LEFT JOIN (SELECT order_id, sum(quantity) AS q, "
              f"sum(discount_amount) AS d, sum(net_amount) AS n FROM {lines} GROUP BY 1) "
              "USING (order_id))")
    return [
        _rules("orders", o, {
            "net != gross - discount":
            "abs(net_amount - (gross_amount - discount_amount)) > 0.011",
            "negative amount or discount above gross":
            "gross_amount < 0 OR discount_amount < 0 OR net_amount <= 0 OR "
            "discount_amount > gross_amount"}),
        _rules("order_lines", lines, {
            "net != quantity * price - discount":
            "abs(quantity * unit_price - discount_amount - net_amount) > 0.011",
            "non-positive quantity": "quantity <= 0"}),
        _rules("orders", joined, {
            "order without lines": "q IS NULL", "item_count != sum of lines": "q <> item_count",
            "discount != sum of lines": "abs(discount_amount - d) > 0.11",
            "net != sum of lines": "abs(net_amount - n) > 0.11"})]


@query("v13_order_arithmetic", with_views(report(*_arith("g_orders", "g_lines"))))
def v13(spark, sf):
    t = ad.ledger(spark, sf)
    return _big(q.order_arithmetic(t["orders"], t["order_lines"]))


@query("v14_first_orders", with_views(report(
    _rules("customers", "(SELECT customer_since, f FROM j_customers FULL JOIN (SELECT customer_id, "
           "min(order_ts) AS f FROM j_orders GROUP BY 1) USING (customer_id))",
           {"customer without order": "f IS NULL",
            "order of unknown customer": "customer_since IS NULL",
            "customer_since != first order": "f <> customer_since"}),
    _rules("orders", "j_orders", {"session null exactly for store":
                                  "(order_channel = 'store') = (session_id IS NOT NULL)"}))))
def v14(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.first_orders(t["orders"], t["customers"]))


@query("v15_purchase_links", with_views(report(
    _rules("orders", "(SELECT n, b FROM (SELECT session_id, count(*) AS n FROM j_orders WHERE "
           "order_channel <> 'store' GROUP BY 1) FULL JOIN (SELECT DISTINCT session_id, 1 AS b "
           "FROM j_funnel WHERE event_type = 'purchase') USING (session_id))",
           {"session linked to several orders": "n > 1",
            "purchase event without order": "n IS NULL",
            "order without purchase event": "b IS NULL"}),
    "SELECT 'orders', 'order time differs from purchase event', count(*) FROM j_orders o WHERE "
    "order_channel <> 'store' AND NOT EXISTS (SELECT 1 FROM j_funnel f WHERE f.session_id = "
    "o.session_id AND f.event_type = 'purchase' AND f.event_ts = o.order_ts) AND EXISTS (SELECT 1 "
    "FROM j_funnel f WHERE f.session_id = o.session_id AND f.event_type = 'purchase')",
    _rules("orders", "(SELECT order_channel, platform, s.prospect_id AS sp, c.prospect_id AS cp "
           "FROM j_orders o JOIN j_sessions s USING (session_id) JOIN j_customers c "
           "ON c.customer_id = o.customer_id WHERE order_channel <> 'store')",
           {"channel differs from session platform": "platform <> order_channel",
            "session of another person": "sp <> cp"}))))
def v15(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.purchase_links(t["orders"], t["funnel_events"], t["sessions"], t["customers"]))


def _discounts(orders: str, campaigns: str) -> list[str]:
    return [
        _rules("orders", f"(SELECT o.*, discount_pct, objective, start_date, end_date FROM {orders} o "
               f"JOIN {campaigns} USING (campaign_id))", {
                   "discount differs from campaign":
                   "abs(discount_amount - round(gross_amount * discount_pct, 2)) > "
                   "0.01 * item_count + 0.011",
                   "promotion outside its dates":
                   "objective = 'promotion' AND (CAST(order_ts AS DATE) < CAST(start_date AS DATE) OR "
                   "CAST(order_ts AS DATE) > CAST(end_date AS DATE))"}),
        _rules("orders", orders, {"discount without campaign":
                                  "campaign_id IS NULL AND discount_amount > 0"})]


@query("v16_discounts", with_views(report(*_discounts("g_orders", "g_campaigns"))))
def v16(spark, sf):
    t = ad.ledger(spark, sf)
    return _big(q.discounts(t["orders"], t["campaigns"]))


STATES_SQL = """
st AS (SELECT *, CASE WHEN last_type = 'subscribe' THEN last_plan END AS current_plan FROM (
  SELECT *, last_value(CASE WHEN event_type <> 'renew' THEN event_type END IGNORE NULLS) OVER w
              AS last_type,
            last_value(CASE WHEN event_type <> 'renew' THEN plan END IGNORE NULLS) OVER w
              AS last_plan
  FROM j_subs WINDOW w AS (PARTITION BY customer_id ORDER BY event_ts, subscription_event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
sv AS (SELECT *, CASE WHEN event_type = 'subscribe' THEN current_plan IS NULL
                      ELSE current_plan IS NOT DISTINCT FROM plan END AS valid FROM st)
"""


@query("v17_membership_machine", with_views("""
SELECT customer_id, count(*) AS events, count(*) FILTER (NOT valid) AS invalid_events
FROM sv GROUP BY 1""", STATES_SQL))
def v17(spark, sf):
    s = q.membership_states(ad.journey(spark, sf)["subscription_events"])
    return s.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(q.invalid_membership(s)).alias("invalid_events"))


@query("v17_membership_rules", with_views(report(
    "SELECT 'subscription_events' AS table_name, 'customers with invalid sequence' AS rule, "
    "count(DISTINCT customer_id) FILTER (NOT valid) AS violations FROM sv",
    "SELECT 'subscription_events', 'event before first order', count(*) FILTER "
    "(event_ts < customer_since) FROM j_subs JOIN j_customers USING (customer_id)"), STATES_SQL))
def v17r(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.subscriptions(t["subscription_events"], t["customers"]))


@query("v18_support_rules", with_views(report(
    _rules("support_contacts", "(SELECT s.*, customer_since FROM j_contacts s JOIN j_customers "
           "USING (customer_id))", {
               "contact before customer": "contact_ts < customer_since",
               "resolved before opened": "resolved_at < contact_ts",
               "csat on unresolved": "resolved_at IS NULL AND csat_score IS NOT NULL",
               "csat outside 1-5": "csat_score < 1 OR csat_score > 5"}),
    _rules("support_contacts", "(SELECT s.customer_id, o.customer_id AS oc, contact_ts, order_ts "
           "FROM j_contacts s JOIN j_customers USING (customer_id) JOIN j_orders o "
           "ON o.order_id = s.order_id)", {"order of another customer": "customer_id <> oc",
                                           "contact before order": "contact_ts < order_ts"}))))
def v18(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.support(t["support_contacts"], t["customers"], t["orders"]))


@query("v19_experiment_rules", with_views(report(
    _rules("experiment_assignments", "(SELECT a.*, start_date, end_date, customer_since, "
           "CASE WHEN CAST('0x' || substr(sha256(a.experiment_id || ':' || CAST(prospect_id AS "
           "VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < treatment_share THEN 'treatment' "
           "ELSE 'control' END AS want FROM j_assignments a JOIN j_experiments USING "
           "(experiment_id) LEFT JOIN j_customers USING (prospect_id))", {
               "variant differs from hash rule": "variant <> want",
               "assigned outside window": "CAST(assigned_at AS DATE) < CAST(start_date AS DATE) OR "
               "CAST(assigned_at AS DATE) > CAST(end_date AS DATE)",
               "assigned after converting": "assigned_at >= customer_since"}),
    "SELECT 'experiment_assignments', 'not assigned at first in-window session', count(*) FILTER "
    "(first_eligible_session IS DISTINCT FROM assigned_at) FROM j_assignments FULL JOIN j_eligible "
    "USING (prospect_id)")))
def v19(spark, sf):
    t = ad.journey(spark, sf)
    return _big(q.experiments(t["experiment_assignments"], t["experiments"], t["sessions"],
                              t["customers"]))


@query("v20_touch_rules", with_views(report(
    _rules("marketing_touches", "j_touches", {"clicked without open": "clicked AND NOT opened",
                                              "negative cost": "cost < 0"}))))
def v20(spark, sf):
    return _big(q.touches(ad.journey(spark, sf)["marketing_touches"]))


BUSINESS = [*[f"SELECT * FROM ({ORACLE[name]})" for name in (
    "v10_people", "v11_customer_id_timing", "v12_funnel_rules", "v14_first_orders", "v15_purchase_links",
    "v17_membership_rules", "v18_support_rules", "v19_experiment_rules", "v20_touch_rules")],
    *_arith("j_orders", "j_lines"), *_discounts("j_orders", "j_campaigns")]
FOUND = "SELECT * FROM ({}) WHERE violations > 0"


@query("v8_business_rules", with_views(FOUND.format(report(*BUSINESS))))
def v8(spark, sf):
    return _big(q.business_rules(ad.journey(spark, sf)).where("violations > 0"))


@query("v7_validation_gate", with_views("""
SELECT stage, table_name, rule, violations FROM (
  SELECT *, min(rank) OVER () AS first FROM (
    SELECT 1 AS rank, 'foreign_keys' AS stage, * FROM (""" + FOUND.format(report(*[
        _fk(n, VIEWS[n], c, ref, VIEWS[ref], rc) for n, spec in TABLES.items() for c, ref, rc in spec.references])) + """)
    UNION ALL SELECT 2, 'business', * FROM (""" + FOUND.format(report(*BUSINESS)) + """)))
WHERE rank = first"""))
def v7(spark, sf):
    """The gate over all thirteen tables, with the keys and references that are declared for them.

    Columns are those the tables have here, in their own types; the declared ones are checked by v2 and v3.
    """
    from tidemark.schema import KINDS, Column, Table
    t = ad.journey(spark, sf)
    kinds = {kind: name for name, kind in KINDS.items()} | {IntegerType(): "int"}
    specs = {n: Table(n, spec.key, tuple(Column(f.name, kinds[f.dataType], True) for f in t[n].schema), None, spec.references)
             for n, spec in TABLES.items()}
    t = {n: df.select(*[F.col(f.name).cast(KINDS[kinds[f.dataType]]).alias(f.name) for f in df.schema]) for n, df in t.items() if n in specs}
    stage, report_df = q.validate_all(spark, t, ad.JOURNEY_START, ad.JOURNEY_END, specs)
    return _big(report_df.withColumn("stage", F.lit(stage)))

"""Canonical customer-journey views over the supplied tables.

Two worlds with the same table shapes:

* the *journey* world comes from ``events`` (people, sessions, funnel stages, touches, purchases,
  memberships, contacts, experiment units in January 2024);
* the *ledger* world comes from ``customer``/``orders``/``lineitem``/``part``, with behaviour
  events moved into the twelve months before 2000-07-01 so that every customer has some.

Everything is a lazy projection or one aggregation; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cols import flag, pick, plus_days

# Fixed values of the mapping.
CHANNELS = ["organic_search", "paid_search", "paid_social", "email", "referral"]
AGE_BANDS = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]
INCOME_BANDS = ["low", "mid", "high"]
DEVICES = ["desktop", "mobile", "tablet"]
PLATFORMS = ["web", "app"]
SOURCES = ["direct", "organic_search", "paid_search", "paid_social", "email", "referral",
           "affiliate", "display"]
OBJECTIVES = ["acquisition", "nurture", "retargeting", "conversion", "retention", "winback",
              "promotion"]
STAGES = ["session_start", "product_view", "add_to_cart", "checkout_start", "purchase"]
STAGE_EVENTS = ["view", "click", "signup", "error", "purchase"]
EXPERIMENT = {"experiment_id": "EXP001", "start": "2024-01-02", "end": "2024-01-05",
              "treatment_share": 0.5}
LEDGER_SHIFT_DAYS = 8614
LEDGER_CUTOFF = "2000-07-01"
LEDGER_START, LEDGER_END = "1995-01-01", "2001-08-02"
JOURNEY_START, JOURNEY_END = "2024-01-01", "2024-01-31"


# Declared types of the supplied tables, so that a scan never has to infer them.
SUPPLIED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


class Views(Mapping):
    """Canonical tables built on first use."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SUPPLIED[name]).parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _person_columns(pid):
    return [pick(pid, CHANNELS).alias("acquisition_channel"),
            F.concat(F.lit("region_"), (pid % 5).cast("string")).alias("region"),
            pick(pid, AGE_BANDS).alias("age_band"), pick(pid, INCOME_BANDS).alias("income_band"),
            pick(pid, DEVICES).alias("device_type"), (pid % 4 != 0).alias("email_opt_in")]


def journey(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The thirteen canonical tables of the journey world."""
    ev = base_events(spark, sf_dir)
    uid = F.col("user_id")
    session_id = (uid * 1000 + F.dayofyear("ts")).alias("session_id")
    exp = EXPERIMENT

    def people() -> DataFrame:
        return ev.groupBy("user_id").agg(
            F.min("ts").alias("created_at"),
            F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))
            .alias("customer_since"))

    def since() -> DataFrame:
        return people().select("user_id", "customer_since")

    def prospects() -> DataFrame:
        return people().select(uid.alias("prospect_id"), "created_at",
                               F.when(uid % 5 != 0, uid % 25).alias("campaign_id"),
                               *_person_columns(uid))

    def customers() -> DataFrame:
        return people().where("customer_since is not null").select(
            uid.alias("customer_id"), uid.alias("prospect_id"), "customer_since",
            *_person_columns(uid))

    def sessions() -> DataFrame:
        per = ev.groupBy("user_id", session_id).agg(F.min("ts").alias("session_start"),
                                                    F.count(F.lit(1)).alias("pages_viewed"))
        linked = F.col("session_start") >= F.col("customer_since")
        return per.join(since(), "user_id").select(
            "session_id", uid.alias("prospect_id"), F.when(linked, uid).alias("customer_id"),
            "session_start", pick(F.col("session_id"), PLATFORMS).alias("platform"),
            pick(uid, DEVICES).alias("device_type"),
            pick(F.col("session_id"), SOURCES).alias("traffic_source"),
            F.when(uid % 5 != 0, uid % 25).alias("campaign_id"), "pages_viewed")

    def funnel() -> DataFrame:
        stage = F.array_position(F.array(*[F.lit(s) for s in STAGE_EVENTS]), F.col("event_type"))
        return ev.select("event_id", session_id, F.col("ts").alias("event_ts"),
                         F.element_at(F.array(*[F.lit(s) for s in STAGES]),
                                      stage.cast("int")).alias("event_type"),
                         stage.alias("stage_number"))

    def touches() -> DataFrame:
        t = ev.where(F.col("event_type").isin("view", "click", "signup")).join(since(), "user_id")
        kind = (F.when(F.col("event_type") == "view", "email")
                .when(F.col("event_type") == "click", "ad_click").otherwise("referral_credit"))
        return t.select(
            F.col("event_id").alias("touch_id"), uid.alias("prospect_id"),
            F.when(F.col("ts") >= F.col("customer_since"), uid).alias("customer_id"),
            (uid % 25).alias("campaign_id"), pick(uid, CHANNELS).alias("channel"),
            kind.alias("touch_type"), F.col("ts").alias("touch_at"),
            (F.col("k") % 2 == 0).alias("opened"), (F.col("k") % 3 == 0).alias("clicked"),
            (F.col("value") / 100).alias("cost"))

    def orders() -> DataFrame:
        store, promo = F.col("k") % 3 == 0, F.col("k") < 50
        discount = F.when(promo, F.col("value") * 0.1).otherwise(0.0)
        return ev.where("event_type = 'purchase'").select(
            F.col("event_id").alias("order_id"), uid.alias("customer_id"),
            F.col("ts").alias("order_ts"),
            F.when(store, "store").when(F.col("k") % 3 == 1, "app").otherwise("web")
            .alias("order_channel"), F.when(~store, session_id).alias("session_id"),
            F.when(promo, F.col("k") % 25).alias("campaign_id"),
            (F.col("k") % 3 + 1).alias("item_count"), F.col("value").alias("gross_amount"),
            discount.alias("discount_amount"), (F.col("value") - discount).alias("net_amount"))

    def lines() -> DataFrame:
        return orders().select(
            (F.col("order_id") * 10 + 1).alias("order_line_id"), "order_id",
            (F.col("order_id") % 100).alias("product_id"), F.col("item_count").alias("quantity"),
            (F.col("gross_amount") / F.col("item_count")).alias("unit_price"), "discount_amount",
            "net_amount")

    def subs() -> DataFrame:
        kind = (F.when(F.col("event_type") == "signup", "subscribe")
                .when(F.col("event_type") == "click", "renew").otherwise("cancel"))
        return ev.where(F.col("event_type").isin("signup", "click", "error")).select(
            F.col("event_id").alias("subscription_event_id"), uid.alias("customer_id"),
            F.col("ts").alias("event_ts"), kind.alias("event_type"),
            F.when(F.col("k") % 2 == 0, "monthly").otherwise("annual").alias("plan"),
            F.col("value").alias("amount"))

    def contacts() -> DataFrame:
        resolved = F.col("k") % 5 != 0
        later = F.col("ts") + F.make_dt_interval(hours=F.col("k").cast("int"))
        return ev.where("event_type = 'error'").select(
            F.col("event_id").alias("contact_id"), uid.alias("customer_id"),
            F.when(F.col("k") % 4 == 0, F.col("event_id") - 1).alias("order_id"),
            F.col("ts").alias("contact_ts"),
            pick(F.col("k"), ["chat", "email", "phone"]).alias("contact_channel"),
            pick(F.col("k"), ["delivery_delay", "return_request", "product_quality", "billing",
                              "account_access"]).alias("reason"),
            F.when(resolved, later).alias("resolved_at"),
            F.when(resolved, F.col("k") % 5 + 1).alias("csat_score"))

    def experiments() -> DataFrame:
        return table(spark, sf_dir, "region").where("r_regionkey = 0").select(
            F.lit(exp["experiment_id"]).alias("experiment_id"),
            F.lit(exp["start"]).cast("timestamp_ntz").alias("start_date"),
            F.lit(exp["end"]).cast("timestamp_ntz").alias("end_date"),
            F.lit(exp["treatment_share"]).alias("treatment_share"))

    def assignments() -> DataFrame:
        from tidemark.operators.experiment import eligible_population, variant
        arm = variant(F.lit(exp["experiment_id"]), F.col("prospect_id"),
                      F.lit(exp["treatment_share"]))
        return eligible_population(sessions(), exp["start"], "2024-01-06").select(
            F.lit(exp["experiment_id"]).alias("experiment_id"), "prospect_id",
            arm.alias("variant"), F.col("first_eligible_session").alias("assigned_at"))

    return Views({
        "products": lambda: products(spark, sf_dir),
        "campaigns": lambda: campaigns(spark, sf_dir, JOURNEY_START, 1),
        "experiments": experiments, "prospects": prospects, "customers": customers,
        "marketing_touches": touches, "sessions": sessions, "funnel_events": funnel,
        "orders": orders, "order_lines": lines, "subscription_events": subs,
        "support_contacts": contacts, "experiment_assignments": assignments})


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_retailprice").alias("list_price"),
        (F.col("p_retailprice") * 0.6).alias("unit_cost"))


def campaigns(spark: SparkSession, sf_dir: str, first: str, spacing_days: int) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    start = F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(
        days=(key * spacing_days).cast("int"))
    return table(spark, sf_dir, "nation").select(
        key.alias("campaign_id"), F.concat(F.col("n_name"), F.lit(" 1999")).alias("campaign_name"),
        pick(key, CHANNELS).alias("channel"), pick(key, OBJECTIVES).alias("objective"),
        start.alias("start_date"), plus_days(start, 6).alias("end_date"),
        (F.col("n_regionkey") * 0.05).alias("discount_pct"))


def ledger(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """Customers, orders, lines, products and the behaviour tables of the ledger world."""
    pid = F.col("customer_id")

    def customers() -> DataFrame:
        geo = table(spark, sf_dir, "nation").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
        first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("o_orderdate").alias("customer_since"))
        c = table(spark, sf_dir, "customer").join(first, "c_custkey").join(geo, "c_nationkey")
        c = c.select(F.col("c_custkey").alias("customer_id"),
                     F.col("c_custkey").alias("prospect_id"), "customer_since",
                     F.col("c_mktsegment").alias("acquisition_channel"), "region",
                     (F.col("c_acctbal") > 0).alias("email_opt_in"))
        return c.select("customer_id", "prospect_id", "customer_since", "acquisition_channel",
                        "region", pick(pid, AGE_BANDS).alias("age_band"),
                        pick(pid, INCOME_BANDS).alias("income_band"),
                        pick(pid, DEVICES).alias("device_type"), "email_opt_in")

    def prospects() -> DataFrame:
        before = F.make_dt_interval(days=(pid % 120).cast("int"))
        return customers().select(
            "prospect_id", (F.col("customer_since") - before).alias("created_at"),
            "acquisition_channel", "region", "age_band", "income_band", "device_type",
            "email_opt_in")

    def orders() -> DataFrame:
        urgent = F.col("o_orderpriority") == "1-URGENT"
        store = F.col("o_orderpriority") == "3-MEDIUM"
        gross = F.col("o_totalprice")
        discount = F.when(urgent, gross * 0.1).otherwise(0.0)
        channel = (F.when(store, "store")
                   .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "app")
                   .otherwise("web"))
        return table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_ts"), channel.alias("order_channel"),
            F.when(~store, F.col("o_orderkey")).alias("session_id"),
            F.when(urgent, F.col("o_orderkey") % 25).alias("campaign_id"),
            (F.floor(gross / 100000) + 1).cast("bigint").alias("item_count"),
            gross.alias("gross_amount"), discount.alias("discount_amount"),
            (gross - discount).alias("net_amount"))

    def lines() -> DataFrame:
        price, disc = F.col("l_extendedprice"), F.col("l_discount")
        return table(spark, sf_dir, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_line_id"),
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            (price / F.col("l_quantity")).alias("unit_price"),
            (price * disc).alias("discount_amount"), (price * (1 - disc)).alias("net_amount"))

    def behaviour() -> DataFrame:
        back = LEDGER_SHIFT_DAYS + (F.col("event_id") % 120 / 10).cast("int") * 30
        return base_events(spark, sf_dir).select(
            "event_id", "event_type", "value", "k",
            (F.col("user_id") * 10 + F.col("event_id") % 10).alias("customer_id"),
            (F.col("ts") - F.make_dt_interval(days=back)).alias("at"))

    def sessions() -> DataFrame:
        return behaviour().where(F.col("event_type").isin("view", "click")).select(
            F.col("event_id").alias("session_id"), F.col("customer_id").alias("prospect_id"),
            "customer_id", F.col("at").alias("session_start"),
            pick(F.col("k"), PLATFORMS).alias("platform"), pick(pid, DEVICES).alias("device_type"),
            pick(F.col("k"), SOURCES).alias("traffic_source"), F.col("k").alias("pages_viewed"))

    def touches() -> DataFrame:
        return behaviour().where(F.col("event_type").isin("signup", "click")).select(
            F.col("event_id").alias("touch_id"), F.col("customer_id").alias("prospect_id"),
            "customer_id", (F.col("event_id") % 25).alias("campaign_id"),
            pick(F.col("k"), CHANNELS).alias("channel"),
            F.when(F.col("event_type") == "signup", "email").otherwise("ad_click")
            .alias("touch_type"), F.col("at").alias("touch_at"),
            (F.col("k") % 2 == 0).alias("opened"), (F.col("k") % 4 == 0).alias("clicked"),
            (F.col("value") / 100).alias("cost"))

    def subs() -> DataFrame:
        kind = (F.when(F.col("k") % 3 == 0, "subscribe").when(F.col("k") % 3 == 1, "renew")
                .otherwise("cancel"))
        return behaviour().where("event_type = 'purchase'").select(
            F.col("event_id").alias("subscription_event_id"), "customer_id",
            F.col("at").alias("event_ts"), kind.alias("event_type"),
            F.when(F.col("k") % 2 == 0, "monthly").otherwise("annual").alias("plan"),
            F.col("value").alias("amount"))

    def contacts() -> DataFrame:
        resolved = F.col("k") % 5 != 0
        later = F.col("at") + F.make_dt_interval(hours=F.col("k").cast("int"))
        return behaviour().where("event_type = 'error'").select(
            F.col("event_id").alias("contact_id"), "customer_id",
            F.lit(None).cast("bigint").alias("order_id"), F.col("at").alias("contact_ts"),
            pick(F.col("k"), ["chat", "email", "phone"]).alias("contact_channel"),
            F.when(resolved, later).alias("resolved_at"),
            F.when(resolved, F.col("k") % 5 + 1).alias("csat_score"))

    return Views({
        "customers": customers, "prospects": prospects, "orders": orders, "order_lines": lines,
        "products": lambda: products(spark, sf_dir),
        "campaigns": lambda: campaigns(spark, sf_dir, LEDGER_START, 90), "sessions": sessions,
        "marketing_touches": touches, "subscription_events": subs, "support_contacts": contacts})


def score_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored binary task with many ties: one row per order, one run per quarter."""
    o = table(spark, sf_dir, "orders")
    q = F.make_date(F.year("o_orderdate"), (F.quarter("o_orderdate") * 3 - 2).cast("int"),
                    F.lit(1))
    return o.select(
        F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("cluster_id"),
        q.alias("run_cutoff"), flag(F.col("o_orderstatus") == "F").alias("label"),
        ((F.floor(F.col("o_totalprice") / 5000) * 5 + 10) / 1000).alias("score_a"),
        ((F.col("o_custkey") * 7919 % 97 + 1) / 100).alias("score_b"),
        F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") / 1000).alias("value"))

"""Declared tables: columns, kinds, keys and closed value domains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "timestamp": T.TimestampNTZType(), "int": T.LongType(),
         "float": T.DoubleType(), "bool": T.BooleanType()}

# The closed domains of the canonical tables.
CHANNELS = ("paid_search", "paid_social", "affiliate", "referral", "email", "organic_search",
            "direct")
DEVICES = ("desktop", "mobile", "tablet")
PLATFORMS = ("web", "app")
ORDER_CHANNELS = ("web", "app", "store")
TOUCH_TYPES = ("ad_click", "email", "referral_credit")
STAGES = ("session_start", "product_view", "add_to_cart", "checkout_start", "purchase")
MEMBER_EVENTS = ("subscribe", "renew", "cancel")
PLANS = ("monthly", "annual")
CONTACT_CHANNELS = ("chat", "email", "phone")
CONTACT_REASONS = ("delivery_delay", "return_request", "product_quality", "billing",
                   "account_access")
VARIANTS = ("control", "treatment")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = False
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    columns: tuple[Column, ...]
    time_column: str | None = None
    references: tuple[tuple[str, str, str], ...] = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, KINDS[c.kind], c.nullable,
                                           {"allowed": list(c.allowed)} if c.allowed else {})
                             for c in self.columns])


def columns(text: str, allowed: dict[str, tuple[str, ...]] | None = None) -> tuple[Column, ...]:
    """Parse ``name kind`` / ``name kind?`` pairs into columns."""
    out = []
    for part in text.split(","):
        name, kind = part.split()
        out.append(Column(name, kind.rstrip("?"), kind.endswith("?"), (allowed or {}).get(name)))
    return tuple(out)


PERSON = ("acquisition_channel string, region string, age_band string, income_band string, "
          "device_type string, email_opt_in bool")

TABLES: dict[str, Table] = {t.name: t for t in (
    Table("products", ("product_id",), columns(
        "product_id string, product_name string, category string, list_price float, "
        "unit_cost float")),
    Table("campaigns", ("campaign_id",), columns(
        "campaign_id string, campaign_name string, channel string, objective string, "
        "start_date timestamp, end_date timestamp, discount_pct float"), "start_date"),
    Table("experiments", ("experiment_id",), columns(
        "experiment_id string, experiment_name string, hypothesis string, "
        "randomization_unit string, eligible_population string, start_date timestamp, "
        "end_date timestamp, treatment_share float, primary_metric string, "
        "guardrail_metrics string"), "start_date"),
    Table("prospects", ("prospect_id",), columns(
        "prospect_id string, created_at timestamp, acquisition_channel string, "
        "campaign_id string?, region string, age_band string, income_band string, "
        "device_type string, email_opt_in bool", {"device_type": DEVICES}), "created_at",
        (("campaign_id", "campaigns", "campaign_id"),)),
    Table("customers", ("customer_id",), columns(
        f"customer_id string, prospect_id string, customer_since timestamp, {PERSON}",
        {"device_type": DEVICES}), "customer_since",
        (("prospect_id", "prospects", "prospect_id"),)),
    Table("marketing_touches", ("touch_id",), columns(
        "touch_id string, prospect_id string, customer_id string?, campaign_id string, "
        "channel string, touch_type string, touch_at timestamp, opened bool, clicked bool, "
        "cost float", {"touch_type": TOUCH_TYPES}), "touch_at",
        (("prospect_id", "prospects", "prospect_id"), ("customer_id", "customers", "customer_id"),
         ("campaign_id", "campaigns", "campaign_id"))),
    Table("sessions", ("session_id",), columns(
        "session_id string, prospect_id string, customer_id string?, session_start timestamp, "
        "platform string, device_type string, traffic_source string, campaign_id string?, "
        "pages_viewed int", {"platform": PLATFORMS, "device_type": DEVICES}), "session_start",
        (("prospect_id", "prospects", "prospect_id"), ("customer_id", "customers", "customer_id"),
         ("campaign_id", "campaigns", "campaign_id"))),
    Table("funnel_events", ("event_id",), columns(
        "event_id string, session_id string, event_ts timestamp, event_type string, "
        "stage_number int", {"event_type": STAGES}), "event_ts",
        (("session_id", "sessions", "session_id"),)),
    Table("orders", ("order_id",), columns(
        "order_id string, customer_id string, order_ts timestamp, order_channel string, "
        "session_id string?, campaign_id string?, item_count int, gross_amount float, "
        "discount_amount float, net_amount float", {"order_channel": ORDER_CHANNELS}), "order_ts",
        (("customer_id", "customers", "customer_id"), ("session_id", "sessions", "session_id"),
         ("campaign_id", "campaigns", "campaign_id"))),
    Table("order_lines", ("order_line_id",), columns(
        "order_line_id string, order_id string, product_id string, quantity int, "
        "unit_price float, discount_amount float, net_amount float"), None,
        (("order_id", "orders", "order_id"), ("product_id", "products", "product_id"))),
    Table("subscription_events", ("subscription_event_id",), columns(
        "subscription_event_id string, customer_id string, event_ts timestamp, "
        "event_type string, plan string, amount float",
        {"event_type": MEMBER_EVENTS, "plan": PLANS}), "event_ts",
        (("customer_id", "customers", "customer_id"),)),
    Table("support_contacts", ("contact_id",), columns(
        "contact_id string, customer_id string, order_id string?, contact_ts timestamp, "
        "contact_channel string, reason string, resolved_at timestamp?, csat_score int?",
        {"contact_channel": CONTACT_CHANNELS, "reason": CONTACT_REASONS}), "contact_ts",
        (("customer_id", "customers", "customer_id"), ("order_id", "orders", "order_id"))),
    Table("experiment_assignments", ("experiment_id", "prospect_id"), columns(
        "experiment_id string, prospect_id string, variant string, assigned_at timestamp",
        {"variant": VARIANTS}), "assigned_at",
        (("experiment_id", "experiments", "experiment_id"),
         ("prospect_id", "prospects", "prospect_id"))),
)}


def coerce(df: DataFrame, spec: Table) -> DataFrame:
    """Declared column order and types."""
    return df.select(*[F.col(c.name).cast(KINDS[c.kind]).alias(c.name) for c in spec.columns])

"""Hand-built people with worked answers; moments sit exactly on the window edges."""

import pytest
from conftest import at, by, rows
from pyspark.sql import functions as F

from tidemark.operators import churn, leads, timewin, value

CUT = "2025-07-01"
PERSON = ("acquisition_channel string, region string, age_band string, income_band string, "
          "device_type string, email_opt_in boolean")
WHO = ("email", "west", "25-34", "mid", "mobile", True)


@pytest.fixture
def lead_tables(frame):
    made = {"L1": -44, "L2": -12, "L3": -91, "L4": 0, "L5": -90, "L6": -1, "L7": -30, "L8": 6}
    won = {"L1": 13, "L2": -4, "L5": 29.5, "L6": 30, "L7": 0}
    minute = 1 / 1440
    sessions = [("A1", "L1", None, at(-40), "web", "desktop", 2),
                ("A2", "L1", None, at(-6.9), "app", "mobile", 5),
                ("A3", "L1", None, at(-6.5), "app", "mobile", 1),
                ("A4", "L1", None, at(-minute), "web", "mobile", 4),
                ("A5", "L1", None, at(0), "web", "mobile", 7),
                ("B1", "L7", None, at(-20), "web", "mobile", 2)]
    stages = [("A1", -40, [1, 2, 3, 4]), ("A2", -6.9, [1]), ("A3", -6.5, [1, 2, 3]),
              ("A4", -minute, [1]), ("A4", minute, [2, 3, 4, 5]), ("A5", 0, [1, 2]),
              ("B1", -20, [1, 2])]
    events = [(f"E{i}{k}", s, at(d + n * minute), k)
              for i, (s, d, ks) in enumerate(stages) for n, k in enumerate(ks)]
    touches = [("L1", None, "email", at(-30), True, True),
               ("L1", None, "email", at(-12), True, False),
               ("L1", None, "email", at(-5), False, False),
               ("L1", None, "email", at(0), True, True),
               ("L1", None, "ad_click", at(-8), True, True),
               ("L1", None, "ad_click", at(-0.5), True, True)]
    return {
        "prospects": frame(f"prospect_id string, created_at timestamp_ntz, {PERSON}",
                           [(p, at(d), *WHO) for p, d in made.items()]),
        "customers": frame("customer_id string, prospect_id string, customer_since timestamp_ntz",
                           [("C" + p[1:], p, at(d)) for p, d in won.items()]),
        "sessions": frame("session_id string, prospect_id string, customer_id string, "
                          "session_start timestamp_ntz, platform string, device_type string, "
                          "pages_viewed bigint", sessions),
        "funnel_events": frame("event_id string, session_id string, event_ts timestamp_ntz, "
                               "stage_number bigint", events),
        "marketing_touches": frame("prospect_id string, customer_id string, touch_type string, "
                                   "touch_at timestamp_ntz, opened boolean, clicked boolean",
                                   touches)}


def test_pipeline_and_labels_are_half_open(lead_tables):
    t = lead_tables
    pop = leads.open_leads(t["prospects"], t["customers"], [CUT])
    assert rows(pop, "prospect_id") == [("L1",), ("L5",), ("L6",), ("L7",)]
    got = rows(leads.conversion_labels(pop, t["customers"], 30), "prospect_id", "converted")
    assert got == [("L1", 1), ("L5", 1), ("L6", 0), ("L7", 1)]
    longer = by(leads.conversion_labels(pop, t["customers"], 31), "prospect_id")
    assert longer["L6"]["converted"] == 1


def test_lead_features_see_only_the_past(lead_tables):
    f = by(leads.build_features(lead_tables, [CUT]), "prospect_id")
    want = {"lead_age_days": 44, "sessions_total": 4, "sessions_7d": 3,
            "days_since_last_session": 1 / 1440, "max_stage_reached": 4, "cart_sessions": 2,
            "checkout_sessions": 1, "pages_viewed": 12, "app_session_share": 1 / 2,
            "mobile_session_share": 3 / 4, "emails_received": 3, "emails_opened": 2,
            "emails_clicked": 1, "email_open_rate": 2 / 3, "retarget_clicks": 2}
    assert {k: f["L1"][k] for k in want} == pytest.approx(want)
    assert f["L5"]["sessions_total"] == 0 and f["L5"]["days_since_last_session"] == 90


def test_lead_features_do_not_change_when_the_future_is_removed(lead_tables):
    past = timewin.snapshot(lead_tables, CUT)
    a, b = leads.build_features(lead_tables, [CUT]), leads.build_features(past, [CUT])
    assert leads.frame_difference(a, b).first()[0] == 0


@pytest.fixture
def customer_tables(frame):
    since = {"K1": -150, "K2": -181, "K3": -2, "K4": -60, "K5": 0.5, "K6": -400}
    ledger = [("N01", "K1", -150, "app", "V1", 80.0, 20.0), ("N02", "K1", -95, "web", None, 30., 0.),
              ("N03", "K1", -40, "store", None, 60.0, 6.0),
              ("N04", "K1", 89.5, "web", None, 10.0, 0.0), ("N05", "K2", -181, "web", None, 25., 0.),
              ("N06", "K3", -2, "app", None, 70.0, 0.0), ("N07", "K3", 90, "app", None, 70.0, 0.0),
              ("N08", "K4", -60, "web", None, 15.0, 0.0), ("N09", "K4", 0, "web", None, 15.0, 0.0),
              ("N10", "K6", -400, "web", None, 50.0, 0.0),
              ("N11", "K6", -180, "web", None, 50.0, 5.0), ("N12", "K5", 0.5, "web", None, 9.0, 0.0)]
    product = {"N03": "B", "N08": "B"}
    hour = 1 / 24
    return {
        "customers": frame(f"customer_id string, prospect_id string, "
                           f"customer_since timestamp_ntz, {PERSON}",
                           [(c, "P" + c[1:], at(d), *WHO) for c, d in since.items()]),
        "orders": frame("order_id string, customer_id string, order_ts timestamp_ntz, "
                        "order_channel string, session_id string, gross_amount double, "
                        "discount_amount double, net_amount double, item_count bigint",
                        [(o, c, at(d), ch, s, g, x, g - x, 1) for o, c, d, ch, s, g, x in ledger]),
        "products": frame("product_id string, category string, unit_cost double",
                          [("A", "toys", 12.0), ("B", "garden", 25.0)]),
        "order_lines": frame("order_id string, product_id string, quantity bigint, "
                             "net_amount double",
                             [(o[0], product.get(o[0], "A"), 1, o[5] - o[6]) for o in ledger]),
        "sessions": frame("session_id string, customer_id string, session_start timestamp_ntz",
                          [("V1", "K1", at(-150)), ("V2", "K1", at(-88)), ("V3", "K1", at(-31)),
                           ("V4", "K1", at(-29)), ("V5", "K1", at(-2 * hour)), ("V6", "K1", at(5)),
                           ("V7", None, at(-3))]),
        "marketing_touches": frame(
            "customer_id string, touch_type string, touch_at timestamp_ntz, opened boolean, "
            "clicked boolean",
            [("K1", "email", at(-3), True, True), ("K1", "email", at(-45), True, True),
             ("K1", "email", at(-60), False, False), ("K1", "email", at(-89), False, False),
             ("K1", "email", at(-91), True, True), ("K1", "email", at(2), True, True),
             ("K1", "ad_click", at(-3), True, True)]),
        "subscription_events": frame(
            "subscription_event_id string, customer_id string, event_ts timestamp_ntz, "
            "event_type string, plan string",
            [("1", "K1", at(-120), "subscribe", "monthly"), ("2", "K1", at(-70), "cancel", "monthly"),
             ("3", "K1", at(-30), "subscribe", "annual"), ("4", "K4", at(-50), "subscribe", "annual"),
             ("5", "K4", at(-10), "cancel", "annual"), ("6", "K6", at(-45), "subscribe", "monthly"),
             ("7", "K3", at(1), "subscribe", "annual")]),
        "support_contacts": frame(
            "customer_id string, contact_ts timestamp_ntz, resolved_at timestamp_ntz, "
            "csat_score bigint",
            [("K1", at(-170), at(-170 + 2 * hour), 5), ("K1", at(-20), at(-15), 1),
             ("K1", at(-1), at(-1 + 2 * hour), 4), ("K1", at(-181), at(-180), 1),
             ("K3", at(-3 * hour), at(1), 1)])}


def test_churn_base_and_labels(customer_tables):
    o = customer_tables["orders"]
    base = churn.active_customers(o, [CUT])
    assert rows(base, "customer_id") == [("K1",), ("K3",), ("K4",), ("K6",)]
    assert "K6" not in by(churn.active_customers(o, ["2025-07-02"]), "customer_id")
    lab = rows(churn.churn_labels(base, o, [CUT], 90), "customer_id", "churned")
    assert lab == [("K1", 0), ("K3", 1), ("K4", 0), ("K6", 1)]
    assert by(churn.churn_labels(base, o, [CUT], 91), "customer_id")["K3"]["churned"] == 0


def test_churn_features(customer_tables):
    f = by(churn.build_features(customer_tables, [CUT]), "customer_id")
    want = {"tenure_days": 150, "days_since_last_order": 40, "orders_total": 3, "orders_90d": 1,
            "orders_prev_90d": 2, "net_revenue_180d": 144, "avg_order_value": 48,
            "discount_share": 26 / 170, "first_order_discounted": 1, "category_count": 2,
            "store_order_share": 1 / 3, "browse_sessions_30d": 2, "browse_sessions_90d": 4,
            "days_since_last_session": 1 / 12, "emails_received_90d": 4,
            "email_open_rate_90d": 1 / 2, "email_clicks_90d": 2, "plus_member": 1,
            "plus_cancelled_180d": 1, "support_contacts_180d": 3, "low_csat_contacts_180d": 1,
            "slow_resolution_contacts_180d": 1, "open_contacts": 0, "margin_180d": 95}
    assert {k: f["K1"][k] for k in want} == pytest.approx(want)
    assert f["K3"]["open_contacts"] == 1 and f["K3"]["low_csat_contacts_180d"] == 0
    assert f["K3"]["plus_member"] == 0 and f["K4"]["plus_member"] == 1
    assert f["K6"]["plus_member"] == 0 and f["K6"]["days_since_last_session"] == 400
    past = timewin.snapshot(customer_tables, CUT)
    assert leads.frame_difference(churn.build_features(customer_tables, [CUT]),
                                  churn.build_features(past, [CUT])).first()[0] == 0


def test_several_runs_in_one_job_equal_single_runs(customer_tables):
    runs = ["2025-05-01", CUT]
    both = churn.build_features(customer_tables, runs)
    one = churn.build_features(customer_tables, runs[:1]).unionByName(
        churn.build_features(customer_tables, runs[1:]))
    assert leads.frame_difference(both, one).first()[0] == 0


def test_future_revenue_and_value_windows(customer_tables):
    t = customer_tables
    d = by(value.build_dataset(t, [CUT], clv=False), "customer_id")
    assert sorted(d) == ["K1", "K2", "K3", "K4", "K6"]
    assert d["K1"]["future_revenue"] == 10 and d["K2"]["future_revenue"] == 0
    assert d["K1"]["revenue_total"] == 144 and d["K1"]["revenue_90d"] == 54
    assert d["K1"]["mean_days_between_orders"] == 55 and d["K2"]["mean_days_between_orders"] == 181
    assert d["K2"]["revenue_365d"] == 25 and d["K2"]["revenue_180d"] == 0


def test_snapshot_masks_later_resolutions(customer_tables):
    snap = timewin.snapshot(customer_tables, CUT)
    k3 = snap["support_contacts"].where("customer_id = 'K3'").first()
    assert k3["resolved_at"] is None and k3["csat_score"] is None
    assert snap["order_lines"].count() == snap["orders"].count() == 8


def test_audits_count_planted_errors(customer_tables):
    t = customer_tables
    good = churn.build_dataset(t, [CUT], 90)

    def audit(data):
        got = churn.leakage_audit(t, data, [CUT], CUT, 90, [CUT], ["2025-12-01"])
        return {r["check_name"]: r["violations"] for r in got.collect()}

    clean = audit(good)
    assert clean["features_only_from_pre_cutoff_rows"] == clean["labels_only_from_prediction_window"] == 0
    one = F.col("customer_id") == "K1"
    late = audit(good.withColumn("days_since_last_session", F.when(one, -5.0).otherwise(
        F.col("days_since_last_session"))))
    assert late["features_only_from_pre_cutoff_rows"] == 1
    assert late["features_unchanged_when_future_rows_removed"] == 2
    flipped = audit(good.withColumn("churned", F.when(one, 1 - F.col("churned")).otherwise(F.col("churned"))))
    assert flipped["labels_only_from_prediction_window"] == 1
    idle = audit(good.unionByName(good.where(one).withColumn("customer_id", F.lit("K2"))))
    assert idle["every_scored_customer_active_at_cutoff"] == 1


def test_windows_and_splits_refuse_overlap():
    with pytest.raises(ValueError):
        timewin.PredictionWindow("2025-12-01", 90, "2024-01-01", "2026-01-01")
    with pytest.raises(ValueError):
        timewin.SplitPlan(("2024-04-01",), ("2024-06-01",), ("2025-01-01",), 90, "2026-01-01")
    assert timewin.rolling_cutoffs("2024-01-01", "2024-01-29", 14) == [
        "2024-01-01", "2024-01-15", "2024-01-29"]
    assert timewin.monthly_runs("2024-11-15", "2025-02-01") == [
        "2024-12-01", "2025-01-01", "2025-02-01"]


def test_cutoff_filter_reaches_the_scan(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = timewin.events_before(o, "o_orderdate", "2000-07-01").select("o_custkey")
    text = plan._jdf.queryExecution().toString()
    assert "LessThan(o_orderdate" in text
    assert F is not None

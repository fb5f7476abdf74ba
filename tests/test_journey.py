"""Funnel, quality, lifecycle, cohort, experiment and series rules on hand-made rows."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators import actions, cohorts, experiment, forecast, funnel, quality, segments
from tidemark.operators import lifecycle as lc


def day(text):
    return datetime.fromisoformat(text)


# ------------------------------------------------------------------ funnel and quality
@pytest.fixture
def events(frame):
    logs = {"payer": [1, 2, 3, 4], "jumper": [1, 3, 4, 5], "end_only": [5], "reader": [1, 2],
            "gap": [1, 2, 3, 5], "all": [1, 2, 3, 4, 5]}
    t0 = day("2025-01-01")
    return frame("event_id string, session_id string, event_ts timestamp_ntz, event_type string, "
                 "stage_number bigint",
                 [(f"{s}{k}", s, t0 + timedelta(minutes=k), "x", k)
                  for s, ks in logs.items() for k in ks])


def test_depth_is_the_contiguous_prefix(events):
    got = dict(rows(funnel.session_depth(events), "session_id", "depth"))
    assert got == {"payer": 4, "jumper": 1, "end_only": 0, "reader": 2, "gap": 3, "all": 5}


def test_stage_table_counts_and_shares(frame):
    f = frame("depth int", [(d,) for d in [4, 1, 5, 2, 4, 1, 3, 1, 2, 5, 4, 3]])
    t = by(funnel.stage_table(f), "stage_number")
    assert [t[k]["reached"] for k in range(1, 6)] == [12, 9, 7, 5, 2]
    assert t[2]["step_conversion"] == 0.75 and t[5]["share_of_all_losses"] == pytest.approx(0.3)
    assert funnel.non_monotone(funnel.stage_table(f)).isEmpty()


def test_out_of_order_and_duplicate_events_match_a_replay(frame):
    rng = np.random.default_rng(5)
    t0 = day("2025-01-01")
    log = [(f"e{i}", f"s{rng.integers(12)}", t0 + timedelta(minutes=int(rng.integers(60))), "x",
            int(rng.integers(1, 6))) for i in range(300)]
    df = frame("event_id string, session_id string, event_ts timestamp_ntz, event_type string, "
               "stage_number bigint", log)
    sessions = df.select("session_id").distinct()
    got = {r["defect"]: r["rows"] for r in funnel.funnel_integrity(sessions, df).collect()}
    per = {}
    for _, s, t, _, k in log:
        per.setdefault(s, []).append((k, t))
    back = sum(sum(b[1] < a[1] for a, b in zip(v, v[1:])) for v in map(sorted, per.values()))
    dupes = sum(len(v) - len({k for k, _ in v}) for v in per.values())
    assert got["out_of_order_events"] == back and got["duplicate_stage_events"] == dupes


def test_membership_states_equal_a_sequential_replay(frame):
    rng = np.random.default_rng(3)
    t0 = day("2025-01-01")
    log = []
    for i in range(600):
        who = "hot" if i % 3 == 0 else f"c{rng.integers(8)}"
        log.append((f"{i:04d}", who, t0 + timedelta(hours=int(rng.integers(240))),
                    str(rng.choice(["subscribe", "renew", "cancel"])),
                    str(rng.choice(["monthly", "annual"]))))
    df = frame("subscription_event_id string, customer_id string, event_ts timestamp_ntz, "
               "event_type string, plan string", log)
    states = quality.membership_states(df)
    got = {r["subscription_event_id"]: r["bad"] for r in states.select(
        "subscription_event_id", quality.invalid_membership(states).alias("bad")).collect()}
    plan = {}
    for eid, who, _, kind, p in sorted(log, key=lambda e: (e[1], e[2], e[0])):
        now = plan.get(who)
        bad = now is not None if kind == "subscribe" else now != p
        assert got[eid] == bad
        plan[who] = p if kind == "subscribe" else None if kind == "cancel" else now


def test_each_corruption_is_counted(frame):
    orders = frame("order_id string, gross_amount double, discount_amount double, "
                   "net_amount double, item_count bigint",
                   [("a", 10.0, 1.0, 9.0, 1), ("b", 10.0, 1.0, 8.0, 1), ("c", 5.0, 0.0, 5.0, 2)])
    lines = frame("order_id string, quantity bigint, unit_price double, discount_amount double, "
                  "net_amount double", [("a", 1, 10.0, 1.0, 9.0), ("b", 0, 10.0, 1.0, -1.0)])
    got = {r["rule"]: r["violations"] for r in quality.order_arithmetic(orders, lines).collect()}
    assert got["net != gross - discount"] == 1 and got["order without lines"] == 1
    assert got["non-positive quantity"] == 1 and got["item_count != sum of lines"] == 1
    keys = {r["rule"]: r["violations"] for r in quality.key_rules(
        frame("k string", [("x",), ("x",), (None,)]), "t", ["k"]).collect()}
    assert keys == {"null primary key": 1, "duplicate primary key": 1}
    orphan = quality.foreign_key_orphans(frame("k string", [("x",), ("y",), ("y",), (None,)]), "t",
                                         "k", frame("k string", [("x",)]), "p", "k").first()
    assert orphan["violations"] == 2
    ids = quality.id_order(frame("id bigint, at timestamp_ntz", [
        (i, day("2025-01-01") + timedelta(days=i if i != 5 else 1)) for i in range(9)]), "id",
        "at", "t").first()
    assert ids["violations"] == 1


# ------------------------------------------------------------------ lifecycle
PERIODS = [date(2023, m, 1) for m in range(1, 13)]


@pytest.fixture
def people(frame):
    buys = [("D1", "2023-03-04", 35.0), ("D1", "2023-06-20", 45.0), ("D4", "2023-04-10", 80.0),
            ("D4", "2023-12-05", 25.0)] + [("D3", f"{p:%Y-%m}-15", 12.0) for p in PERIODS[:8]]
    return (frame("prospect_id string, created_at timestamp_ntz, acquisition_channel string",
                  [("R1", day("2023-02-11"), "social"), ("R2", day("2023-07-31"), "organic"),
                   ("R3", day("2023-01-02"), "referral"), ("R4", day("2023-01-20"), "paid")]),
            frame("customer_id string, prospect_id string, customer_since timestamp_ntz, "
                  "acquisition_channel string",
                  [("D1", "R1", day("2023-03-04"), "social"),
                   ("D3", "R3", day("2023-01-15"), "referral"),
                   ("D4", "R4", day("2023-04-10"), "paid")]),
            frame("customer_id string, order_ts timestamp_ntz, net_amount double",
                  [(c, day(d), v) for c, d, v in buys]))


# R1 orders 4 March and 20 June: 89 days on 1 June, idle 103 on 1 October and 195 at the year's end.
# R3 stops after 15 August: 198 days and 7 orders on 1 August, idle 108 on 1 December.
EXPECTED = {"R1": [None, "prospect"] + ["new"] * 3 + ["active"] * 3 + ["at_risk"] * 3 + ["churned"],
            "R2": [None] * 6 + ["prospect"] * 6,
            "R3": ["new"] * 3 + ["active"] * 3 + ["loyal"] * 4 + ["at_risk"] * 2,
            "R4": ["prospect"] * 3 + ["new"] * 3 + ["at_risk"] * 3 + ["churned"] * 2 + ["active"]}


def _panel(people, rules=lc.Rules()):
    return lc.build_panel(*people, "2023-01-01", "2023-12-01", rules)


def test_panel_states_match_the_hand_table(people):
    got = {(r["prospect_id"], r["period"]): r["state"] for r in _panel(people).collect()}
    for p, states in EXPECTED.items():
        assert [got.get((p, m)) for m in PERIODS] == states


def test_panel_agrees_with_single_dates(people):
    panel = _panel(people)
    persons = lc.people_frame(people[0], people[1])
    for i, as_of in ((6, "2023-08-01"), (11, "2024-01-01")):
        one = lc.assign_states(persons, people[2], as_of, lc.Rules()).where("state is not null")
        cols = ("prospect_id", "state", "tenure_days", "idle_days", "lead_age_days")
        assert rows(one, *cols) == rows(panel.where(F.col("period") == PERIODS[i]), *cols)


@pytest.mark.parametrize(("tenure", "idle", "n", "state"), [
    (None, None, 0, "prospect"), (900, 181, 4, "churned"), (181, 180, 1, "at_risk"),
    (200, 91, 12, "at_risk"), (91, 90, 1, "active"), (90, 90, 1, "new"), (1, 0, 9, "new"),
    (365, 0, 6, "loyal"), (181, 90, 6, "loyal"), (180, 0, 20, "active"), (500, 30, 5, "active"),
    (700, 400, 8, "churned")])
def test_state_boundaries(frame, tenure, idle, n, state):
    d = frame("t double, i double, n bigint", [(None if tenure is None else float(tenure),
                                               None if idle is None else float(idle), n)])
    assert d.select(lc.classify(F.col("t"), F.col("i"), F.col("n"), lc.Rules())).first()[0] == state


def test_transitions_conserve_people_and_respect_the_rules(people):
    c = lc.transition_counts(_panel(people))
    assert c.count() == 36
    assert c.agg(F.sum("people")).first()[0] == 10 + 5 + 11 + 11
    assert lc.observed_impossible(c, lc.Rules()).agg(F.sum("people")).first()[0] == 0


def test_impossible_pairs_follow_the_thresholds():
    default = set(lc.impossible_transitions(lc.Rules()))
    assert ("active", "churned") in default and ("at_risk", "churned") not in default
    near = set(lc.impossible_transitions(lc.Rules(at_risk_days=160)))
    assert ("active", "churned") not in near and ("churned", "at_risk") in near
    with pytest.raises(ValueError, match="churn_days"):
        lc.Rules(churn_days=90)


def test_cohorts_keep_their_denominator_and_censor(people, frame):
    more = {"D5": "2023-01-25", "D6": "2023-01-30", "D7": "2023-03-20"}
    customers = people[1].unionByName(frame(
        "customer_id string, prospect_id string, customer_since timestamp_ntz, "
        "acquisition_channel string", [(c, "R" + c[1:], day(d), "paid") for c, d in more.items()]))
    orders = people[2].unionByName(frame(
        "customer_id string, order_ts timestamp_ntz, net_amount double",
        [("D5", day("2023-01-25"), 10.0), ("D5", day("2023-02-10"), 20.0),
         ("D6", day("2023-01-30"), 40.0), ("D6", day("2023-03-03"), 5.0),
         ("D7", day("2023-03-20"), 8.0), ("D7", day("2023-04-02"), 9.0)]))
    t = cohorts.cohort_retention(customers, orders, "2023-01-01", "2023-05-01")
    cell = {(r["cohort"], r["months_since_acquisition"]): r for r in t.collect()}
    jan, mar = date(2023, 1, 1), date(2023, 3, 1)
    assert [cell[jan, k]["retention"] for k in range(4)] == pytest.approx([1, 2 / 3, 2 / 3, 1 / 3])
    assert cell[mar, 1]["retention"] == 0.5 and cell[mar, 2]["retention"] is None
    assert cell[jan, 2]["cumulative_revenue_per_customer"] == pytest.approx((36 + 30 + 45) / 3)
    one = cohorts.pooled_retention(t, 1).orderBy("months_since_acquisition").collect()
    assert [r["customers"] for r in one] == [5, 5]
    assert [r["retention"] for r in one] == pytest.approx([1, 0.6])


def test_quintiles_share_ties(frame):
    d = frame("id int, v double", [(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, 5, 6,
                                                                         7])])
    s = by(segments.quintile_scores(d, "id", {"q": ("v", True)}), "id")
    assert [s[i]["q"] for i in range(10)] == [2, 2, 2, 2, 3, 3, 4, 4, 5, 5]


# ------------------------------------------------------------------ experiment and numbers
def test_two_proportions_closed_form(frame):
    d = frame("treated boolean, y boolean", [(False, i < 40) for i in range(200)]
              + [(True, i < 60) for i in range(200)])
    r = experiment.with_p_normal(experiment.two_proportions(experiment.arm_sums(
        d, {"m": F.col("y")}))).first()
    se = math.sqrt(0.2 * 0.8 / 200 + 0.3 * 0.7 / 200)
    assert r["diff"] == pytest.approx(0.1) and r["se"] == pytest.approx(se)
    assert r["p_value"] == pytest.approx(math.erfc(0.1 / se / math.sqrt(2)))
    assert r["relative"] == pytest.approx(0.5)


def test_holm_and_bh(frame):
    d = frame("k int, p double", list(enumerate([0.01, 0.04, 0.03, 0.005])))
    out = by(experiment.benjamini_hochberg(experiment.holm(d, "p"), "p"), "k")
    assert [out[i]["p_holm"] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [out[i]["q_bh"] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_tails_match_known_values():
    assert numeric.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert numeric.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert numeric.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert numeric.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert float(numeric.gammaln(np.array([7.3]))[0]) == pytest.approx(math.lgamma(7.3))
    one = np.array([1.0])
    assert numeric.hyp2f1(one, one, 2 * one, 0.5 * one)[0] == pytest.approx(2 * math.log(2))


def test_permutation_and_aa_behave_under_no_effect(spark):
    d = spark.range(400).select(F.col("id").alias("prospect_id"),
                                (F.xxhash64("id") % 2 == 0).alias("treated"),
                                (F.xxhash64("id", F.lit(9)) % 4 == 0).cast("double").alias("y"))
    p = experiment.permutation_test(d, "y", 200, seed=1).first()
    assert p["replicates"] == 200 and 0.02 < p["p_value"] <= 1
    a = experiment.aa_check(d, "y", 200).first()
    assert a["false_positive_rate"] < 0.12 and a["ci_coverage_of_zero"] > 0.88


def test_regression_adjustment_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 300
    z, x = rng.integers(0, 2, n), rng.normal(size=n)
    y = 1 + 0.5 * z + 2 * x + rng.normal(size=n)
    d = spark.createDataFrame([(bool(a), float(b), float(c)) for a, b, c in zip(z, x, y)],
                              "treated boolean, x double, y double")
    got = experiment.regression_adjusted(d, "y", {"x": F.col("x")}).first()
    xc = x - x.mean()
    design = np.column_stack([np.ones(n), z, xc, xc * z])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    inv = np.linalg.inv(design.T @ design)
    h = np.einsum("ij,jk,ik->i", design, inv, design)
    r = y - design @ beta
    cov = inv @ ((design * (r ** 2 / (1 - h))[:, None]).T @ design) @ inv
    assert got["diff"] == pytest.approx(beta[1]) and got["se"] == pytest.approx(cov[1, 1] ** 0.5)


# ------------------------------------------------------------------ actions and series
def test_priority_list_is_the_global_top(spark):
    d = spark.range(500).select(F.col("id").alias("customer_id"), F.lit("vip_care").alias(
        "action"), (F.xxhash64("id") % 50).cast("double").alias("pred"))
    got = [r["customer_id"] for r in actions.priority_list(d, "pred", 7).orderBy(
        "position").collect()]
    want = [r["customer_id"] for r in d.orderBy(F.desc("pred"), "customer_id").limit(7).collect()]
    assert got == want


def test_daily_series_is_dense_and_weeks_are_complete(frame):
    """Wednesday to the second Tuesday after: one whole week lies inside."""
    sold = [("2023-10-04T08:15:00", 30.5), ("2023-10-04T21:00:00", 9.5), ("2023-10-09T00:00:00", 7.25),
            ("2023-10-12T12:00:00", 50.0), ("2023-10-15T23:59:00", 2.75), ("2023-10-16T00:00:00", 500.0)]
    o = frame("order_ts timestamp_ntz, net_amount double", [(day(at), amount) for at, amount in sold])
    d = forecast.daily_revenue(o, "2023-10-04", "2023-10-10").orderBy("day").collect()
    assert [r["net_revenue"] for r in d] == [40, 0, 0, 0, 0, 7.25]
    w = forecast.weekly_revenue(forecast.daily_revenue(o, "2023-10-04", "2023-10-18")).collect()
    assert [(r["week_start"], r["net_revenue"]) for r in w] == [(date(2023, 10, 9), 60.0)]


def test_intervals_use_only_observed_errors(frame):
    plan = forecast.BacktestPlan("2024-01-01", "2024-01-01", "2024-06-03", "2025-01-06",
                                 calibration_origins=5, min_calibration_origins=3)
    weeks = [date(2024, 1, 1) + timedelta(days=7 * i) for i in range(12)]
    pool = frame("g string, origin date, observed_at date, ratio double, forecast double",
                 [("a", o, o + timedelta(days=14), 1.0 + i / 10, 10.0)
                  for i, o in enumerate(weeks)])
    out = by(forecast.empirical_intervals(pool, pool, ["g"], plan), "origin")
    assert out[weeks[1]]["calibration_n"] == 0 and out[weeks[1]]["lower_50"] is None
    last = out[weeks[11]]
    ratios = [1.0 + i / 10 for i in range(5, 10)]
    assert last["calibration_n"] == 5 and last["calibration_last_observed"] == weeks[11]
    assert last["upper_80"] == pytest.approx(10 * np.quantile(ratios, 0.9))


def test_harmonic_follows_a_weekly_pattern():
    import pandas as pd
    days = pd.date_range("2023-01-01", periods=514, freq="D")
    y = 100 + 20 * (days.dayofweek.to_numpy() == 5)
    paths = forecast.harmonic_paths(days, y.astype(float), np.zeros(514, bool), [300, 500], 14,
                                    days[0], forecast.HarmonicConfig())
    for cut in (300, 500):
        assert paths[cut, True] == pytest.approx(y[cut:cut + 14], rel=0.02)


def test_harmonic_origins_share_sums_but_not_the_future():
    import pandas as pd
    days = pd.date_range("2022-01-01", periods=700, freq="D")
    rng = np.random.default_rng(2)
    y, promo = 50 + 10 * rng.random(700), rng.random(700) < 0.1
    cfg = forecast.HarmonicConfig()
    both = forecast.harmonic_paths(days, y, promo, [400, 600], 21, days[0], cfg, (True, False))
    y[400:] = 999.0
    alone = forecast.harmonic_paths(days[:421], y[:421], promo[:421], [400], 21, days[0], cfg, (True, False))
    for use in (True, False):
        assert alone[400, use] == pytest.approx(both[400, use])


def test_harmonic_refuses_gaps_and_unknown_targets(frame):
    import pandas as pd
    days = pd.date_range("2024-01-01", periods=200, freq="D")
    with pytest.raises(ValueError, match="gaps"):
        forecast.harmonic_paths(days.delete(5), np.ones(199), np.zeros(199, bool), [150], 7, days[0],
                                forecast.HarmonicConfig())
    daily = frame("day date, net_revenue double", [(d.date(), 1.0) for d in days])
    calendar = frame("day date, promotion boolean", [(d.date(), False) for d in days[:190]])
    plan = forecast.BacktestPlan("2024-03-04", "2024-03-04", "2024-06-03", "2024-06-10")
    with pytest.raises(Exception, match="target day"):
        forecast.harmonic_backtest(daily, calendar, plan, [], "2024-01-01").collect()


def test_numbers_converge_or_raise():
    assert float(numeric.hyp2f1(2.5, 3.0, 2.8, 0.9999)) == pytest.approx(6.1457752722e10, rel=1e-8)
    assert float(numeric.hyp2f1(1.0, 1.0, 2.0, 0.5)) == pytest.approx(2 * math.log(2))
    assert numeric.t_quantile(0.9999, 1) == pytest.approx(3183.0988, rel=1e-6)
    with pytest.raises(ArithmeticError):
        numeric.hyp2f1(0.5, 0.5, 1.0, 1 - 1e-9)


def test_a_likelihood_that_keeps_rising_raises():
    from tidemark.operators import clv
    with pytest.raises(ArithmeticError):
        clv.maximise(lambda ps: [float(p[0]) for p in ps], np.zeros(1), [-1e9], [1e9], rounds=4)
    top = clv.maximise(lambda ps: [-float((p[0] - 2) ** 2) for p in ps], np.zeros(1), [-8.0], [8.0])
    assert top[0] == pytest.approx(2, abs=1e-4)

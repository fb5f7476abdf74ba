"""The live issue: all models, the champion's weekly and total intervals."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.operators import kpis

START = date(2018, 1, 1)  # a Monday
PLAN = fc.BacktestPlan("2019-06-03", "2019-06-03", "2019-07-01", "2019-09-30", horizon_weeks=2, calibration_origins=6,
                       min_calibration_origins=3)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, first, days in (("old", 0, 700), ("young", 420, 280)):
        for k in range(first, first + days):
            rows.append((name, START + timedelta(days=k), float(100 + 20 * np.sin(k / 58) + 10 * (k % 7 == 5) + rng.normal(0, 3))))
    return spark.createDataFrame(rows, "seg string, day date, net_revenue double").cache()


@pytest.fixture(scope="module")
def calendar(spark):
    days = [(START + timedelta(days=k), k % 90 < 5) for k in range(800)]
    return spark.createDataFrame(days, "day date, promotion boolean").cache()


@pytest.fixture(scope="module")
def past(daily, calendar):
    old = daily.where("seg = 'old'")
    return fc.baseline_backtest(old, PLAN, ["seg"]).unionByName(
        fc.harmonic_backtest(old, calendar, PLAN, ["seg"], "2018-01-01")).cache()


def test_an_issue_equals_the_backtest_at_the_same_origin(daily, calendar, past):
    issued = fc.issue(daily.where("seg = 'old'"), calendar, "2019-08-05", PLAN, ["seg"], "2018-01-01")
    want = {(r.model, r.horizon_week): r.forecast for r in past.where("origin = date '2019-08-05'").collect()}
    got = {(r.model, r.horizon_week): r.forecast for r in issued.collect()}
    assert set(got) == set(want) and len({m for m, _ in got}) == 4
    for key, value in got.items():
        assert value == pytest.approx(want[key], rel=1e-9)


def test_all_weeks_stay_and_intervals_come_from_the_champion(daily, calendar, past):
    origin = "2019-11-25"
    issued = fc.issue(daily, calendar, origin, PLAN, ["seg"], "2018-01-01")
    weeks, totals = fc.issued_with_intervals(issued, past, "harmonic", PLAN, ["seg"], daily)
    rows = {(r.seg, r.horizon_week): r for r in weeks.collect()}
    assert set(rows) == {(s, k) for s in ("old", "young") for k in (1, 2)}
    assert all(rows["young", k].same_week_last_year is None and rows["young", k].lower_80 is None for k in (1, 2))
    assert all(rows["old", k].same_week_last_year is not None for k in (1, 2))
    mine = [r for r in past.where("model = 'harmonic'").orderBy("origin").collect()]
    for k in (1, 2):
        ratios = [r.actual / r.forecast for r in mine if r.horizon_week == k][-6:]
        low, high = np.quantile(ratios, [0.1, 0.9]) * rows["old", k].harmonic
        assert [rows["old", k].lower_80, rows["old", k].upper_80] == pytest.approx([low, high])
    by_origin = {}
    for r in mine:
        a, f = by_origin.get(r.origin, (0.0, 0.0))
        by_origin[r.origin] = (a + r.actual, f + r.forecast)
    ratios = [a / f for _, (a, f) in sorted(by_origin.items())][-6:]
    total = {r.seg: r for r in totals.collect()}
    point = sum(rows["old", k].harmonic for k in (1, 2))
    assert total["old"].forecast == pytest.approx(point)
    assert [total["old"].lower_50, total["old"].upper_50] == pytest.approx(list(np.quantile(ratios, [0.25, 0.75]) * point))
    assert total["young"].calibration_n == 0 and total["young"].lower_50 is None


def test_total_ratios_are_observed_after_the_last_week(past):
    pool = fc.total_pool(fc.horizon_totals(past, ["seg"]), PLAN)
    assert pool.where(F.col("observed_at") != F.date_add("origin", 14)).count() == 0 and pool.count() > 20


def test_history_tail_is_taken_per_series(spark):
    rows = [("a", date(2020, 1, d)) for d in (6, 13, 20)] + [("b", date(2019, 1, 7))]
    t = kpis.history_tail(spark.createDataFrame(rows, "seg string, week_start date"), 2, ["seg"])
    assert sorted((r.seg, r.week_start.day) for r in t.collect()) == [("a", 13), ("a", 20), ("b", 7)]

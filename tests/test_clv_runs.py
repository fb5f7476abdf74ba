"""CLV models of several runs fitted side by side."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import simulate

from tidemark.operators import clv, value
from tidemark.sources import adapters as ad

RUNS = ["2000-01-01", "2000-07-01"]
SF = "/root/testdata/sf0.001"


def summaries(spark):
    rng = np.random.default_rng(6)
    rows = []
    for run, seed, r in ((datetime(2000, 1, 1), 1, 0.8), (datetime(2000, 7, 1), 2, 1.6)):
        for x, t_x, age in simulate(500, seed, r=r):
            spend = float(rng.gamma(4 * x, 20 / (x * rng.gamma(5, 1)))) if x else 0.0
            rows.append((run, x, t_x, age, spend))
    return spark.createDataFrame(rows, "run_cutoff timestamp_ntz, x double, t_x double, T double, monetary double")


def test_joint_fits_equal_single_fits_in_the_passes_of_one(spark, monkeypatch):
    both = summaries(spark).persist()
    passes = []
    real = clv.summed
    monkeypatch.setattr(clv, "summed", lambda *a: passes.append(1) or real(*a))
    bg, gg = clv.fit_bgnbd_runs(both), None
    joint = len(passes)
    alone = []
    for run in bg:
        passes.clear()
        one = both.where(F.col("run_cutoff") == F.lit(run))
        single = clv.fit_bgnbd(one)
        alone.append(len(passes))
        assert [getattr(bg[run], k) for k in ("r", "alpha", "a", "b")] == pytest.approx(
            [getattr(single, k) for k in ("r", "alpha", "a", "b")], rel=1e-4)
    assert joint == max(alone)  # a run that ends early does not add a pass
    gg = clv.fit_gamma_gamma_runs(both)
    for run, g in gg.items():
        single = clv.fit_gamma_gamma(both.where(F.col("run_cutoff") == F.lit(run)))
        assert g.p * g.v / (g.q - 1) == pytest.approx(single.p * single.v / (single.q - 1), rel=1e-4)
    assert bg[datetime(2000, 1, 1)] != bg[datetime(2000, 7, 1)]


def test_no_start_or_box_hides_a_better_gamma_gamma_fit(spark):
    """The optimum is at least as likely as every point of a coarse grid."""
    one = summaries(spark).where("run_cutoff = timestamp_ntz '2000-07-01'")
    g = clv.fit_gamma_gamma(one)
    x, m = (np.array(v) for v in zip(*[(r.x, r.monetary) for r in one.where("x >= 1 and monetary > 0").collect()]))
    best = clv.gamma_gamma_ll(g, x, m).sum()
    for p in (0.5, 2, 4, 8):
        for q in (1.5, 3, 5, 9):
            for v in (20.0, 60.0, 200.0):
                assert clv.gamma_gamma_ll(clv.GammaGamma(p, q, v), x, m).sum() <= best + 1e-6


def test_a_run_without_enough_repeaters_is_named(spark):
    few = spark.createDataFrame([(datetime(2000, 1, 1), 1.0, 2.0, 9.0, 5.0)] * 3,
                                "run_cutoff timestamp_ntz, x double, t_x double, T double, monetary double")
    with pytest.raises(ValueError, match="2000-01-01.*3 repeat"):
        clv.fit_gamma_gamma_runs(few)
    with pytest.raises(ValueError, match="contradict"):
        clv.fit_bgnbd_runs(few.withColumn("t_x", F.lit(10.0)))


def test_value_rows_hold_the_clv_of_each_run(spark):
    t = ad.ledger(spark, SF)
    rows = value.build_rows(t, RUNS).select("run_cutoff", "customer_id", *clv.CLV_COLUMNS).collect()
    for run in RUNS:
        s = clv.purchase_summary(t["orders"], [run])
        want = {r.customer_id: r for r in clv.score(s, clv.fit_bgnbd(s), clv.fit_gamma_gamma(s), 180).collect()}
        mine = [r for r in rows if str(r.run_cutoff)[:10] == run]
        assert len(mine) == len(want) > 50
        for r in mine:
            assert r.bgnbd_p_alive == pytest.approx(want[r.customer_id].bgnbd_p_alive, rel=1e-3)
            assert r.clv_expected_revenue == pytest.approx(want[r.customer_id].clv_expected_revenue, rel=1e-2)

"""Holm and Benjamini-Hochberg over families that are cut into buckets, against the plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment as ex


def plain(ps):
    order, m = sorted(range(len(ps)), key=lambda i: ps[i]), len(ps)
    holm, bh, top, least = {}, {}, 0.0, 1.0
    for r, i in enumerate(order):
        holm[i] = top = max(top, (m - r) * ps[i])
    for r, i in reversed(list(enumerate(order))):
        bh[i] = least = min(least, ps[i] * m / (r + 1))
    return {i: (min(1.0, holm[i]), bh[i]) for i in order}


def test_families_with_ties(spark):
    rng = random.Random(3)
    families = {"a": [round(rng.random() ** 3, 2) for _ in range(400)], "b": [rng.random() / 50 for _ in range(60)], "c": [0.2]}
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)]
    d = spark.createDataFrame(rows, "f string, i int, p double").repartition(3)
    got = ex.benjamini_hochberg(ex.holm(d, "p", family=["f"]), "p", family=["f"])
    assert got.columns == ["f", "i", "p", "p_holm", "q_bh"]
    want = {(f, i): v for f, ps in families.items() for i, v in plain(ps).items()}
    found = {(r.f, r.i): (r.p_holm, r.q_bh) for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_a_missing_p_counts_in_its_family_and_stays_missing(spark):
    d = spark.createDataFrame([(0, None), (1, 0.01), (2, 0.4)], "i int, p double")
    got = {r.i: (r.p_holm, r.q_bh) for r in ex.benjamini_hochberg(ex.holm(d, "p"), "p").collect()}
    assert got[1] == pytest.approx((0.02, 0.015)) and got[2] == pytest.approx((0.4, 0.4))
    assert got[0] == (1.0, pytest.approx(0.015))


def test_no_window_holds_a_whole_family(spark):
    d = spark.range(3000).select("id", (F.col("id") / 3000.0).alias("p"))
    plan = ex.benjamini_hochberg(d, "p")._jdf.queryExecution().executedPlan().toString()
    assert "currentrow, unboundedfollowing" not in plan.lower().replace("$()", "")  # each row would read all later ones

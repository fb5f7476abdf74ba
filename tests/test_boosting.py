"""Boosted trees against a plain best-first search over all splits of the raw values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as bo

SCHEMA = "id long, a double, b double, c string, y double, late boolean"


def sample(n, loss, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = round(rng.gauss(0, 1), 1), float(rng.randint(0, 6)), rng.choice(["x", "y", "z"])
        rate = math.exp(0.6 * a + 0.3 * (b > 3) - (c == "y"))
        y = float(rng.random() < rate / (1 + rate)) if loss == "log" else float(sum(rng.random() < rate / 12 for _ in range(12)) * (1 + rng.random()))
        out.append((i, a, b, c, y, i % 4 == 0))
    return out


def matrix(rows, levels=("x", "y", "z")):
    return np.array([[r[1], r[2], *[float(r[3] == v) for v in levels]] for r in rows])


def plain(x, y, cfg):
    """Margins and leaf counts by trying every value of every column as a threshold, node by node."""
    mean = y.mean()
    margin = np.full(len(y), math.log(mean / (1 - mean)) if cfg.loss == "log" else math.log(mean))
    sizes = []
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-margin)) if cfg.loss == "log" else np.exp(margin)
        g, h = p - y, (p * (1 - p) if cfg.loss == "log" else p)

        def best(rows):
            s = lambda r: g[r].sum() ** 2 / (h[r].sum() + cfg.l2)
            found = (0.0, None, None)
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    lo, hi = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if min(len(lo), len(hi)) >= cfg.min_leaf:
                        gain = s(lo) + s(hi) - s(rows)
                        if gain > found[0] + 1e-12:
                            found = (gain, lo, hi)
            return found

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < cfg.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            if leaves[k][0][0] <= 0:
                break
            (_, lo, hi), _ = leaves.pop(k)
            leaves += [(best(lo), lo), (best(hi), hi)]
        sizes.append(sorted(len(r) for _, r in leaves))
        for _, rows in leaves:
            margin[rows] -= cfg.rate * g[rows].sum() / (h[rows].sum() + cfg.l2)
    return margin, sizes


@pytest.mark.parametrize("loss,block", [("log", 200_000), ("poisson", 200_000), ("log", 60), ("poisson", 60)])
def test_trees_equal_the_plain_search(spark, monkeypatch, loss, block):
    """In one block, and in rounds over several."""
    monkeypatch.setattr(bo, "BLOCK_ROWS", block)
    rows = sample(500, loss)
    cfg = bo.Boosting(loss, trees=4, min_leaf=12, rate=0.3)
    model, = bo.fit_boosted(spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["c"], "y", cfg)
    want, sizes = plain(matrix(rows), np.array([r[4] for r in rows]), cfg)
    assert max(map(len, sizes)) == cfg.leaves  # the cap is reached
    got = {r.id: r.p for r in model.score(spark.createDataFrame(rows, SCHEMA), "p").collect()}
    expected = cfg.mean(want)
    assert max(abs(got[i] - expected[i]) for i in range(500)) < 1e-9


def test_shared_rounds_equal_fits_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 90)
    df = spark.createDataFrame(sample(400, "log", 8), SCHEMA)
    cfg = bo.Boosting("log", trees=3, min_leaf=15)
    both, early = bo.fit_boosted(df, ["a", "b"], ["c"], "y", cfg, [F.lit(True), ~F.col("late")])
    alone, = bo.fit_boosted(df, ["a", "b"], ["c"], "y", cfg)
    want, _ = plain(matrix([r for r in sample(400, "log", 8) if not r[5]]),
                    np.array([r[4] for r in sample(400, "log", 8) if not r[5]]), cfg)
    got = [r.p for r in early.score(df.where("not late"), "p").orderBy("id").collect()]
    assert got == pytest.approx(list(cfg.mean(want)), abs=1e-9)
    pair = both.score(alone.score(df, "q"), "p").select("p", "q").collect()
    assert all(r.p == pytest.approx(r.q, abs=1e-12) for r in pair)


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("v"), (F.col("id") > 2000).cast("double").alias("y"))
    inputs = bo.learn_inputs(df, ["v"], [])
    assert 200 <= len(inputs.edges[0]) <= 254
    model, = bo.fit_boosted(df, ["v"], [], "y", bo.Boosting("log", trees=20, min_leaf=50, rate=0.3))
    ends = model.score(df, "p").agg(F.max(F.when(F.col("v") <= 1950, F.col("p"))).alias("lo"),
                                    F.min(F.when(F.col("v") > 2050, F.col("p"))).alias("hi")).first()
    assert ends.lo < 0.05 and ends.hi > 0.9


def test_missing_numbers_unseen_levels_and_null_labels(spark):
    rows = [(i, None if i % 3 == 0 else 1.0, float("nan") if i % 5 == 0 else 2.0, None if i % 7 == 0 else "x",
             None if i % 11 == 0 else float(i % 3 == 0), False) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    model, = bo.fit_boosted(df, ["a", "b"], ["c"], "y", bo.Boosting("log", trees=10, min_leaf=20, rate=0.5))
    p = {r.id: r.p for r in model.score(df.withColumn("c", F.lit("new")), "p").collect()}
    assert p[0] > 0.9 and p[1] < 0.1 and len(p) == 300


def test_one_kind_of_label_is_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "x", 1.0, False)] * 3, SCHEMA)
    with pytest.raises(ValueError):
        bo.fit_boosted(df, ["a"], [], "y", bo.Boosting("log", trees=1, min_leaf=1))


def test_best_first_and_lazy_rounds():
    """The selection asks for nothing it cannot need, and splits the largest gain first."""
    g = bo.Growth(bo.Boosting("log", trees=1, min_leaf=1, leaves=3), 0.0)
    g.learn({0: ((1.0, 9.0, 9.0), (5.0, 0, 1, (1.0, 4.0, 4.0)))})
    assert g.asked == [1, 2]
    g.learn({1: ((1.0, 4.0, 4.0), (1.0, 0, 0, (0.0, 2.0, 2.0))), 2: ((0.0, 5.0, 5.0), (2.0, 1, 3, (0.0, 2.0, 2.0)))})
    assert g.done and list(np.flatnonzero(g.trees[0].left != np.arange(5))) == [0, 2]

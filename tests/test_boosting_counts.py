"""Sums of one child and bundles of features; values of few kinds in one pass."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting as bo


def block(n=4000, seed=4):
    rng = np.random.default_rng(seed)
    x = np.array([rng.integers(0, 2, n), rng.integers(0, 200, n), rng.integers(0, 5, n), np.zeros(n), rng.integers(0, 257, n) // 2, rng.integers(0, 2, n)]).astype(np.uint8)
    y = (x[1] / 50 + x[2] * x[0] + rng.random(n)).astype("<f8")
    return x, y, np.where(rng.random(n) < 0.6, 3, 2).astype("<i8")


def test_only_the_child_with_fewer_rows_is_counted_and_all_sums_are_right():
    x, y, m = block()
    width, bins, sizes = len(x), 257, x.max(axis=1).astype(int) + 1
    cfg = bo.Boosting("poisson", trees=3, min_leaf=20, leaves=8)
    for ahead in (True, False):
        state, growth, counted, asked = bo._block({"x": x.tobytes(), "y": y.tobytes(), "m": m.tobytes()}, width, [0.1, 0.2]), bo.Growth(cfg, 0.1, ahead), 0, 0
        mine = m & 1 == 1
        while not growth.done:
            margin = growth.base + sum((t.value[t.leaf(x)] for t in growth.trees), np.zeros(len(y)))
            g, h = cfg.slopes(margin, y)
            tree, wanted, few = growth.explored(), growth.asked, growth.counted()
            at = tree.leaf(x)
            rows = {i: np.flatnonzero((at == i) & mine) for i in wanted}
            assert few == wanted == [0] or all(2 * len(rows[i]) <= len(rows[i]) + len(rows[j]) for i in few for j in wanted
                                               if any({i, j} == {n.left, n.right} for n in growth.nodes))
            counted, asked = counted + sum(len(rows[i]) for i in few), asked + sum(len(r) for r in rows.values())
            found = {}
            for _, nodes, hists in bo._sums(state, cfg, {0: (growth.trees, tree, few)}, bins, width):
                found = dict(zip(nodes, hists))
            nodes, before = growth.nodes, len(growth.trees)
            growth.take(found, sizes)
            for i in wanted:
                want = np.array([[np.bincount(x[f, rows[i]], w, bins) for w in (g[rows[i]], h[rows[i]], np.ones(len(rows[i])))] for f in range(width)])
                assert np.isclose(nodes[i].g, want[0, 0].sum()) and nodes[i].n == len(rows[i])
                if len(growth.trees) == before and i in growth.hists:
                    assert np.allclose(growth.hists[i], want, atol=1e-9) and np.array_equal(growth.hists[i][:, 2], want[:, 2])
        assert counted < 0.8 * asked


def test_features_with_few_bins_are_counted_together():
    x, *_ = block()
    bundles = bo._bundles(x)
    assert sorted(f for fs, *_ in bundles for f, _ in fs) == list(range(len(x))) and len(bundles) == 3
    for fs, code, cells, marginals in bundles:
        sums, at = np.bincount(code, minlength=cells), 0
        sums = sums if marginals is None else sums @ marginals
        for f, size in fs:
            assert np.array_equal(sums[at:at + size], np.bincount(x[f], minlength=size))
            at += size


def test_few_values_are_exact_and_bounded(spark):
    df = spark.range(0, 3000, 1, 7).select(
        (F.col("id") % 235).cast("double").alias("_f0"), (F.col("id") % 236).cast("double").alias("_f1"), F.col("id").cast("double").alias("_f2"),
        F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, 4.0).alias("_f3"), F.lit(None).cast("double").alias("_f4"))
    got = bo.few_values(df, [f"_f{i}" for i in range(5)], 235)
    assert {c: sorted(v) for c, v in got.items()} == {"_f0": [float(i) for i in range(235)], "_f3": [4.0], "_f4": []}
    assert bo.few_values(df.limit(0), ["_f0"], 235) == {"_f0": []}


def test_equal_partings_take_the_first_feature_and_margins_follow_the_leaves():
    """Features 1 and 2 part every node alike, in other bins and other orders of addition."""
    rng = np.random.default_rng(1)
    n = 3000
    a = rng.integers(0, 2, n)
    x = np.array([rng.integers(0, 3, n), a * 90 + rng.integers(0, 60, n), a]).astype(np.uint8)
    y = (3.0 * a + rng.random(n) / 7).astype("<f8")
    cfg = bo.Boosting("poisson", trees=4, min_leaf=900, leaves=3)
    state, growth = bo._block({"x": x.tobytes(), "y": y.tobytes(), "m": np.ones(n, "<i8").tobytes()}, 3, [0.1]), bo.Growth(cfg, 0.1, False)
    while not growth.done:
        for _, nodes, hists in bo._sums(state, cfg, {0: (growth.trees, growth.explored(), growth.counted())}, 257, 3):
            growth.take(dict(zip(nodes, hists)), np.array([3, 257, 2]))
    assert all(t.feature[0] == 1 and t.left[0] != 0 for t in growth.trees)
    margin = np.zeros(n)
    for t in growth.trees:
        before = margin.copy()
        t.add(x, margin)
        assert np.array_equal(margin, before + t.value[t.leaf(x)])


def test_fits_of_several_blocks_equal_the_rounds(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), (F.hash("id") % 90).cast("double").alias("a"), (F.hash("id", F.lit(1)) % 7).cast("double").alias("b"),
                                  F.pmod(F.hash("id", F.lit(2)), F.lit(5)).cast("double").alias("y"))
    member, got = [F.col("id") % 3 != 0, F.lit(True)], {}
    monkeypatch.setattr(bo, "BLOCK_ROWS", 800)
    monkeypatch.setattr(bo, "SETTLE", 2)
    for blocks, direct in ((4, 32), (1, 32), (1, 1)):
        monkeypatch.setattr(bo, "ALONE_BLOCKS", blocks)
        monkeypatch.setattr(bo, "DIRECT", direct)
        models = bo.fit_boosted(df, ["a", "b"], [], "y", bo.Boosting("poisson", trees=7, min_leaf=40), member)
        got[blocks, direct] = [[(t.feature[i], t.bin[i], round(t.value[i], 10)) for t in m.trees for i in np.flatnonzero(t.left != np.arange(len(t.left)))] for m in models]
    one, *others = got.values()
    assert all(sorted(o[k]) == sorted(one[k]) for o in others for k in (0, 1)) and len(one[0]) > 7

"""One block: every fit grows in a task of its own; a node's rows are parted once."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting as bo


def test_fits_of_one_block_grow_in_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(bo, "_round", lambda *a: (_ for _ in ()).throw(AssertionError("a round for one block")))
    df = spark.range(270_000).select(F.col("id"), (F.col("id") % 50).cast("double").alias("v"), ((F.col("id") % 50) % 7).cast("double").alias("y"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("alone", "alone")
    one, two = bo.fit_boosted(df, ["v"], [], "y", bo.Boosting("poisson", trees=2, min_leaf=60), [F.col("id") % 3 != 0, F.lit(True)])
    assert len(one.trees) == len(two.trees) == 2
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("alone") for s in tracker.getJobInfo(j).stageIds]
    assert stages[-1] is None or any(s and s.numTasks == 2 for s in stages)


def test_sums_equal_plain_sums_after_later_trees():
    rng = np.random.default_rng(2)
    n, width, bins = 500, 3, 6
    x, y, m = rng.integers(0, 5, (width, n)).astype(np.uint8), None, np.where(rng.random(n) < 0.7, 3, 2).astype("<i8")
    y = x[0] + 2.0 * (x[1] > 2) + rng.random(n)
    cfg = bo.Boosting("poisson", trees=3, min_leaf=5, leaves=6)
    state = bo._block({"x": x.tobytes(), "y": y.tobytes(), "m": m.tobytes()}, width, [0.1, 0.2])
    growths = [bo.Growth(cfg, 0.1), bo.Growth(cfg, 0.2)]
    while not all(g.done for g in growths):
        grow = {k: (g.trees, g.explored(), g.asked) for k, g in enumerate(growths) if not g.done}
        found = {k: {} for k in grow}
        for fit, nodes, hists in bo._sums(state, cfg, grow, bins, width):
            margin = growths[fit].base + sum((t.value[t.leaf(x)] for t in growths[fit].trees), np.zeros(n))
            g, h = cfg.slopes(margin, y)
            at = growths[fit].explored().leaf(x)
            for node, hist in zip(nodes, hists):
                rows = (at == node) & (m >> fit & 1).astype(bool)
                for f in range(width):
                    want = [np.bincount(x[f, rows], w, bins) for w in (g[rows], h[rows], np.ones(rows.sum()))]
                    assert np.allclose(hist[f], want, atol=1e-12)
                total, gain, k, left = bo.best_splits(hist, cfg)
                f = int(gain.argmax())
                found[fit][node] = tuple(total[f]), (float(gain[f]), f, int(k[f]), tuple(left[f]))
        for k in grow:
            growths[k].learn(found[k])
    assert any(len(t.left) > 3 for g in growths for t in g.trees)

"""Permutation importance against scoring every shuffled row, with several buckets of margins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models


def auc(y, p):
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    return float(((pos > neg) + (pos == neg) / 2).mean())


def test_importance_equals_scoring_every_shuffled_row(spark, monkeypatch):
    rows = [(i, float(i * 7 % 23), float(i % 3), "uvw"[i * 5 % 7 % 3], int((i * 7 % 23) + 6 * (i % 3) + i * 31 % 17 > 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y int")
    model = models.logistic_pipeline(["a", "b"], ["c"], "y", 200).fit(df)
    seen = []
    real = models.probability
    monkeypatch.setattr(models, "probability", lambda *a: seen.append(1) or real(*a))
    monkeypatch.setattr(models, "BUCKET_ROWS", 30)
    got = {r.feature: (r.auc_drop, r.auc_drop_std) for r in models.permutation_importance(model, df, ["a", "b"], ["c"], "y", "id", repeats=2).collect()}
    assert not seen and set(got) == {"a", "b", "c"}  # no shuffled copy is scored
    hashes = df.select(*[models.hash01(F.col("id"), 7 + k).alias(f"h{k}") for k in range(3)], "id").collect()
    order = [sorted(range(200), key=lambda i: (-hashes[i][f"h{k}"], hashes[i].id)) for k in range(3)]
    at = {hashes[i].id: i for i in range(200)}
    shuffled = []
    for b in range(2):
        for h, d in zip(order[0], order[b + 1]):
            home, donor = rows[hashes[h].id], rows[hashes[d].id]
            for f in (1, 2, 3):
                shuffled.append((b, f, *[donor[k] if k == f else home[k] for k in range(5)]))
    assert len(at) == 200
    scored = real(model, spark.createDataFrame(shuffled, "rep int, f int, id long, a double, b double, c string, y int"), "p").select("rep", "f", "y", "p").collect()
    base = real(model, df, "p").select("y", "p").collect()
    whole = auc(np.array([r.y for r in base]), np.array([round(r.p, 12) for r in base]))
    for f, name in ((1, "a"), (2, "b"), (3, "c")):
        drops = [whole - auc(*(np.array(v) for v in zip(*[(r.y, round(r.p, 12)) for r in scored if (r.rep, r.f) == (b, f)]))) for b in range(2)]
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)

"""Replicate statistics against a loop over replicates."""

import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment
from tidemark.operators import metrics as m
from tidemark.operators import replicates as rp

B = 40


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 300
    value = np.where(rng.random(n) < 0.6, 0.0, rng.gamma(2, 50, n))
    return pd.DataFrame({
        "who": rng.integers(0, 120, n), "label": (rng.random(n) < 0.3).astype(int), "value": value,
        "a": np.where(rng.random(n) < 0.35, 0.5, rng.random(n).round(2)),  # a third of the rows share one score
        "b": value + rng.normal(0, 60, n)})


def weights(spark, data, seed):
    """Each row's weight per replicate, through the hash of its cluster."""
    ids = spark.createDataFrame(data[["who"]].drop_duplicates()).select("who", F.xxhash64("who", F.lit(seed)).alias("h")).toPandas()
    w = dict(zip(ids["who"], rp.poisson_weights(ids["h"].to_numpy(), B)))
    return np.array([w[x] for x in data["who"]])


def lorenz(score, value, w):
    g = pd.DataFrame({"s": score, "n": w, "v": w * value}).groupby("s").sum().sort_index(ascending=False)
    g = g[g["n"] > 0]
    return np.concatenate([[0], g["n"].cumsum()]), np.concatenate([[0], g["v"].cumsum()])


def plain(data, w, score, target):
    """Metrics of one replicate, from the repeated rows."""
    y, s = data[target].to_numpy(float), data[score].to_numpy(float)
    n, v = lorenz(s, y, w)
    out = {"average_precision": (np.diff(v) * v[1:] / n[1:]).sum() / v[-1], "rmse": np.sqrt((w * (y - s) ** 2).sum() / w.sum()),
           "mae": (w * abs(y - s)).sum() / w.sum(), "capture_top10": np.interp(0.1 * n[-1], n, v) / v[-1]}
    neg = np.diff(n) - np.diff(v)
    out["roc_auc"] = (neg * (v[:-1] + np.diff(v) / 2)).sum() / (v[-1] * (n[-1] - v[-1]))

    def gini(x):
        n, v = lorenz(x, y, w)
        return 2 * (np.diff(n) * (v[1:] + v[:-1]) / 2).sum() / (n[-1] * v[-1]) - 1
    out["normalized_gini"] = gini(s) / gini(y)
    return out


@pytest.mark.parametrize("kind", ["label", "value"])
def test_intervals_equal_a_loop(spark, data, kind):
    w = weights(spark, data, 7)
    stats = ("roc_auc", "average_precision") if kind == "label" else ("rmse", "mae", "normalized_gini", "capture_top10")
    run = m.cluster_bootstrap if kind == "label" else m.value_bootstrap
    got = {r["model"]: r for r in run(spark.createDataFrame(data).repartition(5), {"a": "a", "b": "b"}, kind, "who", B, 7, ["a"]).collect()}
    assert set(got) == {"a", "b", "b minus a"}  # only the named reference
    loops = {s: pd.DataFrame([plain(data, w[:, k], s, kind) for k in range(B)]) for s in ("a", "b")}
    loops["b minus a"] = loops["b"] - loops["a"]
    for name, frame in loops.items():
        for stat in stats:
            want = np.percentile(frame[stat], [2.5, 97.5])
            assert [got[name][f"{stat}_low"], got[name][f"{stat}_high"]] == pytest.approx(list(want), abs=1e-9)


def test_few_and_no_buckets_give_the_same(spark, data, monkeypatch):
    df = spark.createDataFrame(data)
    base = rp.resample(df, {"a": "a", "b": "b"}, "value", "who", B, 1)
    monkeypatch.setattr(rp, "CHUNK", B * 7)  # chunks that cut through tied groups
    monkeypatch.setattr(rp, "column_bounds", lambda rows, cols: [[] for _ in cols])
    other = rp.resample(df, {"a": "a", "b": "b"}, "value", "who", B, 1)
    for name in ("n", "v", "squares", "errors", "area", "ap", "top"):
        assert getattr(other, name) == pytest.approx(getattr(base, name), rel=1e-9)


def test_rows_with_nulls_and_a_model_without_positives(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (2, None, 0.2), (3, 0.0, None)], "who int, y double, a double")
    r = m.cluster_bootstrap(df, {"a": "a"}, "y", "who", 10).first()
    assert r["replicates"] == 10 and np.isnan(r["roc_auc_low"])


def test_weights_are_poisson_and_independent():
    w = rp.poisson_weights(np.arange(20_000) * 7919, 3)
    assert w.mean(0) == pytest.approx([1, 1, 1], abs=0.03) and w.var(0) == pytest.approx([1, 1, 1], abs=0.05)
    assert abs(np.corrcoef(w.T)[0, 1]) < 0.02
    assert (rp._mixed_at(np.array([5, 9]), np.array([2, 0])) == rp.mixed(np.array([5, 9]), 3)[[0, 1], [2, 0]]).all()


@pytest.mark.parametrize("spread", [6.0, 0.01])
def test_permutation_sums_equal_sorting(spark, monkeypatch, spread):
    """Also with a window so narrow that the cut lies in an outer cell."""
    monkeypatch.setattr(rp, "SPREAD", spread)
    df = spark.range(300).select("id", (F.xxhash64("id", F.lit(9)) % 7).cast("double").alias("y"))
    rows = df.select(F.xxhash64("id", F.lit(3)).alias("c"), "y").toPandas()
    z = rp.mixed(rows["c"].to_numpy(), B)
    y = rows["y"].to_numpy()
    want = [y[np.argsort(z[:, k])[:110]].sum() for k in range(B)]
    assert list(rp.smallest_sums(df.repartition(4), "id", "y", B, 110, 3)) == pytest.approx(want)
    n, total, count, hits = rp.split_sums(df, "id", "y", B, 0.5, 3)
    mask = rp.uniform(rows["c"].to_numpy(), B) < 0.5
    assert (n, total) == (300, y.sum()) and list(count) == list(mask.sum(0)) and list(hits) == pytest.approx(list(y @ mask))


def test_one_arm_has_no_p_value(spark):
    df = spark.range(5).select(F.col("id").alias("prospect_id"), F.lit(True).alias("treated"), F.lit(1.0).alias("y"))
    assert experiment.permutation_test(df, "y", 10).first()["p_value"] is None


def test_no_replicate_rows_before_an_exchange(spark, data, monkeypatch):
    """The plan of the bootstrap holds no Generate, and moves rows once."""
    seen = []
    real = rp.sum_vectors

    def spy(df, keys, vectors):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        seen.append(out.getvalue())
        return real(df, keys, vectors)
    monkeypatch.setattr(rp, "sum_vectors", spy)
    rp.resample(spark.createDataFrame(data), {"a": "a"}, "label", "who", B, 1)
    assert len(seen) == 2 and all("Generate" not in x for x in seen)
    assert [x.count("Exchange") for x in seen] == [0, 1]

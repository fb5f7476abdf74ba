"""Ranking core against brute force, with one score and one run holding most rows."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators import monitoring as mo
from tidemark.operators import ranking as rk


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    out = []
    for i in range(600):
        run = "a" if i % 3 else rng.choice("bc")
        s = 0.5 if rng.random() < 0.4 else round(rng.random(), 2)
        out.append((i, run, s, int(rng.random() < s), rng.random() * 100))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(
        data, "id bigint, run string, s double, y int, v double").cache()


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_and_average_precision_match_pair_counting(df, data):
    got = m.discrimination(df, {"m": "s"}, "y").first()
    assert got["roc_auc"] == pytest.approx(brute_auc([(d[2], d[3]) for d in data]))
    per = {r["run"]: r["roc_auc"] for r in m.discrimination(df, {"m": "s"}, "y", ["run"]).collect()}
    for run in "abc":
        assert per[run] == pytest.approx(brute_auc([(d[2], d[3]) for d in data if d[1] == run]))


def test_running_totals_do_not_depend_on_the_bounds(df):
    base = None
    for bounds in ([], [0.5], [0.1, 0.2, 0.4999, 0.5, 0.9]):
        r = rows(rk.ranked_scores(df, "s", {"y": F.col("y")}, ["run"], bounds=bounds), "run",
                 "score", "n", "before_n", "upto_y", "total_n")
        base = base or r
        assert r == base


def test_row_ranks_break_ties_by_id_even_in_a_hot_score(df, data):
    got = {r["id"]: r["rank"] for r in rk.row_ranks(df, "s", "id", ["run"]).collect()}
    for run in "abc":
        want = sorted((d for d in data if d[1] == run), key=lambda d: (-d[2], d[0]))
        assert [got[d[0]] for d in want] == list(range(1, len(want) + 1))


def test_row_ranks_with_text_ids(spark, data):
    text = spark.createDataFrame([(f"P{d[0]:05d}", d[2]) for d in data], "id string, s double")
    got = {r["id"]: r["rank"] for r in rk.row_ranks(text, "s", "id").collect()}
    want = sorted(((f"P{d[0]:05d}", d[2]) for d in data), key=lambda d: (-d[1], d[0]))
    assert [got[i] for i, _ in want] == list(range(1, len(want) + 1))


def test_equal_frequency_bins_follow_the_quantile_rule(spark):
    r = spark.range(1, 13).select(rk.equal_frequency_bin(F.col("id"), F.lit(12), 10).alias("b"))
    counts = {}
    for row in r.collect():
        counts[row["b"]] = counts.get(row["b"], 0) + 1
    assert [counts[b] for b in range(1, 11)] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 2]


def test_fractional_capture_uses_expectation(spark):
    d = spark.createDataFrame([(1, "r", 0.9, 1), (2, "r", 0.5, 1), (3, "r", 0.5, 0),
                               (4, "r", 0.1, 0)], "id int, run string, s double, y int")
    c = m.capture(d, {"m": "s"}, {"hits": F.col("y")}, [0.5], ["run"]).first()
    assert c["contacts"] == 2 and c["hits"] == pytest.approx(1.5)


def test_quantiles_match_numpy(df, data):
    v = np.array([d[4] for d in data])
    ranked = mo.by_value(df, ["v"])
    q = {r["j"]: r["value"] for r in mo.exact_quantiles(ranked, 100).collect()}
    assert len(q) == 101
    assert [q[j] for j in range(101)] == pytest.approx(list(np.quantile(v, np.arange(101) / 100)))
    edges = mo.quantile_edges(ranked).first()["edges"]
    assert edges == pytest.approx(list(np.quantile(v, np.arange(1, 10) / 10,
                                                   method="inverted_cdf")))

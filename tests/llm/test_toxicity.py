"""The chain against enumeration of all label sequences, and held-out rows of the supplied labels."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import id_bucket, table

STEP = (0.3, -0.7, -0.2, 0.9)


@pytest.mark.parametrize("e", [[0.4], [0.1, 2.0, -1.3], [-3.0, 4.0, 0.0, 0.5, -0.5], [0.0] * 6])
def test_marginals_match_enumeration(e):
    weight = {}
    for y in itertools.product((0, 1), repeat=len(e)):
        s = sum(x for x, k in zip(e, y) if k) + sum(STEP[2 * a + b] for a, b in zip(y, y[1:]))
        weight[y] = math.exp(s)
    got = toxicity.odds([math.exp(x) for x in e], STEP)
    for i, o in enumerate(got):
        one = sum(w for y, w in weight.items() if y[i])
        assert o / (1 + o) == pytest.approx(one / sum(weight.values()))


def sample(n, seed):
    rng, rows = random.Random(seed), []
    words = [f"word{k}" for k in range(80)]
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        bad = i % 3 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(["Vileness", "vilest", "nasty", "vileish"]))
        rows.append((" ".join(text), int(bad)))
    return rows


@pytest.fixture(scope="module")
def chain():
    return toxicity.fit(sample(240, 1), toxicity.Config(rounds=60))


def test_unseen_forms_and_offsets(chain):
    one = toxicity.scorer(chain)
    text = "word1 word2, Vileful word3 nasty! word4"
    score, starts, ends, probs = one(text)
    assert score >= 0.5 and [text[a:b] for a, b in zip(starts, ends)] == ["Vileful", "nasty"]
    assert all(0.5 <= p <= 1 for p in probs)


def test_held_out_rows(chain):
    one = toxicity.scorer(chain)
    rows = sample(150, 2)
    assert sum((one(t)[0] >= 0.5) == bool(y) for t, y in rows) >= 148


def test_texts_without_evidence(chain):
    one = toxicity.scorer(chain)
    assert one(None) == one("") == one(" \n!")
    assert 0 <= one(None)[0] < 0.5 and one("word1 " * 60_000)[0] < 0.5
    assert one("word1 " * 60_000 + "nasty word1 vilest")[1] == [360_000, 360_012]


def test_one_class_only_scores_zero():
    assert toxicity.scorer(toxicity.fit([("a b", 1)]))("a b")[0] < 1e-6
    assert toxicity.scorer(toxicity.fit([]))("a b")[0] < 1e-6


def test_training_rows_are_bounded_and_only_from_the_fold(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}", "c") for i in range(100)] + [(None, None, None)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    cfg = toxicity.Config(per_class=5)
    rows = toxicity.training_rows(docs, labels, id_bucket(F.col("doc_id"), 5) != 0, cfg)
    assert 0 < len(rows) <= 10
    held = {r.doc_id for r in docs.where(id_bucket(F.col("doc_id"), 5) == 0).collect()}
    assert not {int(t.split()[1]) % 50 for t, _ in rows} & held


def test_columns_and_rows_come_back(spark, chain):
    docs = spark.createDataFrame([(1, "nasty nasty", 7), (1, "nasty nasty", 7), (None, None, 8)], "doc_id long, text string, score int")
    got = docs.withColumn("t", toxicity.score_text(spark, chain)("text")).collect()
    assert sorted(r.score for r in got) == [7, 7, 8] and sorted(r.t.score >= 0.5 for r in got) == [False, True, True]


def test_supplied_labels(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    model = toxicity.train(docs, labels, id_bucket(F.col("doc_id"), 5) != 0)
    out = docs.where(id_bucket(F.col("doc_id"), 5) == 0).join(labels, "doc_id").select(
        "toxic", (toxicity.score_text(spark, model)("text")["score"] >= 0.5).cast("int").alias("p")).collect()
    assert sum(r.p == r.toxic for r in out) / len(out) >= 0.9

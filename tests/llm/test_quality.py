"""Text statistics and the learned list against plain versions."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

TEXTS = [None, "", " \n\x0b\n", "a b c a b c", "a b c d a b c x b c d", "x " * 80, "w # *$% &|<> é", "l1\nl1\n \n \nl1 \nl1", "A bC 12\x0c34 -- é ö",
         " ".join(f"t{i}" for i in range(120)), "one two", "a a a a"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] >= 2 for k in range(3)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert quality.statistics(text)[:5] == brute(text)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(quality.FEATURES)))
    a, b = quality.FEATURES.index("symbol_share"), quality.FEATURES.index("repeat_share")
    poor = ((x[:, a] > 0.7) | ((x[:, b] > 0.5) & (x[:, a] > 0.5))).astype(int)
    return x, poor


def test_rules_are_found_again():
    rules = quality.learn(*sample(1500, 1))
    x, poor = sample(800, 2)
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= quality.covers(x, r.conditions)
    assert rules and (got == poor).mean() >= 0.97 and len(quality.describe(rules)) == len(rules)


@pytest.mark.parametrize("poor", [0, 1])
def test_one_class_learns_nothing(poor):
    assert quality.learn(np.random.default_rng(0).random((50, len(quality.FEATURES))), np.full(50, poor)) == []
    assert quality.learn(np.zeros((0, len(quality.FEATURES))), np.zeros(0, int)) == []


def test_verdict_follows_the_list(spark):
    rules = [quality.Rule((("symbol_share", ">", 0.2),), 1, 9), quality.Rule((("n_words", "<=", 3.0), ("chars_per_word", "<=", 2.0)), 1, 9)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = docs.select("doc_id", quality.statistics_udf()("text").alias("stats"))
    got = {r.doc_id: (r.v, r.b) for r in rows.select("doc_id", quality.verdict(F.col("stats"), rules).alias("v"),
                                                     quality.base_failed(F.col("stats")).alias("b")).collect()}
    for i, t in enumerate(TEXTS):
        n, chars, symbols, _, rep = brute(t)
        want = 0 if chars and symbols / chars > 0.2 else 1 if n <= 3 and (chars / n if n else 0) <= 2 else -1
        assert got[i] == (want, n < 50 or 100 * rep > 50 * n)
    assert quality.verdict(F.col("stats"), []) is not None


def test_labels_with_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(i, f"some text number {i}") for i in range(8)] + [(None, None)], "doc_id long, text string").select(
        "doc_id", quality.statistics_udf()("text").alias("stats"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 0), (99, 0)], "doc_id long, quality int")
    x, poor = quality.training_rows(rows, labels)
    assert len(x) == len(poor) <= 2

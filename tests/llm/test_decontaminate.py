"""Benchmark matches against a comparison of every window with every item."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import decontaminate as D

random.seed(5)
VOCAB = [f"v{k}" for k in range(500)]


def words(n):
    return random.choices(VOCAB, k=n)


ITEMS = [(i, " ".join(words(n))) for i, n in enumerate([3, 4, 5, 9, 20, 20, 38, 60])] + [(8, ""), (9, None), (10, "V1 v1 V1 v1 v1 v1 v1")]


def texts():
    out = [None, "", "v1 v2", " ".join(words(300)), "v1 " * 40]
    for _, text in ITEMS:
        if text:
            w = text.split()
            out.append(" ".join(words(50) + w + words(50) + w + words(3)))
            for edits in (1, 2, 4):
                changed = list(w)
                for k in random.sample(range(len(w)), min(edits, len(w))):
                    changed[k] = "other"
                out.append(" ".join(words(7) + changed).upper())
    return out


def brute(text, item):
    """Best similarity of any item-sized window."""
    a, b = D.words_of(text), D.words_of(item)
    if not b or len(a) < len(b):
        return 0.0
    k = min(5, len(b))
    grams = lambda w: Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    best, want = 0.0, grams(b)
    for i in range(len(a) - len(b) + 1):
        have = grams(a[i:i + len(b)])
        best = max(best, sum((have & want).values()) / sum((have | want).values()))
    return best


def test_matches_equal_brute_force():
    find = D.finder(D.build([(i, t) for i, t in ITEMS if t is not None]))
    for text in texts():
        items, starts, sizes, scores = find(text)
        want = {i: s for i, t in ITEMS if (s := brute(text, t)) >= 0.8}
        got = {}
        for i, s in zip(items, scores):
            got[i] = max(s, got.get(i, 0))
        assert got == pytest.approx(want)


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, 16).astype(np.uint8)
    for _ in range(200):
        flip = rng.choice(128, D.RADIUS, replace=False)
        bits = np.unpackbits(p)
        bits[flip] ^= 1
        assert (D._nibbles(np.packbits(bits)) == D._nibbles(p)).any()


def test_rows_in_blocks(spark):
    docs = spark.createDataFrame([(k // 2, t, "x") for k, t in enumerate(texts())] + [(None, ITEMS[4][1], "y")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda r: str((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)))
    one = sorted(map(key, D.matches(docs, items).collect()))
    many = sorted(map(key, D.matches(docs, items, D.Config(block_words=40)).collect()))
    assert one and one == many and any(x.startswith("(None, 4, 0, 20, 1.0") for x in one)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert D.matches(docs, none).count() == 0
    assert D.matches(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0

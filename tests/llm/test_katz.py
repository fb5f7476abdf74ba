"""Katz scores against the same model written out in dictionaries, and the sums of its distributions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import katz

random.seed(3)
VOCAB = [f"w{i}" for i in range(30)]
TEXTS = [" ".join(random.choices(VOCAB, weights=range(30, 0, -1), k=random.randint(0, 40))) for _ in range(60)] + [
    "W1 w2\tw3", "", None, "rareone raretwo w1", "é É w1", "w0 " * 300]
OTHER = ["w1 w2 w3 never", None, "", "never seen words here", "w29 w28 w0 w0", "w0 " * 50]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def brute(train, text, share):
    uni = Counter(t for x in train for t in tokens(x))
    total, distinct = sum(uni.values()), len(uni)
    known = {t for t, n in uni.items() if n >= max(1.0, share * total)}
    cls = lambda t: t if t in known else "<rare>"
    bi = defaultdict(Counter)
    for x in train:
        ts = [cls(t) for t in tokens(x)]
        for h, t in zip(["<start>", *ts], ts):
            bi[h][t] += 1
    d1 = katz.discounts(Counter(min(uni[t], 7) for t in known))
    d2 = katz.discounts(Counter(min(n, 7) for c in bi.values() for n in c.values()))
    p1 = {t: d1[min(uni[t], 6)] * uni[t] / (total + 1) for t in known}
    p1["<rare>"] = 1 - sum(p1.values())
    rare = [n for t, n in uni.items() if t not in known]
    size, ones = sum(rare), rare.count(1)

    def p(h, t):
        seen, c = bi.get(h, {}), sum(bi.get(h, {}).values())
        star = {x: d2[min(n, 6)] * n / (c + 1) for x, n in seen.items()}
        if t in star:
            return star[t] / (sum(star.values()) if len(star) == len(p1) else 1)
        if not seen:
            return p1[t]
        return (1 - sum(star.values())) / (1 - sum(p1[x] for x in star)) * p1[t]

    ts = tokens(text)
    base = sum(math.log10((uni[t] + .1) / (total + .1 * (distinct + 1))) for t in ts)
    score = 0.0
    for h, t in zip(["<start>", *map(cls, ts)], ts):
        score += math.log10(p(h, cls(t)))
        if t not in known:
            score += math.log10((uni[t] or ones + 1) / (size + ones + 1))
    for h in [*bi, "<none>"]:
        assert sum(p(h, t) for t in p1) == pytest.approx(1)
    return len(ts), sum(t in uni for t in ts), total, base, score


@pytest.mark.parametrize("share", [1e-6, 0.004, 0.05])
def test_scores_match_brute_force(spark, share):
    cfg = katz.Config(share=share, bucket_tokens=200, flush_tokens=150)
    train = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = [(i, False, t) for i, t in enumerate(TEXTS + OTHER)] + [(None, False, "w1 w2"), (0, False, TEXTS[0])]
    model = katz.train(train, cfg)
    got = katz.score(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), model, cfg).collect()
    assert len(got) == len(rows)
    want = {}
    for r in got:
        text = "w1 w2" if r.doc_id is None else (TEXTS + OTHER)[r.doc_id]
        if text not in want:
            want[text] = brute(TEXTS, text, share)
        n, known, total, base, score = want[text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_nothing_learned(spark):
    model = katz.train(spark.createDataFrame([], "text string"))
    docs = spark.createDataFrame([(1, True, "a b"), (2, False, None)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in katz.score(docs, model).collect()}
    assert got == {1: (3, 0, 0.0, 0.0), 2: (1, 0, 0.0, 0.0)}


def test_empty_table(spark):
    model = katz.train(spark.createDataFrame([("a b",)], "text string"))
    assert katz.score(spark.createDataFrame([], "doc_id long, held_out boolean, text string"), model).count() == 0


def test_discounts_lie_between_zero_and_one():
    for counts in ({}, {1: 5}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 1, 6: 50}, {2: 3}):
        d = katz.discounts(counts)
        assert d[6] == 1 and np.all((d[1:6] > 0) & (d[1:6] < 1))


def same_as_brute(spark, train, texts, cfg):
    model = katz.train(spark.createDataFrame([(t,) for t in train], "text string"), cfg)
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in katz.score(docs, model, cfg).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, known, total, base, score = brute(train, t, 0)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)
    return model


def test_rare_words_keep_their_bigrams_past_a_million_tokens(spark):
    train = [*TEXTS, *["w0 " * 300_000] * 4]
    same_as_brute(spark, train, TEXTS[-6:-1] + OTHER[:5] + ["rareone raretwo", "raretwo rareone never w1"], katz.Config())


@pytest.mark.parametrize("top", [0.004, 0.05, 1.0])
def test_every_word_has_bigrams_wherever_it_is_answered(spark, top):
    cfg = katz.Config(top=top, bucket_tokens=200, flush_tokens=150)
    model = same_as_brute(spark, TEXTS, TEXTS + OTHER, cfg)
    assert model.bigrams.where("rare").count() > 0


@pytest.mark.parametrize("kind", [np.uint32, np.int64, float])
def test_packed_numbers_come_back(kind):
    for x in ([], [7], [0, 1, 2, 300, 70_000, 2**31]):
        x = np.array(x, kind)
        assert np.array_equal(katz.unpack(katz.pack(x), kind), x)
        assert kind is float or np.array_equal(katz.unpack_rising(katz.pack_rising(x), kind), x)


def test_bigrams_are_stored_and_moved_in_packed_rows(spark):
    train = [" ".join(f"x{random.randrange(3000)}" for _ in range(400)) for _ in range(50)]
    model = katz.train(spark.createDataFrame([(t,) for t in train], "text string"), katz.Config(top=0.0003))
    pairs = Counter(p for t in train for p in zip(["<start>", *tokens(t)], tokens(t)))
    rows = model.bigrams.collect()
    rare = [r for r in rows if r.rare]
    assert 0 < len(rare) <= model.buckets ** 2 and 0 < len(rows) - len(rare) <= model.buckets
    assert sorted(n for r in rows for n in katz.unpack(r.n, np.int64).tolist()) == sorted(pairs.values())

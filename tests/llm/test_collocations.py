"""Collocations against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    out = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3, 4):
                out.update(("und" if lang is None else lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return out


def plain(rows, cfg):
    f = counts(rows)
    found = {x: a for x, a in f.items() if a >= cfg.least and len(x[1]) > 1}
    out = []
    for (lang, words), a in found.items():
        cuts = [((cfg.scale * a) // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(other == lang and len(long) > len(words) and 100 * b >= cfg.inside * a
                     and any(long[i:i + len(words)] == words for i in range(len(long) - len(words) + 1))
                     for (other, long), b in found.items())
        if not inside:
            n = sum(v for (x, w), v in f.items() if x == lang and len(w) == 1)
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n, score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:cfg.top])]
    return sorted(ranked)


def run(spark, rows, cfg):
    docs = spark.createDataFrame([(t, x, "clash", 1) for t, x in rows], "text string, lang string, phrase string, shard int")
    return sorted(tuple(r) for r in co.collocations(docs, cfg).collect())


def corpus(seed, n=120, words=9):
    """Small vocabulary, so phrases of all lengths pass the threshold at different scans."""
    rng = random.Random(seed)
    vocab = ["The", "cat", "ÉTÉ", "été", "x-1", "a", "b", "of", " ", "('q'"][:words]
    return [("".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  ", ".", ":"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "fr", None])) for _ in range(n)]


ODD = [(None, "en"), ("", "en"), (" \t ", None), ("...", "fr"), ("one", ""), ("the same row", "en"), ("the same row", "en")]


@pytest.mark.parametrize("seed,cfg", [
    (1, co.Config()), (2, co.Config(least=5, shards=3, top=7)), (3, co.Config(least=2, bits=8, shards=2)),
    (4, co.Config(least=3, flush=50, vocabulary=5, group=20, top=5)), (5, co.Config(least=4, shards=1, longest=4, inside=50))])
def test_against_plain_counts(spark, seed, cfg):
    rows = corpus(seed) + ODD
    assert run(spark, rows, cfg) == plain(rows, cfg)


def test_phrases_that_pass_late_are_counted_in_whole_cycles(spark):
    """Words rare in the first shard: their phrases become active late and still get all their counts."""
    rows = [("p q r s t", "en")] * 33 + [("p q", "en"), ("r s t u", "en"), ("q r s", "en")] * 40
    cfg = co.Config(least=30, shards=4)
    docs = spark.createDataFrame(rows, "text string, lang string")
    tables, reached = co.count_phrases(docs, cfg)
    assert len(tables) > cfg.shards
    got = {(r.lang, tuple(r.phrase.split(" "))): r.a for r in co.frequent_phrases(tables, reached, cfg).collect()}
    assert got == {x: a for x, a in counts(rows).items() if a >= 30}
    assert run(spark, rows, cfg) == plain(rows, cfg)


def test_long_text_in_parts(spark):
    rows = [(" ".join(random.Random(7).choice("abcd") for _ in range(5000)), "en")]
    cfg = co.Config(least=10, flush=64)
    assert run(spark, rows, cfg) == plain(rows, cfg)


def test_one_phrase_everywhere_is_a_row_per_flush(spark):
    docs = spark.createDataFrame([("hot phrase here", "en")] * 400, "text string, lang string")
    tables, _ = co.count_phrases(docs, co.Config())  # in whatever scans it is counted, each row counts once
    assert sum(t.where("phrase = 'hot phrase'").agg({"n": "sum"}).first()[0] or 0 for t in tables) == 400
    assert max(t.where("phrase = 'hot phrase'").count() for t in tables) <= docs.rdd.getNumPartitions()


def test_empty_table_and_no_words(spark):
    assert run(spark, [], co.Config()) == []
    assert run(spark, ODD[:4], co.Config(least=1)) == []


def test_distinct_numbers_long_keys_anew():
    ids = np.random.default_rng(3).integers(1, 4, 300)
    at = np.arange(290)
    first, n = co._distinct(ids, at, 4, 1 << 40)
    want = Counter(tuple(ids[i:i + 4]) for i in at)
    assert {tuple(ids[i:i + 4]): c for i, c in zip(first, n)} == want


def test_big_scores_are_exact(spark):
    big = 6_000_000_000_000
    frequent = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big)],
                                     "lang string, size byte, phrase string, a long")
    assert [r.score for r in co.score_phrases(frequent).collect()] == [2_000_000 * big // (2 * big + 1)]


def test_counts_are_stored_packed(spark):
    """A row per language, length and group of slots, whatever the number of phrases."""
    rng = random.Random(11)
    rows = [(" ".join(f"w{rng.randrange(60)}" for _ in range(400)), "en") for _ in range(200)]
    cfg = co.Config(least=2, shards=1, pending=500)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    tables, reached = co.count_phrases(docs, cfg)
    assert max(t.where("size >= 1").count() for t in tables.packed) <= 4 << co.GROUP
    assert sum(t.count() for t in tables) > 5000
    got = {(r.lang, tuple(r.phrase.split(" "))): r.a for r in co.frequent_phrases(tables, reached, cfg).collect()}
    assert got == {x: a for x, a in counts(rows).items() if a >= 2}


def test_packed_rows_of_a_task_are_added_up_before_they_move():
    """A row for each group, with sorted phrases and summed counts; groups keep language and length apart."""
    langs = co.pa.array(["en", "fr", "en"]).dictionary_encode()
    part = lambda n: co._packed(2, langs, co.pa.array(["b é", "b é", "a b"]), np.array([3, 3, 3]), n)
    rows = [r for b in co._combine(iter([part([1, 2, 3]), part([10, 20, 30])])) for r in b.to_pylist()]
    got = {(r["lang"], r["size"], r["slot"]): co._lines(r["keys"], r["counts"]).to_pydict() for r in rows}
    assert len(rows) == 2 and got == {("en", 2, 3): {"line": ["a b\n", "b é\n"], "n": [33, 11]}, ("fr", 2, 3): {"line": ["b é\n"], "n": [22]}}

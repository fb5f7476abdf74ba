"""Near-duplicate classes by 5-word similarity against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import similar
from tidemark.llm.simhash import words_of


def plain(rows):
    """Class of each row, by comparing every two shingle sets."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if group[i] != group[j] and (x == y or len(x & y) >= 0.8 * len(x | y)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"{rng.choice('abcdef')}{rng.randint(0, 400)}" for _ in range(rng.choice([3, 20, 120]))] for _ in range(12)]
    rows = []
    for k, words in enumerate(base * 4):
        w = list(words)
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        rows.append((k % 37 if k % 9 else None, " ".join(w)))
    return rows + [(None, None), (500, ""), (500, ""), (501, None), (502, "x y"), (502, "x y"), (None, "lone null id here now")]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_row_of_each_class_stays(spark, seed):
    rows = corpus(seed)
    group = plain(rows)
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, key string, fp int")
    out = similar.keep_first(docs)
    assert out.columns == docs.columns
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min([x for x in (i, least.get(g)) if x is not None], default=None)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((v is None, v or 0) for v in least.values())


def test_a_hot_band_is_not_paired_with_itself(spark, monkeypatch):
    """300 like sets and a few unlike ones in one band: about as many comparisons as sets."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words + [f"end{i}"])) for i in range(300)] + [(1000 + i, " ".join(words[60:] + [f"q{i}x{j}" for j in range(60)])) for i in range(2)]
    compared = []
    real = similar._plausible

    def spy(pairs, nodes):
        compared.append(pairs.count())
        return real(pairs, nodes)
    monkeypatch.setattr(similar, "_plausible", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar.classes(docs).select("doc_id", "component_id").collect()
    group = plain(rows)
    ids = [r[0] for r in rows]
    assert {r.doc_id: r.component_id for r in found} == {i: min(x for x, h in zip(ids, group) if h == g) for i, g in zip(ids, group)}
    assert compared[0] <= 40 * 302 and compared[1] <= 40 * 2 * 302  # far from 302 * 301 / 2 per band


def test_links_through_members_unlike_the_least(spark):
    """Sets of a band that the least one does not resemble are joined among themselves."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for k in range(6):
        tail = [f"t{k}{rng.random()}" for _ in range(40)]
        rows += [(10 * k + 1, " ".join(words[:80] + tail)), (10 * k + 2, " ".join(words[:80] + tail + ["more"]))]
    group = plain(rows)
    found = {r.doc_id: r.component_id for r in similar.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = [r[0] for r in rows]
    assert found == {i: min(x for x, h in zip(ids, group) if h == g) for i, g in zip(ids, group)}


def test_bands_find_pairs_at_the_threshold():
    """Of 400 pairs of sets at a similarity of just 0.8 at least 99 % meet in a band, and none falls below the sketch bound."""
    rng = np.random.default_rng(8)
    met, alike = 0, []
    for _ in range(400):
        h = rng.integers(0, 2**63, 108).astype(np.uint64)
        x, y = h[:96], np.concatenate((h[:84], h[96:]))  # 84 of 108 shared
        assert 0.77 < 84 / 108 < 0.8
        sides = []
        for s in (np.append(x, h[96:98]), np.append(y, h[84:86])):  # 88 of 108 shared
            least = (s * similar._FACTORS + similar._SHIFTS).min(axis=1)
            sides.append((least.reshape(similar.BANDS, -1), (least >> np.uint64(32)).astype(np.uint8)))
        met += bool((sides[0][0] == sides[1][0]).all(axis=1).any())
        alike.append((sides[0][1] == sides[1][1]).mean())
    assert met >= 396 and min(alike) > similar.ALIKE


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_first(docs).collect()) == [1, 3]
    assert similar.keep_first(docs.where("false")).count() == 0


def test_agreement_of_sketches(spark):
    df = spark.createDataFrame([(b"abcd", b"abxd")], "a binary, b binary")
    assert df.select(similar.agreement(F.col("a"), F.col("b"))).first()[0] == 0.75

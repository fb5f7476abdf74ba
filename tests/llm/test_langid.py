"""Language by words and backed-off n-grams, against a plain version and held-out rows."""

import math
from collections import Counter

import pytest

from tidemark.llm import langid

ROWS = [("the cat and the dog", "en"), ("the house of the cat", "en"), ("le chat et le chien", "fr"),
        ("la maison et le chat 12", "fr"), (None, "fr"), ("der hund und die katze", "de"), ("orphan words", None), ("", "en")]


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.createDataFrame(ROWS, "text string, lang string"))


def plain(text):
    """The same rule from plain counts (every seen unit is known at this size)."""
    words, grams = {}, {}
    for t, lang in ROWS:
        if t and lang:
            for w in [w for w in t.lower().split() if w.isalpha()]:
                words.setdefault(lang, Counter())[w] += 1
                for k in (1, 2, 3, 4):
                    grams.setdefault((lang, k), Counter()).update([f" {w} "[i:i + k] for i in range(len(w) + 3 - k)])
    langs = sorted(words)
    all_words = sum(sum(c.values()) for c in words.values())
    found = [w for w in text.lower().split() if w.isalpha()]
    total = []
    for lang in langs:
        s = 0.0
        for w in found:
            if any(w in c for c in words.values()):
                n = words[lang][w]
                s += math.log(n / sum(words[lang].values())) if n else math.log(1e-5 / 20)
                continue
            for k in (4, 3, 2, 1):
                parts = [f" {w} "[i:i + k] for i in range(len(w) + 3 - k)]
                if any(g in grams[x, k] for g in parts for x in langs):
                    c, size = grams[lang, k], sum(grams[lang, k].values())
                    s += sum(math.log(c[g] / size) if c[g] else math.log(2e-5 / 20) for g in parts) / len(parts)
                    break
        total.append(s * min(1, 30 / len(found)) + math.log(sum(words[lang].values()) / all_words))
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


@pytest.mark.parametrize("text", ["the cat", "chien maison", "katzen hunde", "thx catz", "zzz the", "le " * 500, "of katze"])
def test_matches_the_plain_rule(model, text):
    lang, score = langid.scorer(model)(text)
    want = plain(text)
    assert lang == want[0] and score == pytest.approx(want[1])


@pytest.mark.parametrize("text", [None, "", "123 _ !", "² ½"])
def test_no_letter_is_undetermined(model, text):
    assert langid.scorer(model)(text) == ("und", 0.0)


def test_nothing_learned(spark):
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert langid.scorer(empty)("some text") == ("und", 0.0)


def test_columns_beside_text_do_not_matter(spark, model):
    docs = spark.createDataFrame([("the cat", "x", 1.0), (None, "y", 2.0)], "text string, lang_pred string, score double")
    got = docs.select("lang_pred", langid.predict(spark, model)("text").alias("p")).collect()
    assert [(r.lang_pred, r.p.lang_pred) for r in got] == [("x", "en"), ("y", "und")]

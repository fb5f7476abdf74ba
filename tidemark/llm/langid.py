"""Language of documents by words first, and by shorter and shorter character n-grams for the rest.

Method. A known word adds, for each language, the log of its frequency there. An unseen word falls
back to the longest order (4 to 1) of which one of its character n-grams is known, and adds the mean
log frequency of all its n-grams of that order. Words are runs of letters in lower case, n-grams are
taken with one space at each end. The language with the largest sum (plus the log of its share of the
training words) is predicted; the score is its posterior probability with the evidence of more than
`Config.weight` words scaled down to that many, so that long texts do not all score 1.

Counts cover every training row. A word is known if it holds at least `Config.word_share` of the
words of some language, an n-gram `Config.gram_share` of those of its order; a language so has at
most 1 / share known units, which bounds the model that is broadcast. Elsewhere a unit counts as a
twentieth of that share.

Special cases. Null text and text without a letter give `und` and score 0; so does every text when
nothing was learned. A text none of whose words leaves evidence gets the most frequent language.
Ties go to the language first in text order. Rows with null lang are not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, per_text, store

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"
FLUSH = 300_000


@dataclass(frozen=True)
class Config:
    word_share: float = 1e-5
    gram_share: float = 2e-5
    weight: int = 30


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[str, tuple[float, ...]] = field(default_factory=dict)
    floors: tuple[float, ...] = ()
    weight: int = 30


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _flushing(batches, add) -> Iterator[pd.DataFrame]:
    """Sum (lang, unit) counts of a partition, handing them on whenever many units are held."""
    held: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(lang, unit, n) for (lang, unit), n in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "unit", "n"])

    for batch in batches:
        for row in batch.itertuples(index=False):
            add(held, row)
            if len(held) >= FLUSH:
                yield out()
    yield out()


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def add(held, row):
        for word, n in Counter(words_of(row.text)).items():
            if has_letter(word):
                held[row.lang, word] += n
    return _flushing(batches, add)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def add(held, row):
        for k in ORDERS:
            for g in grams_of(row.unit, k):
                held[row.lang, g] += row.n
    return _flushing(batches, add)


def _summed(df: DataFrame, count) -> DataFrame:
    return df.mapInPandas(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, cfg: Config = Config()) -> Model:
    """docs (text, lang): the rows to learn from."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    words = store(_summed(rows, _count_words), "language-words")
    grams = _summed(words, _count_grams)
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model()
    by_word, _ = _known(words.withColumn("order", F.lit(0)), cfg.word_share, langs)
    by_gram, _ = _known(grams.withColumn("order", F.length("unit")), cfg.gram_share, langs)
    all_words = sum(totals.values())
    return Model(langs, [math.log(totals[x] / all_words) for x in langs], by_word, by_gram,
                 tuple([math.log(cfg.gram_share / 20)] * len(langs)), cfg.weight)


def _known(counts: DataFrame, share: float, langs: list[str]):
    """Units with enough share of the counts of their language and order -> log shares by language."""
    counts = store(counts, "language-units")
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), ["lang", "order"]).where(F.col("n") >= share * F.col("total"))
    at, floor = {x: i for i, x in enumerate(langs)}, math.log(share / 20)
    out: dict[str, list[float]] = defaultdict(lambda: [floor] * len(langs))
    for r in kept.select("lang", "unit", (F.col("n") / F.col("total")).alias("p")).toLocalIterator():
        out[r.unit][at[r.lang]] = math.log(r.p)
    return {u: tuple(v) for u, v in out.items()}, totals


def vector(model: Model):
    """word -> evidence for each language."""
    none = (0.0,) * len(model.langs)

    def one(word: str) -> tuple[float, ...]:
        found = model.words.get(word)
        if found:
            return found
        for k in ORDERS:
            parts = grams_of(word, k)
            if any(g in model.grams for g in parts):
                rows = [model.grams.get(g, model.floors) for g in parts]
                return tuple(sum(x) / len(rows) for x in zip(*rows))
        return none
    return one


def scorer(model: Model):
    """text -> (language, posterior)."""
    of, limit, part = vector(model), 300_000, 100_000
    held, used = np.zeros((limit, max(1, len(model.langs)))), 0

    def put(word: str) -> int:
        nonlocal used
        held[used] = of(word)
        used += 1
        return used - 1

    rows, prior = Memo(put, limit + 1), np.array(model.prior)

    def one(text):
        nonlocal used
        words = words_of(text)
        if words and not any(map(str.isalpha, words)):
            words = [w for w in words if has_letter(w)]
        if not words or not model.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(model.langs))
        for lo in range(0, len(words), part):
            some = words[lo:lo + part]
            if used + len(some) > limit:
                rows.clear()
                used = 0
            total += held[list(map(rows.__getitem__, some))].sum(0)
        total = total * min(1.0, model.weight / len(words)) + prior
        p = np.exp(total - total.max())
        k = int(total.argmax())
        return model.langs[k], float(p[k] / p.sum())
    return one


def predict(spark, model: Model):
    """Column function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)
    return per_text(lambda: scorer(shared.value), SCHEMA)

"""Quality rules: text statistics and a learned, ordered list of threshold rules.

Method (sequential covering). Labelled rows are split into a growing part (two thirds, by hash of
their statistics) and a pruning part. A rule for poor text grows by the condition with the largest
information gain until it covers no good row of the growing part or no condition helps, and is then
pruned from its end while precision on the pruning part does not fall. It is kept if its precision there is
at least `Config.precision` and it covers at least `Config.support` poor rows; the rows it covers are
taken out, and the next rule grows. Thresholds come from the quantiles of each statistic. The list is
emitted as one Spark conditional expression, first match wins, and texts that meet no rule are kept.

Statistics are computed once for every row over its whole text and stored; learning uses at most
`Config.sample` labelled rows of each class, drawn by the hash of their id.

Special cases. Null text has no words; a statistic that is a share of nothing is 0. Repeated rows each
come back. Null labels are not learned from; of repeated labels of one document the smaller counts.
Without good or poor labelled rows the list is empty, and only the base rule decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_text

SPACE = re.compile(r"[\x20\x09-\x0d]+")
SYMBOLS = re.compile(r"[^#*$%&|<>]+")
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_upper long, n_digits long, n_letters long, n_stops long, n_distinct long")
#: Shares that rules may test, each a count over another.
SHARES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "letter_share": ("n_letters", "word_chars"),
    "stop_share": ("n_stops", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *SHARES)


@dataclass(frozen=True)
class Config:
    sample: int = 20_000
    cuts: int = 64
    conditions: int = 3
    rules: int = 12
    precision: float = 0.9
    support: int = 5


def words_of(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w]


def repeated(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line and not SPACE.fullmatch(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    distinct = Counter(words)
    upper = digits = letters = stops = chars = 0
    for w, n in distinct.items():
        chars += n * len(w)
        if w.isalpha():
            letters += n * len(w)
            if not w.islower():
                upper += n * sum(map(str.isupper, w))
            if len(w) <= 3:
                stops += n
        else:
            letters += n * sum(map(str.isalpha, w))
            digits += n * sum(map(str.isdigit, w))
            upper += n * sum(map(str.isupper, w))
    return (len(words), chars, len(SYMBOLS.sub("", text)), dup, repeated(words), lines, upper, digits, letters,
            stops, len(distinct))


statistics_udf = lambda: per_text(lambda: statistics, SCHEMA)


def feature(stats: Column, name: str) -> Column:
    if name not in SHARES:
        return stats[name].cast("double")
    a, b = SHARES[name]
    return F.when(stats[b] > 0, stats[a] / stats[b]).otherwise(F.lit(0.0))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the text is poor. precision and support are those of the pruning part."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int


def covers(x: np.ndarray, conditions) -> np.ndarray:
    on = np.ones(len(x), bool)
    for name, op, cut in conditions:
        v = x[:, FEATURES.index(name)]
        on &= v > cut if op == ">" else v <= cut
    return on


def _best(x: np.ndarray, y: np.ndarray, cfg: Config) -> tuple[float, Condition] | None:
    """The condition of largest gain over the rows in hand (FOIL's information gain)."""
    p, n = y.sum(), (1 - y).sum()
    now, found = np.log2(p / (p + n)), None
    for k, name in enumerate(FEATURES):
        v = x[:, k]
        for cut in np.unique(np.quantile(v, np.linspace(0, 1, cfg.cuts + 1)[:-1])):
            for op, on in ((">", v > cut), ("<=", v <= cut)):
                a = y[on].sum()
                if a and on.sum() < len(on):
                    gain = a * (np.log2(a / on.sum()) - now)
                    if found is None or gain > found[0] + 1e-9:
                        found = gain, (name, op, float(cut))
    return found if found and found[0] > 1e-9 else None


def learn(x: np.ndarray, poor: np.ndarray, cfg: Config = Config()) -> list[Rule]:
    """x: rows by FEATURES; poor: 1 for poor text."""
    turn = np.arange(len(x)) % 3 == 2
    grow, gy, prune, py = x[~turn], poor[~turn], x[turn], poor[turn]
    rules: list[Rule] = []
    while len(rules) < cfg.rules and gy.sum() >= cfg.support and (1 - gy).sum() > 0:
        conditions: list[Condition] = []
        on = np.ones(len(grow), bool)
        while len(conditions) < cfg.conditions and (1 - gy[on]).sum():
            best = _best(grow[on], gy[on], cfg)
            if best is None:
                break
            conditions.append(best[1])
            on = covers(grow, conditions)
        if not conditions:
            break

        def held(c):
            hit = covers(prune, c)
            return (py[hit].sum() + 1) / (hit.sum() + 2), int(py[hit].sum())

        while len(conditions) > 1 and held(conditions[:-1])[0] >= held(conditions)[0]:
            conditions.pop()
        on = covers(grow, conditions)
        precision, support = held(conditions)
        if precision < cfg.precision or support < min(cfg.support, max(1, len(prune) // 20)):
            break
        rules.append(Rule(tuple(conditions), round(precision, 4), support))
        off = ~covers(prune, conditions)
        grow, gy, prune, py = grow[~on], gy[~on], prune[off], py[off]
    return rules


def training_rows(rows: DataFrame, labels: DataFrame, cfg: Config = Config()) -> tuple[np.ndarray, np.ndarray]:
    """rows (doc_id, stats struct) joined with a bounded sample of the labels."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    order = F.xxhash64("doc_id")
    ids = known.where("quality = 0").orderBy(order).limit(cfg.sample).unionByName(
        known.where("quality = 1").orderBy(order).limit(cfg.sample))
    got = (rows.select("doc_id", *(feature(F.col("stats"), f).alias(f) for f in FEATURES))
           .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id"))
    # Equal statistics are one example: copies of a text must not stand in both parts.
    got = got.drop(columns="doc_id").groupby(list(FEATURES), as_index=False, sort=True)["quality"].min()
    mixed = got.sample(frac=1.0, random_state=1)
    return mixed[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), 1 - mixed["quality"].to_numpy(int)


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """The ordered list as a conditional expression: the number of the rule that a text meets, else -1."""
    out = None
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for name, op, cut in rule.conditions:
            v = feature(stats, name)
            test = test & (v > cut if op == ">" else v <= cut)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{n} {op} {c:.4g}" for n, op, c in r.conditions) + f" ({r.precision}, {r.support})" for r in rules]

"""Toxic spans and document scores from a linear-chain conditional random field.

Method. The only labels are per document, so token labels are derived first: a greedy cover picks
the words and word beginnings that explain the toxic documents of the training sample and do not
occur in its clean ones; tokens that carry one of them are labelled toxic. A two-state chain is
trained on these tokens with word, affix, shape and neighbour features. Forward-backward marginals
give each token of a text its probability; runs of tokens at 0.5 or more are the offending spans,
and a logistic map of the marginals (largest logit, expected number of toxic tokens) is the score.

Bounds. The fit uses at most `Config.per_class` labelled documents of each class, none longer than
`Config.max_chars` characters. Everything else runs over whole texts of all rows. The model that is
broadcast is bounded by that sample.

Special cases. Null and empty texts have no tokens and get the score of a text without evidence.
Labels that are null, or whose document is missing, are not learned from; of repeated labels of one
document the larger counts. With no toxic or no clean training row every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, per_text

WORD = re.compile(r"\w+")
SCHEMA = "score double, starts array<int>, ends array<int>, probs array<double>"


@dataclass(frozen=True)
class Config:
    """Training bounds and settings of the chain."""

    per_class: int = 1500
    max_chars: int = 20_000
    min_cover: int = 3
    min_precision: float = 0.95
    margin: int = 12
    rounds: int = 80
    l2: float = 1e-4
    rate: float = 0.3


@dataclass
class Chain:
    """Weights of the two-state chain; scores are log-odds of state 1 against state 0."""

    weights: dict[str, float] = field(default_factory=dict)
    step: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # 00, 01, 10, 11
    map: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def _own(word: str) -> list[str]:
    low = word.lower()
    shape = "d" if any(c.isdigit() for c in word) else "u" if word.isupper() and len(word) > 1 else "c"
    return ["b", "s=" + shape, "w=" + low, *(f"p{k}=" + low[:k] for k in (3, 4, 5, 6) if len(low) >= k),
            "e3=" + low[-3:]]


def _before(word: str) -> str:
    return "l=" + word.lower()


def _after(word: str) -> str:
    return "r=" + word.lower()


def _units(words: set[str]) -> set[str]:
    low = {w.lower() for w in words}
    return low | {w[:k] + "*" for w in low for k in (4, 5, 6) if len(w) > k}


def cover(toxic: list[set[str]], clean: list[set[str]], cfg: Config) -> set[str]:
    """toxic, clean: the words of each document. Words, and beginnings written with a closing *, that explain the toxic documents.

    Each step takes the unit with the most unexplained toxic documents among those precise enough;
    ties go to the longer unit, then to the text order. Repeated copies of one toxic text explain
    each other at once, so their ordinary words are not taken.
    """
    # Units are made anew in each pass and only those still in question are counted.
    often = {u for u, n in Counter(u for d in toxic for u in _units(d)).items() if n >= cfg.min_cover}
    seen_clean = Counter(u for d in clean for u in _units(d) if u in often)
    places = defaultdict(list)
    for i, d in enumerate(toxic):
        for u in _units(d) & often:
            places[u].append(i)
    scale = len(clean) / max(1, len(toxic))
    places = {u: p for u, p in places.items()
              if len(p) * scale >= cfg.min_precision * (len(p) * scale + seen_clean[u])}
    open_docs, chosen = set(range(len(toxic))), set()
    heap = [(-len(p), -len(u), u) for u, p in places.items()]
    heapify(heap)
    while heap:
        # Gains only shrink, so a unit whose gain still stands at the top is the best one.
        gain, size, unit = heappop(heap)
        now = sum(i in open_docs for i in places[unit])
        if now == -gain:
            chosen.add(unit)
            open_docs.difference_update(places[unit])
        elif now >= cfg.min_cover:
            heappush(heap, (-now, size, unit))
    return chosen


def _marked(word: str, units: set[str]) -> bool:
    low = word.lower()
    return low in units or any(low[:k] + "*" in units for k in (4, 5, 6))


def odds(e: list[float], step: tuple[float, float, float, float]) -> list[float]:
    """Posterior odds of state 1 at each place, from local odds e, by forward and backward passes."""
    a, b, c, d = (float(np.exp(x)) for x in step)
    fwd, r = [], 0.0
    for i, x in enumerate(e):
        r = x if i == 0 else x * (b + r * d) / (a + r * c)
        fwd.append(r)
    back = 1.0
    for i in range(len(e) - 1, -1, -1):
        here = fwd[i]
        fwd[i] = here * back
        x = e[i] * back
        back = (c + d * x) / (a + b * x)
    return fwd


def fit_chain(segments: list[tuple[list[str], list[int]]], cfg: Config) -> Chain:
    """Maximum conditional likelihood with an L2 penalty, by sign-adaptive full-batch steps."""
    counts = Counter(f for words, _ in segments for i, w in enumerate(words) for f in _at(words, i))
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= 2))}
    pad, width, long = len(index), 12, max(len(w) for w, _ in segments)
    feats = np.full((len(segments), long, width), pad, np.int64)
    y = np.zeros((len(segments), long), np.int64)
    on = np.zeros((len(segments), long), bool)
    for s, (words, labels) in enumerate(segments):
        for i in range(len(words)):
            ids = [index[f] for f in _at(words, i) if f in index][:width]
            feats[s, i, :len(ids)] = ids
        y[s, :len(words)], on[s, :len(words)] = labels, True
    pair = on[:, 1:] & on[:, :-1]
    seen = np.bincount((y[:, :-1] * 2 + y[:, 1:])[pair], minlength=4).astype(float)
    theta, step = np.zeros(pad + 1), np.zeros(4)
    size, last = np.full(pad + 5, cfg.rate), np.zeros(pad + 5)
    total = float(on.sum())
    for _ in range(cfg.rounds):
        e = theta[feats].sum(2)
        alpha, beta = np.zeros((long, len(segments), 2)), np.zeros((long, len(segments), 2))
        t = step.reshape(2, 2)
        local = np.stack([np.zeros_like(e), e], 2)
        alpha[0] = local[:, 0]
        for i in range(1, long):
            nxt = np.logaddexp.reduce(alpha[i - 1][:, :, None] + t[None], axis=1) + local[:, i]
            alpha[i] = np.where(on[:, i, None], nxt, alpha[i - 1])
        for i in range(long - 2, -1, -1):
            prev = np.logaddexp.reduce(t[None] + (local[:, i + 1] + beta[i + 1])[:, None, :], axis=2)
            beta[i] = np.where(on[:, i + 1, None], prev, 0.0)
        z = np.logaddexp.reduce(alpha[-1], axis=1)
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z).T
        grad = np.bincount(feats.ravel(), np.repeat(((y - p1) * on).ravel(), width), minlength=pad + 1)
        grad[pad] = 0
        edge = np.zeros(4)
        for i in range(1, long):
            q = np.exp(alpha[i - 1][:, :, None] + t[None] + (local[:, i] + beta[i])[:, None, :] - z[:, None, None])
            edge += (q * on[:, i, None, None]).sum(0).ravel()
        g = np.concatenate([grad - cfg.l2 * total * theta, seen - edge - cfg.l2 * total * step])
        same = np.sign(g) * np.sign(last)
        size = np.clip(np.where(same > 0, size * 1.2, np.where(same < 0, size * 0.5, size)), 1e-6, 1.0)
        move = np.sign(g) * size
        theta += move[:pad + 1]
        theta[pad] = 0
        step += move[pad + 1:]
        last = g
    return Chain({f: float(theta[k]) for f, k in index.items() if theta[k]}, tuple(map(float, step)))


def _at(words: list[str], i: int) -> list[str]:
    out = _own(words[i])
    if i:
        out.append(_before(words[i - 1]))
    if i + 1 < len(words):
        out.append(_after(words[i + 1]))
    return out


def fit(rows: list[tuple[str, int]], cfg: Config = Config()) -> Chain:
    """rows: (text, label) of the bounded training sample."""
    docs = [(WORD.findall(t or ""), y) for t, y in dict.fromkeys(rows)]
    toxic, clean = [set(w) for w, y in docs if y == 1], [set(w) for w, y in docs if y == 0]
    if not toxic or not clean:
        return Chain()
    units = cover(toxic, clean, cfg)
    segments = []
    for k, (words, y) in enumerate(docs):
        marks = [int(y == 1 and _marked(w, units)) for w in words]
        at = next((i for i, m in enumerate(marks) if m), (k * 7919) % max(1, len(words)))
        lo = max(0, at - cfg.margin)
        if words:
            segments.append((words[lo:at + 3 * cfg.margin], marks[lo:at + 3 * cfg.margin]))
    if not segments:
        return Chain()
    chain = fit_chain(segments, cfg)
    of = _evidence(chain)
    x = np.array([of(w)[1:] for w, _ in docs])
    chain.map = _logistic(x, np.array([y for _, y in docs], float))
    return chain


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps for a logistic map with a small ridge and balanced classes."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
        b = b + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(map(float, b))


WORDS = 300_000  # words a scorer remembers


def _evidence(chain: Chain, limit: int = WORDS):
    """words -> (odds per word, largest logit, log of 1 + expected toxic words)."""
    weights, rows = chain.weights, []

    def place(word: str) -> int:
        rows.append((sum(weights.get(f, 0.0) for f in _own(word)), weights.get(_before(word), 0.0),
                     weights.get(_after(word), 0.0)))
        return len(rows) - 1

    ids = Memo(place, limit)

    def of(words: list[str]):
        if not words:
            return [], -20.0, 0.0
        if len(ids) + len(words) > ids.limit:
            ids.clear()
            rows.clear()
            ids.limit = max(limit, 2 * len(words))
        at = list(map(ids.__getitem__, words))
        m = np.array([rows[k] for k in at]) if len(rows) > 8 * len(at) else np.array(rows)[at]
        e = m[:, 0].copy()
        e[1:] += m[:-1, 1]
        e[:-1] += m[1:, 2]
        post = odds(np.exp(np.clip(e, -30, 30)).tolist(), chain.step)
        o = np.asarray(post)
        return post, float(np.clip(np.log(max(o.max(), 1e-9)), -20, 20)), float(np.log1p((o / (1 + o)).sum()))
    return of


def scorer(chain: Chain, limit: int = WORDS):
    """text -> (score, span starts, span ends, mean probability of each span), in code points."""
    of = _evidence(chain, limit)

    def one(text):
        words = WORD.findall(text) if text else []
        post, top, many = of(words)
        b0, b1, b2 = chain.map
        score = float(1 / (1 + np.exp(-np.clip(b0 + b1 * top + b2 * many, -35, 35))))
        starts, ends, probs = [], [], []
        if top >= 0:
            run: list[float] = []
            for m, o in zip(WORD.finditer(text), post):
                if o >= 1:
                    if not run:
                        starts.append(m.start())
                        ends.append(0)
                    run.append(o / (1 + o))
                    ends[-1] = m.end()
                elif run:
                    probs.append(sum(run) / len(run))
                    run = []
            if run:
                probs.append(sum(run) / len(run))
        return score, starts, ends, probs
    return one


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, cfg: Config = Config()) -> list[tuple[str, int]]:
    """A bounded sample: per class, the labelled ids with the smallest hash, and their texts.

    learn: condition on doc_id. Ids are drawn first, so only their texts are joined and moved.
    """
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order).limit(cfg.per_class).unionByName(
        known.where("toxic = 0").orderBy(order).limit(cfg.per_class))
    rows = (docs.select("doc_id", "text").where(F.length("text") <= cfg.max_chars)
            .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect())
    return [(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: r.doc_id)]


def train(docs: DataFrame, labels: DataFrame, learn: Column, cfg: Config = Config()) -> Chain:
    return fit(training_rows(docs, labels, learn, cfg), cfg)


def score_text(spark, chain: Chain):
    """Column function text -> struct(score, starts, ends, probs)."""
    shared = spark.sparkContext.broadcast(chain)
    return per_text(lambda: scorer(shared.value), SCHEMA)

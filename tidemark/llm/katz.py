"""Log-probability of texts under a Katz back-off bigram model that is counted, stored and read in Spark.

Tokens are words (runs without ASCII white space, A-Z in lower case) and one end token per text.
N-grams are counted, stored and scored over all words; a start token is the history of the first one.

  seen bigram      P(w | h) = d(c) c(h w) / (c(h) + 1)
  unseen bigram    P(w | h) = alpha(h) P(w)
  word             P(w)     = d1(c) c(w) / (N + 1); all words never seen in training share the rest

d and d1 are Good-Turing discounts for counts of 1 to 5 (a discount from the first two counts of
counts where the estimate is not between 0 and 1). alpha(h) is the mass left by the seen bigrams over
the unigram mass of the words not seen after h, so each history sums to 1 exactly.

Spark. Words that hold at least `Config.top` of the training tokens are numbered, so there are at most
1 / top of them and their tables can be broadcast; other words go by their 62-bit key. This decides
only where a key is answered, never the score. Counts of all training rows are summed per task first,
then by key: words, bigrams of numbered words, and bigrams with a rare word are tables partitioned by
bucket. The bucket of a rare bigram is that of its rare history, or else of its rare word, so the count
and alpha of a rare history come from the rows of one bucket. Bigrams are stored and moved packed: a row holds arrays. Scoring adds at once what the broadcast
tables hold (per-word figures of numbered words; the gain of a bigram that itself has `Config.top` of
the tokens); other bigrams and rare words go to their bucket, packed as arrays, meet the stored counts
there, and the sums return packed by the flush that sent them. A rare word is sent once, with its neighbours, and stands
for its own count and for all bigrams that its bucket answers. A frequent key is never shuffled, so
no bucket is hot.

A class model can be asked for: with `Config.share` above 0, words below that share of the tokens are
one class in all n-grams, with P(class) the rest, and inside it a word has c(w) / (C + n1 + 1) (C the
tokens and n1 the hapaxes of the class; words never seen share (n1 + 1) / (C + n1 + 1)).

Special cases. Null text is empty: the end token alone. Rows with a null id are scored and not
learned from. Repeated rows each come back. With nothing learned every text scores 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, store
from tidemark.llm.simhash import words_of

END = b"\n"  # no word holds white space
RARE_BIT = 1 << 62
GOOD_TURING = 5
DOCS, PAIRS, WORDS, RARES = 0, 1, 2, 3
FAR = np.uint32(2**32 - 1)  # the word after is a rare one
PAIR_FACTOR = np.int64(-7046029254386353131)


@dataclass(frozen=True)
class Config:
    share: float = 0.0  # words below it are folded into one class; 0 folds none
    top: float = 1e-6  # words and bigrams from it on are answered from broadcast tables
    bucket_tokens: int = 1_250_000
    flush_tokens: int = 1_000_000


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first bytes of all before the second ones: high bytes are mostly equal."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(raw[:8], "little"), np.dtype(kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def pack_rising(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_rising(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def word_key(word: bytes) -> int:
    """62-bit hash of a word, told apart from word numbers by the bit above."""
    return xxhash.xxh64_intdigest(word, 42) & (RARE_BIT - 1) | RARE_BIT


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """d[r] for r = 0..5, d[5 and above] = 1 at index 6."""
    n = [0.0] + [float(counts_of_counts.get(r, 0)) for r in range(1, GOOD_TURING + 2)]
    d = np.ones(GOOD_TURING + 2)
    plain = n[1] / (n[1] + 2 * n[2] + 1) if n[1] else 0.5
    tail = (GOOD_TURING + 1) * n[-1] / n[1] if n[1] else 1.0
    for r in range(1, GOOD_TURING + 1):
        ok = n[r] > 0 and tail < 1
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if ok else 0.0
        d[r] = turing if 0 < turing < 1 else 1 - plain / r
    return d


def discount(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, GOOD_TURING + 1)]


@dataclass
class Words:
    """Numbered words, sorted by key, and the figures of the training tokens."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    hapaxes: int  # folded words counted once
    fold: bool
    d1: np.ndarray
    rest: float  # P(class of the folded words), or of all words never seen

    @property
    def rare(self) -> int:
        return len(self.keys)

    @property
    def start(self) -> int:
        return len(self.keys) + 1

    @property
    def classes(self) -> int:
        return len(self.keys) + 2

    def unigram(self) -> np.ndarray:
        """P(word) for the numbered words and, last, the rest."""
        return np.append(self.word_p(self.counts), self.rest)

    def word_p(self, c: np.ndarray) -> np.ndarray:
        return discount(self.d1, c) * c / (self.tokens + 1)

    def rare_total(self) -> float:
        return self.tokens - float(self.counts.sum()) + self.hapaxes + 1

    def numbering(self) -> Memo:
        """word -> class number, or its key if it is rare."""
        place = dict(zip(self.keys.tolist(), range(len(self.keys))))

        def number(word: bytes) -> int:
            key = word_key(word)
            return place.get(key, key)
        return Memo(number, 200_000)


def _tokens(numbers: Memo, text: str | None) -> np.ndarray:
    words = words_of(text)
    words.append(END)
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _pairs(a: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Histories and words; where words are folded, a rare one stands as the number of the class."""
    c = np.where(a < RARE_BIT, a, w.rare) if w.fold else a
    return np.concatenate([[w.start], c[:-1]]), c


def _rare_key(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The word by which a bigram with a rare word finds its bucket."""
    return np.where(h >= RARE_BIT, h, c)


def _pair_key(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return h * PAIR_FACTOR + c


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()

    def out():
        frame = pd.DataFrame({"word": np.fromiter(map(word_key, held), np.int64, len(held)),
                              "n": np.fromiter(held.values(), np.int64, len(held))})
        held.clear()
        return frame

    for batch in batches:
        for text in batch["text"]:
            words = words_of(text)
            words.append(END)
            held.update(words)
            if len(held) >= 300_000:
                yield out()
    yield out()


def _summed(rows: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Partial counts (key, n) -> one table partitioned by bucket."""
    bucket = F.pmod(F.col(key), F.lit(buckets)).cast("int")
    summed = rows.select(bucket.alias("bucket"), key, "n").repartition(buckets, "bucket").groupBy("bucket", key).agg(
        F.sum("n").alias("n"))
    return store(summed, name, by="bucket")


def _unique_pairs(h: np.ndarray, c: np.ndarray, n: np.ndarray):
    order = np.lexsort((h, c))
    h, c, n = h[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[:len(h)])
    return h[first], c[first], np.add.reduceat(n, first) if len(first) else n


def _counter_of_pairs(words, buckets: int, flush: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = words.value
        numbers, held, far, size = w.numbering(), [], [], 0

        def packed(at, *columns):
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(buckets + 1))
            columns = [x[order] for x in columns]
            for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
                if hi > lo:
                    yield b, *(x[lo:hi] for x in columns)

        def out():
            keys = np.concatenate(held)
            held.clear()
            keys, n = np.unique(keys, return_counts=True)
            yield pd.DataFrame([(b, pack_rising(k), None, pack(m))
                                for b, k, m in packed(keys % buckets, keys, n.astype(np.int32))], columns=PACKED)
            del keys, n
            if far:
                h, c = np.concatenate(far, axis=1)
                far.clear()
                # On their first way rare bigrams go by a rare word before a rare history, which gives c(word).
                h, c, n = _unique_pairs(h, c, np.ones(len(h), np.int32))
                yield pd.DataFrame([(b, pack(x), pack(y), pack(m))
                                    for b, x, y, m in packed(_rare_key(c, h) % buckets, h, c, n.astype(np.int32))], columns=PACKED)

        for batch in batches:
            for text in batch["text"]:
                h, c = _pairs(_tokens(numbers, text), w)
                rare = (h >= RARE_BIT) | (c >= RARE_BIT)
                held.append(h[~rare] * w.classes + c[~rare])
                if rare.any():
                    far.append(np.array([h[rare], c[rare]]))
                size += len(c)
                if size >= flush:
                    yield from out()
                    size = 0
        if held:
            yield from out()
    return run


def _sum_pairs(classes: int, buckets: int):
    """Partial counts of a bucket -> packed rows of its summed bigrams; those of a rare history go to its bucket."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        rare = frame["words"].notna().to_numpy()
        out = []
        if not rare.all():
            some = frame[~rare]
            keys = np.concatenate([unpack_rising(b) for b in some["keys"]])
            n = np.concatenate([unpack(b, np.int32) for b in some["n"]]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            out.append((bucket, False, pack_rising(keys[first]), None, pack(np.add.reduceat(n, first)), None))
        if rare.any():
            some = frame[rare]
            h, c, n = _unique_pairs(
                np.concatenate([unpack(b, np.int64) for b in some["keys"]]), np.concatenate([unpack(b, np.int64) for b in some["words"]]),
                np.concatenate([unpack(b, np.int32) for b in some["n"]]).astype(np.int64))
            _, place = np.unique(c, return_inverse=True)
            total = np.where(c >= RARE_BIT, np.bincount(place, n)[place].astype(np.int64), 0)
            at = _rare_key(h, c) % buckets
            order = np.lexsort((c, h, at))
            at, h, c, n, total = (x[order] for x in (at, h, c, n, total))
            first = np.flatnonzero(np.diff(at, prepend=-1))
            for lo, hi in zip(first, [*first[1:], len(at)]):
                out.append((int(at[lo]), True, pack_rising(h[lo:hi]), pack(c[lo:hi]), pack(n[lo:hi]), pack(total[lo:hi])))
        return pd.DataFrame(out, columns=["bucket", "rare", "keys", "words", "n", "c"])
    return run


def _counts_of_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = np.zeros(GOOD_TURING + 3, np.int64)
    for batch in batches:
        for raw in batch["n"]:
            sums += np.bincount(np.minimum(unpack(raw, np.int64), GOOD_TURING + 2), minlength=len(sums))
    yield pd.DataFrame({"r": np.arange(len(sums)), "n": sums})


def _most_frequent(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, raw in zip(batch["keys"], batch["n"]):
                n = unpack(raw, np.int64)
                if len(n) and n.max() >= least:
                    at = n >= least
                    yield pd.DataFrame({"k": unpack_rising(keys)[at], "n": n[at]})
    return run


@dataclass
class Model:
    """Stored count tables and the bounded tables of numbered words."""

    unigrams: DataFrame  # bucket, word, n
    bigrams: DataFrame  # bucket, rare (whether one of the words is), packed keys (or histories), words, n, c (of a rare word)
    buckets: int
    words: Words
    d: np.ndarray
    history: np.ndarray  # c(h)
    alpha: np.ndarray
    scale: np.ndarray  # 1, but where every class was seen after h
    frequent: np.ndarray  # keys of frequent bigrams, rising
    frequent_n: np.ndarray


def train(docs: DataFrame, cfg: Config = Config()) -> Model:
    """docs (text): the rows to learn from."""
    spark = docs.sparkSession
    docs = docs.select("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unigrams = _summed(docs.mapInPandas(_count_words, "word long, n long"), "word", parts, "katz-unigrams")
    total = unigrams.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens = total.tokens or 0
    fold, floor = cfg.share > 0, (cfg.share or cfg.top) * tokens
    least = max(1.0, floor)
    known = unigrams.where(F.col("n") >= least).select("word", "n").toPandas().sort_values("word")
    hapaxes = unigrams.where((F.col("n") == 1) & (F.col("n") < least)).count() if fold else 0
    sums = (unigrams.where(F.col("n") >= least) if fold else unigrams).groupBy(
        F.least("n", F.lit(GOOD_TURING + 2)).alias("r")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    d1 = discounts({r.r: r.words for r in sums})
    rest = 1 - sum(float(d1[min(r.r, GOOD_TURING + 1)]) * r.n for r in sums) / (tokens + 1)
    words = Words(known["word"].to_numpy(np.int64), known["n"].to_numpy(np.int64), tokens, total.distinct, hapaxes,
                  fold, d1, rest)
    buckets = max(parts, ceil(tokens / cfg.bucket_tokens))
    shared = spark.sparkContext.broadcast(words)
    packed = docs.mapInPandas(_counter_of_pairs(shared, buckets, cfg.flush_tokens), "bucket int, keys binary, words binary, n binary")
    bigrams = store(packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        _sum_pairs(words.classes, buckets), BIGRAMS), "katz-bigrams")
    counts = {r.r: r.n for r in bigrams.select("n").mapInPandas(_counts_of_counts, "r int, n long").groupBy("r").agg(
        F.sum("n").alias("n")).where("n > 0").collect()}
    d = discounts(counts)
    history, alpha, scale = _backoff(bigrams, shared, words, d)
    top = bigrams.where(~F.col("rare")).select("keys", "n").mapInPandas(_most_frequent(least), "k long, n long").toPandas().sort_values("k") \
        if floor >= 1 else pd.DataFrame({"k": [], "n": []})
    return Model(unigrams, bigrams, buckets, words, d, history, alpha, scale,
                 top["k"].to_numpy(np.int64), top["n"].to_numpy(np.int64))


def _backoff(bigrams: DataFrame, shared, words: Words, d: np.ndarray):
    """Per numbered history: count, alpha, and scale; one row each comes to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        p1, sums = w.unigram(), np.zeros((4, w.classes))
        for batch in batches:
            for rare, keys, others, raw, totals in batch.itertuples(index=False):
                h, n = unpack_rising(keys), unpack(raw, np.int64)
                if rare:
                    here = h < RARE_BIT
                    if not here.any():
                        continue
                    h, n, p = h[here], n[here], w.word_p(unpack(totals, np.int64)[here])
                else:
                    h, p = h // w.classes, p1[h % w.classes]
                for k, x in enumerate((n, discount(d, n) * n, p, None)):
                    sums[k] += np.bincount(h, x, w.classes)
        at = np.flatnonzero(sums[3])
        yield pd.DataFrame({"history": at, **dict(zip(("c", "kept", "p", "seen"), sums[:, at]))})

    parts = bigrams.select("rare", "keys", "words", "n", "c").mapInPandas(
        run, "history long, c double, kept double, p double, seen double")
    rows = parts.groupBy("history").agg(*(F.sum(x).alias(x) for x in ("c", "kept", "p", "seen"))).toPandas()
    history, alpha, scale = np.zeros(words.classes), np.ones(words.classes), np.ones(words.classes)
    at, c = rows["history"].to_numpy(np.int64), rows["c"].to_numpy(float)
    mass = rows["kept"].to_numpy(float) / (c + 1)
    every = words.fold & (rows["seen"].to_numpy() >= words.classes - 1)
    history[at] = c
    alpha[at] = np.where(every, 1.0, (1 - mass) / np.where(every, 1.0, np.maximum(1 - rows["p"].to_numpy(float), 1e-15)))
    scale[at] = np.where(every, 1 / mass, 1.0)
    return history, alpha, scale


@dataclass
class Tables:
    """What every scoring task holds."""

    words: Words
    buckets: int
    d: np.ndarray
    history: np.ndarray
    alpha: np.ndarray
    scale: np.ndarray
    frequent: np.ndarray
    frequent_n: np.ndarray
    floor: float  # bigrams from this count on are in the table of frequent ones

    def gain(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a seen bigram adds to the back-off value of its token."""
        h, w = keys // self.words.classes, keys % self.words.classes
        p = discount(self.d, n) * n / (self.history[h] + 1) * self.scale[h]
        return np.log10(p) - np.log10(self.alpha[h]) - np.log10(self.words.unigram()[w])


PACKED = ["bucket", "keys", "words", "n"]
BIGRAMS = "bucket int, rare boolean, keys binary, words binary, n binary, c binary"
OUT = ["kind", "bucket", "grp", "base", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score",
       "keys", "docs", "before", "after", "far"]


def _neighbours(a: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of the rare words of a text: the history one more, or 0 if it is rare (its own row has this bigram); and the word
    after one more, its key if it is rare, or 0 where the text ends. No neighbours where rare words are folded."""
    here = a >= RARE_BIT
    if w.fold:
        return np.zeros(here.sum(), np.uint32), np.zeros(here.sum(), np.int64)
    before = np.concatenate([[w.start], a[:-1]])[here]
    after = np.where(a < RARE_BIT, a + 1, a)
    return np.where(before < RARE_BIT, before + 1, 0).astype(np.uint32), np.append(after[1:], 0)[here]


def _send(tables, flush: int):
    """Rows of documents, with all that the broadcast tables know, and packed requests to the buckets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tables.value
        w = t.words
        numbers = w.numbering()
        log_p, log_a = np.log10(w.unigram()), np.log10(t.alpha)
        fold = w.fold
        floor = np.log10(w.tokens + 0.1 * (w.distinct + 1))
        log_c = np.log10(w.counts + 0.1) - floor
        gains = t.gain(t.frequent, t.frequent_n) if len(t.frequent) else np.zeros(0)
        base = uid = TaskContext.get().partitionId() << 36
        held, size, docs = {PAIRS: [], WORDS: []}, 0, []

        def requests():
            rows = []
            for kind, some in held.items():
                if some:
                    columns = [np.concatenate(x) for x in list(zip(*some))[1:]]
                    at = np.repeat(np.array([x[0] for x in some], np.uint32), [len(x[1]) for x in some])
                    bucket = (columns[0] % t.buckets).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    columns, at = [x[order] for x in columns], at[order]
                    edges = np.searchsorted(bucket[order], np.arange(t.buckets + 1))
                    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        if hi == lo:
                            continue
                        keys, more = columns[0][lo:hi], (None, None, None)
                        if kind == WORDS:
                            after = columns[2][lo:hi]
                            far = after >= RARE_BIT
                            more = (pack(columns[1][lo:hi]), pack(np.where(far, FAR, after).astype(np.uint32)), pack(after[far]))
                        rows.append((kind, b, base, base, None, None, 0, 0, 0.0, 0.0,
                                     pack(keys if kind == WORDS else keys // t.buckets), pack_rising(at[lo:hi]), *more))
                some.clear()
            return pd.DataFrame(rows, columns=OUT)

        for batch in batches:
            for doc_id, held_out, text in batch.itertuples(index=False):
                a = _tokens(numbers, text)
                h, c = _pairs(a, w)
                known = a < RARE_BIT
                rare = (h >= RARE_BIT) | (c >= RARE_BIT)
                score = log_p[c if fold else c[known]].sum() + log_a[h if fold else h[h < RARE_BIT]].sum()
                pairs = h[~rare] * w.classes + c[~rare]
                if len(t.frequent):
                    at = np.minimum(np.searchsorted(t.frequent, pairs), len(t.frequent) - 1)
                    hit = t.frequent[at] == pairs
                    score += gains[at[hit]].sum()
                    pairs = pairs[~hit]
                docs.append((DOCS, uid % t.buckets, base, uid, doc_id, held_out, len(a), int(known.sum()),
                             float(log_c[a[known]].sum()), float(score), *[None] * 5))
                held[PAIRS].append((uid - base, pairs))
                if not known.all():
                    held[WORDS].append((uid - base, a[~known], *_neighbours(a, w)))
                uid += 1
                size += len(a)
                if size >= flush:
                    yield requests()
                    base, size = uid, 0
            if docs:
                yield pd.DataFrame(docs, columns=OUT)
                docs.clear()
        yield requests()
    return run


def _joined(parts) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class _Rares:
    """The rare bigrams of a bucket: their gains, and log alpha of its rare histories."""

    def __init__(self, t: Tables, rows: pd.DataFrame):
        w = t.words
        h, c, n, total = (_joined(of(b, np.int64) for b in rows[x]) for x, of in (
            ("keys", unpack_rising), ("words", unpack), ("n", unpack), ("c", unpack)))
        p = w.word_p(total)
        p[c < RARE_BIT] = w.unigram()[c[c < RARE_BIT]]
        kept = discount(t.d, n) * n
        far = h >= RARE_BIT
        self.histories, place = np.unique(h[far], return_inverse=True)
        seen = np.bincount(place, n[far], len(self.histories))
        left = 1 - np.bincount(place, kept[far], len(self.histories)) / (seen + 1)
        alpha = left / np.maximum(1 - np.bincount(place, p[far], len(self.histories)), 1e-15)
        self.log_alpha = np.log10(alpha)
        count, log_a = np.zeros(len(h)), np.zeros(len(h))
        count[far], log_a[far] = seen[place], self.log_alpha[place]
        count[~far], log_a[~far] = t.history[h[~far]], np.log10(t.alpha[h[~far]])
        gain = np.log10(kept / (count + 1)) - log_a - np.log10(p)
        keys = _pair_key(h, c)
        order = np.argsort(keys)
        self.keys, self.gain = keys[order], gain[order]

    @staticmethod
    def _find(have: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        hit = have[at] == keys
        return hit, np.where(hit, values[at], 0.0)

    def gains(self, keys):
        return self._find(self.keys, self.gain, keys)

    def alphas(self, keys):
        return self._find(self.histories, self.log_alpha, keys)[1]


def _meet(tables):
    """Requests of a bucket meet its stored counts; one packed row per flush of a task goes on."""
    def run(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        t = tables.value
        w = t.words
        own = asked.loc[asked["kind"] == DOCS, ["grp", "base", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]]
        none = np.full(len(own), None)
        out = [own.rename(columns={"base": "uid"}).assign(uids=none, sums=none)]
        floor = np.log10(w.tokens + 0.1 * (w.distinct + 1))
        rares = _Rares(t, stored[stored["kind"] == RARES])
        sums = []  # documents, words seen, base and score to add
        for kind in (PAIRS, WORDS):
            rows, have = asked[asked["kind"] == kind], stored[stored["kind"] == kind]
            if not len(rows):
                continue
            keys = np.concatenate([unpack(b, np.int64) for b in rows["keys"]])
            docs = np.concatenate([unpack_rising(b, np.uint32).astype(np.int64) + base for b, base in zip(rows["docs"], rows["base"])])
            if kind == PAIRS:
                keys = keys * t.buckets + int(rows["bucket"].iloc[0])
                known, n = _joined(map(unpack_rising, have["keys"])), _joined(unpack(b, np.int64) for b in have["n"])
            else:
                known, n = have["word"].to_numpy(np.int64), have["m"].to_numpy(np.int64)
            order = np.argsort(known)
            known, n = known[order], n[order]
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            if kind == PAIRS:
                hit[hit] = n[at[hit]] < t.floor  # the others were answered from the broadcast table
                sums.append((docs[hit], None, None, t.gain(keys[hit], n[at[hit]])))
                continue
            c = np.where(hit, n[at], 0) if len(known) else np.zeros(len(keys), np.int64)
            if w.fold:
                add = np.log10(np.where(hit, c, w.hapaxes + 1) / w.rare_total())
            else:
                before = np.concatenate([unpack(b, np.uint32) for b in rows["before"]]).astype(np.int64)
                after = np.concatenate([unpack(b, np.uint32) for b in rows["after"]])
                far, after = after == FAR, after.astype(np.int64) - 1
                after[far] = np.concatenate([unpack(b, np.int64) for b in rows["far"]])
                add = np.log10(np.where(hit, w.word_p(c), w.rest)) + np.where(after >= 0, rares.alphas(keys), 0.0)
                some = before > 0
                add[some] += rares.gains(_pair_key(before[some] - 1, keys[some]))[1]
                some = after >= 0
                add[some] += rares.gains(_pair_key(keys[some], after[some]))[1]
            sums.append((docs, hit, np.log10(c + 0.1) - floor, add))
        if sums:
            uid, place = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
            total = np.array([np.bincount(place, np.concatenate([np.zeros(len(x[0])) if x[k] is None else x[k] for x in sums]), len(uid))
                              for k in (1, 2, 3)])
            groups = np.unique(asked.loc[asked["kind"] != DOCS, "grp"])
            # The documents of a flush are numbered from its own number on, up to the next flush.
            edges = [*np.searchsorted(uid, groups), len(uid)]
            out.append(pd.DataFrame(
                [(g, g, None, None, 0, 0, 0.0, 0.0, pack_rising(uid[lo:hi] - g), pack(total[:, lo:hi].ravel()))
                 for g, lo, hi in zip(groups, edges, edges[1:]) if hi > lo], columns=out[0].columns))
        return pd.concat([x.astype(object) for x in out if len(x)] or out[:1])
    return run


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of one flush with the sums that its buckets sent back."""
    packed = frame["uids"].notna().to_numpy()
    docs = frame[~packed].sort_values("uid")
    total = docs[["n_known", "base_score", "score"]].to_numpy(float).T.copy()
    at = docs["uid"].to_numpy(np.int64)
    for grp, uids, sums in zip(frame.loc[packed, "grp"], frame.loc[packed, "uids"], frame.loc[packed, "sums"]):
        total[:, np.searchsorted(at, unpack_rising(uids) + grp)] += unpack(sums, float).reshape(3, -1)
    return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"],
                         "n_known": total[0].astype(np.int64), "base_score": total[1], "score": total[2]})


def score(docs: DataFrame, model: Model, cfg: Config = Config()) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, w = docs.sparkSession, model.words
    kind = dict(docs.dtypes)["doc_id"]
    floor = (cfg.share or cfg.top) * w.tokens
    shared = spark.sparkContext.broadcast(Tables(w, model.buckets, model.d, model.history, model.alpha, model.scale, model.frequent,
                                                 model.frequent_n, floor if len(model.frequent) else float("inf")))
    # Ids travel as text: pandas would turn a nullable long into a double.
    counts = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    asked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text").mapInPandas(
        _send(shared, cfg.flush_tokens), f"kind int, bucket int, grp long, base long, {counts}, keys binary, docs binary, before binary, after binary, far binary")
    bigrams = model.bigrams.select("bucket", F.when(F.col("rare"), RARES).otherwise(PAIRS).alias("kind"), "keys", "words", "n", "c",
                                   *[F.lit(0).cast("long").alias(x) for x in ("word", "m")])
    words = model.unigrams.select(F.pmod("word", F.lit(model.buckets)).cast("int").alias("bucket"), F.lit(WORDS).alias("kind"),
                                  *[F.lit(None).cast("binary").alias(x) for x in ("keys", "words", "n", "c")],
                                  "word", F.col("n").alias("m"))
    if len(w.keys):
        words = words.where(F.col("m") < max(1.0, floor))
    stored = bigrams.unionByName(words)
    met = asked.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInPandas(
        _meet(shared), f"grp long, uid long, {counts}, uids binary, sums binary")
    return met.groupBy("grp").applyInPandas(_add, counts).select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known",
        F.lit(w.tokens).cast("long").alias("train_tokens"), "base_score", "score")

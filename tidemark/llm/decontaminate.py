"""Benchmark passages in documents: SimHash of item-sized windows and exact verification.

Method. For an item of n words every window of n words of a document is a place where it may stand.
Items and windows are compared as multisets of five-word shingles (a shorter item: all its words).
A window gets a 128-bit SimHash of its weighted shingles; 32 blocks of four bits index the items'
fingerprints, and by the pigeonhole rule any fingerprint within 31 bits agrees in a block, so the
index finds every item within the radius. Each such pair is verified by the exact weighted Jaccard
similarity of the shingle counts; pairs of at least 0.8 are matches. Of overlapping windows of one
item in one document the most similar (then the first) is reported.

Only windows that can reach 0.8 are fingerprinted: such a window of m shingles must share at least
1.6 m / 1.8 of them with an item of its size, and a count over the document's shingles tells. That
test loses nothing. The radius can: at a similarity of exactly 0.8 the distance is 19.3 bits on
average with a deviation of 4, so about 2 in 1,000 such pairs are farther than 31 bits.

Bounds. Items are broadcast in blocks of at most `Config.block_words` words (counted first); a larger
benchmark takes more passes over the documents. Documents are never shuffled.

Special cases. Words are runs without ASCII white space, A-Z in lower case. Null and empty texts and
items match nothing. Equal items each match. Windows never leave their document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from math import ceil

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, per_text
from tidemark.llm.simhash import words_of

SCHEMA = "items array<long>, starts array<long>, sizes array<long>, scores array<double>"
BLOCKS = 32
RADIUS = BLOCKS - 1


@dataclass(frozen=True)
class Config:
    shingle: int = 5
    similarity: float = 0.8
    block_words: int = 2_000_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles of a sequence of word hashes."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the rising known values (there is at least one)."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(27))


def prints(h: np.ndarray) -> np.ndarray:
    """(windows, shingles) of hashes -> (windows, 16) bytes of 128-bit SimHash; counts are weights."""
    both = np.stack([_mix(h, 0x5851F42D4C957F2D), _mix(h, 0x14057B7EF767814F)], axis=-1)
    bits = np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(*h.shape, 16), axis=-1)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > h.shape[1], axis=-1)


@dataclass
class Group:
    """Items of one size in words: their shingle counts and their block index."""

    size: int
    width: int
    ids: list[int]
    counts: list[Counter]
    known: np.ndarray
    prints: np.ndarray
    index: np.ndarray  # (block, value) -> which items have that value there


def _nibbles(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> 4, p & 15], axis=-1).reshape(*p.shape[:-1], BLOCKS)


def build(items: list[tuple[int, str]], cfg: Config = Config()) -> list[Group]:
    by_size = defaultdict(list)
    for item, text in items:
        words = words_of(text)
        if words:
            by_size[len(words)].append((item, np.array([word_hash(w) for w in words], np.uint64)))
    groups = []
    for size, some in sorted(by_size.items()):
        width = min(cfg.shingle, size)
        h = np.stack([shingles(x, width) for _, x in some])
        p = prints(h)
        index = np.zeros((BLOCKS, 16, len(some)), bool)
        for i, row in enumerate(_nibbles(p)):
            index[np.arange(BLOCKS), row, i] = True
        groups.append(Group(size, width, [i for i, _ in some], [Counter(r.tolist()) for r in h], np.unique(h), p, index))
    return groups


def finder(groups: list[Group], cfg: Config = Config()):
    """text -> (items, starts, sizes, similarities) of the matches, starts counted in words."""
    hashes = Memo(word_hash, 400_000)
    widths = sorted({g.width for g in groups})
    known = {w: np.unique(np.concatenate([g.known for g in groups if g.width == w])) for w in widths}
    maybe = {}
    for w, all_known in known.items():
        maybe[w] = np.zeros(1 << 20, bool)
        maybe[w][all_known >> np.uint64(44)] = True

    def one(text):
        words = words_of(text)
        found = []
        if words and groups:
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            for w in widths:
                if len(h) >= w:
                    s = shingles(h, w)
                    at = np.flatnonzero(maybe[w][s >> np.uint64(44)])
                    at = at[_among(s[at], known[w])]
                    if len(at):
                        for g in groups:
                            if g.width == w and len(h) >= g.size:
                                found += _matches(g, s, at, cfg)
        found.sort()
        return tuple(list(x) for x in zip(*found)) if found else ([], [], [], [])
    return one


def _matches(g: Group, s: np.ndarray, at: np.ndarray, cfg: Config) -> list[tuple[int, int, int, float]]:
    m = g.size - g.width + 1
    need = ceil(2 * m * cfg.similarity / (1 + cfg.similarity) - 1e-9)
    here = at[_among(s[at], g.known)]
    if len(here) < need:
        return []
    hit = np.zeros(len(s) + 1, np.int64)
    hit[here + 1] = 1
    total = np.cumsum(hit)
    starts = np.flatnonzero(total[m:] - total[:-m] >= need)
    best: list[list[tuple[float, int]]] = [[] for _ in g.ids]
    for lo in range(0, len(starts), 512):
        part = starts[lo:lo + 512]
        windows = s[part[:, None] + np.arange(m)]
        p = prints(windows)
        near = np.zeros((len(part), len(g.ids)), bool)
        for b, value in enumerate(_nibbles(p).T):
            near |= g.index[b][value]
        for i, k in zip(*np.nonzero(near)):
            if int(np.unpackbits(p[i] ^ g.prints[k]).sum()) <= RADIUS:
                common = sum((Counter(windows[i].tolist()) & g.counts[k]).values())
                score = common / (2 * m - common)
                if score >= cfg.similarity - 1e-12:
                    best[k].append((score, int(part[i])))
    out = []
    for k, found in enumerate(best):
        taken: list[int] = []
        for score, start in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(abs(start - t) >= g.size for t in taken):
                taken.append(start)
                out.append((g.ids[k], start, g.size, score))
    return out


def blocks(items: DataFrame, cfg: Config = Config()) -> list[list[tuple[int, str]]]:
    """Items (item_id, text) in blocks small enough to broadcast; how many follows from their words."""
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    words = items.agg(F.sum(F.size(F.split("text", "[ \t\n\\x0B\f\r]+")))).first()[0] or 0
    n = max(1, ceil(words / cfg.block_words))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r.item_id, r.text) for r in part.collect())


def match_columns(docs: DataFrame, items: DataFrame, cfg: Config = Config()) -> list[Column]:
    """One struct column (items, starts, sizes, scores) over docs.text for each block of items."""
    spark = docs.sparkSession
    out = []
    for block in blocks(items, cfg):
        shared = spark.sparkContext.broadcast(build(block, cfg))
        out.append(per_text(lambda shared=shared: finder(shared.value, cfg), SCHEMA)("text"))
    return out


def matches(docs: DataFrame, items: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs (doc_id, text) -> one row per match: doc_id, item_id, start, n_words, similarity."""
    docs = docs.select("doc_id", "text")
    out = None
    for col in match_columns(docs, items, cfg):
        rows = docs.select("doc_id", col.alias("m")).select(
            "doc_id", F.explode(F.arrays_zip("m.items", "m.starts", "m.sizes", "m.scores")).alias("m")).select(
            "doc_id", F.col("m.items").alias("item_id"), F.col("m.starts").alias("start"),
            F.col("m.sizes").alias("n_words"), F.col("m.scores").alias("similarity"))
        out = rows if out is None else out.unionByName(rows)
    return out

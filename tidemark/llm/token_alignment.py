"""Tokens of two tokenizers over the same bytes: groups with common ends, and how often ids meet.

Method. Each text has two arrays of byte ends, one per tokenizer. Where both have tokens from a
common end on, the arrays are compared at the current index shift: blocks of 1, 2, 4, ... ends are
compared whole, a failing block is halved, and the one-to-one stretch so found is jumped in one step
(`stretches`). What stops it is one irregular group: two pointers walk to the next common end, and
the difference of their steps becomes the new shift. Groups and links (token pairs with overlapping
byte ranges) come from the same walk.

Ids come from the public tokenizers. Texts are cut before spaces that stand behind a visible
character and between plain words and marks, where both always cut; the ids of these parts are kept in a
bounded cache, and unknown parts of some texts are encoded in one call.

Corpus counts. `align` stores, for each document, its distinct id pairs with their numbers. Their
sums are the corpus counts (pre-aggregated in each task, so a pair that every document holds is one
row per flush), and the best count of each second id is bounded by that vocabulary. Pairs with
at least `Config.share` of all links (at most 1 / share of them) are broadcast; for the others,
documents send (row, pair, number) to the table of counts. Both ways give the same sums.

Special cases. Texts that are null, empty, or that one of the tokenizers does not give back byte for
byte (such as U+2581, which stands for a space there) have no tokens: zeros and an empty digest.
Repeated rows and null ids are rows of their own, told apart by a stored number, and each counts in the corpus
counts. An empty table gives an empty one. Columns beside doc_id and text are not read. Time is in proportion to
the length of a text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import Memo, store
from tidemark.llm.packing import LETTERS

SPACE = "▁"
#: Letters and marks that both tokenizers always part (the second's pieces are checked when it is loaded).
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?|"
PLAIN = re.compile(f" [{LETTER}]+")
#: Parts end before a space behind a visible character, or between a plain word and a mark.
PART = re.compile(rf" [{LETTER}]+(?=[ {MARK}]|\Z)|\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
#: A pair of ids is one number: the first id above the bits of the second.
BITS = 15
CACHE, FLUSH, TEXTS = 250_000, 2_000_000, 200
ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, numbers binary"


@dataclass(frozen=True)
class Config:
    share: float = 1e-6


class Encoders:
    """Both tokenizers, the bytes of their tokens, and the parts already encoded."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.first.encode_special_tokens = True
        byte_of = {chr(c): b for b, c in ({b: b for b in range(256)} | LETTERS).items()}
        vocab = sorted(self.first.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        self.bytes_a = [b""] * (max(i for _, i in vocab) + 1)
        for entry, i in vocab:
            self.bytes_a[i] = bytes(byte_of[c] for c in entry if c in byte_of)
        piece, size = self.second.id_to_piece, self.second.get_piece_size()
        if size > 1 << BITS or len(self.bytes_a) > 1 << (32 - BITS):
            raise ValueError("a pair of ids does not fit 32 bits")
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.second.is_byte(i) else piece(i).replace(SPACE, " ").encode()
                        for i in range(size)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        if any(re.search(f"[{LETTER}][{MARK}]", piece(i)) for i in range(size)) or len(self.second.encode("a")) != 1:
            raise ValueError("a piece joins a letter and a mark")
        digits = np.array([f"{i:05d}" for i in range(max(len(self.bytes_a), size))], "S5")
        self.digits = digits.view(np.uint8).reshape(-1, 5)
        self.changed: set[str] = set()  # parts that a tokenizer does not give back
        self.parts = Memo(lambda part: self._encode([part])[0], CACHE)

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides of each part, as bytes."""
        model, out, space = self.first.model.tokenize, [], [self.second.piece_to_id(SPACE)]
        # The second tokenizer puts a space before what it is given; a part without one follows a letter.
        given = [p[1:] if p[0] == " " else "a" + p for p in parts]
        for part, b in zip(parts, self.second.encode(given, num_threads=1)):
            if part[0] != " ":
                b = b[1:]
            if PLAIN.fullmatch(part):  # one part of the first tokenizer's own pattern
                a = [t.id for t in model(part.encode().decode("latin-1").translate(LETTERS))]
            else:
                a = self.first.encode(part, add_special_tokens=False).ids
            b = b or space
            if any(b"".join(map(table.__getitem__, ids)) != part.encode() for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                self.changed.add(part)
            out.append((array("I", a).tobytes(), array("I", b).tobytes()))
        return out

    def _fill(self, parts: set[str]) -> None:
        """Encode the parts that are not known, in one call."""
        new = [p for p in parts if p not in self.parts and p not in self.parts.old]
        if new:
            found = dict(zip(new, self._encode(new)))
            self.parts.fn = found.__getitem__
            for part in new:
                self.parts[part]
            self.parts.fn = lambda part: self._encode([part])[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for a space and each text, or None where a side's bytes differ from it."""
        cut = [PART.findall(" " + t) if t and SPACE not in t else None for t in texts]
        self._fill(set(chain.from_iterable(c for c in cut if c)))
        return [None if c is None else self._ids(" " + t, c) for t, c in zip(texts, cut)]

    def _ids(self, text: str, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = tuple(np.frombuffer(b"".join(side), "<u4") for side in zip(*map(self.parts.__getitem__, parts)))
        if not self.changed.isdisjoint(parts):  # no part changed: neither did the whole
            whole = text.encode()
            if any(b"".join(map(table.__getitem__, side.tolist())) != whole for table, side in zip((self.bytes_a, self.bytes_b), ids)):
                return None
        return ids


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


def stretches(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(i, j, n, m) in order: n == m > 0 and a[i:i+n] == b[j:j+n] for one-to-one stretches, else one irregular group.

    Both arrays rise and end with the same number.
    """
    i = j = 0
    size, out = len(a), []
    while i < size:
        if a[i] == b[j]:
            n, step = 1, min(2, size - i - 1)
            while step and a[i + n:i + n + step] == b[j + n:j + n + step]:
                n += step
                step = min(2 * step, size - i - n)
            while step > 1:
                step = (step + 1) // 2
                if a[i + n:i + n + step] == b[j + n:j + n + step]:
                    n += step
            out.append((i, j, n, n))
            i += n
            j += n
            if i >= size:
                break
        p, q, x, y = i, j, a[i], b[j]
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        out.append((i, j, p - i + 1, q - j + 1))
        i, j = p + 1, q + 1
    return out


def group_ends(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index ends of all groups on both sides, one-to-one stretches unfolded."""
    i, j, n, m = np.array(parts, np.int64).T
    straight = a[i] == b[j]
    times = np.where(straight, n, 1)
    return np.repeat(np.where(straight, 1, n), times).cumsum(), np.repeat(np.where(straight, 1, m), times).cumsum()


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked indices of both sides: between two neighbouring ends of either side lies one token of each."""
    in_a, in_b = np.zeros(a[-1] + 1, np.int8), np.zeros(a[-1] + 1, np.int8)
    in_a[a] = in_b[b] = 1
    ends = np.flatnonzero(in_a | in_b)
    return tuple(x.cumsum(dtype=np.int32)[ends] - x[ends] for x in (in_a, in_b))


def shown(digits: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """The groups as text: "a1,a2|b1;a3|b2,b3"."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    at_a = np.arange(len(a)) + np.repeat(ends_b - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(ends_a, size_b)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[ends_a - 1]] = ord("|")
    mark[at_b[ends_b - 1]] = ord(";")
    text = np.empty((len(ids), 6), np.uint8)
    text[:, :5], text[:, 5] = digits[ids], mark
    keep = np.ones(text.shape, bool)  # without leading zeros
    for k, least in enumerate((10_000, 1_000, 100, 10)):
        keep[:, k] = ids >= least
    return text[keep][:-1].tobytes()


def digest(enc: Encoders, ids: tuple[np.ndarray, np.ndarray] | None) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and their numbers (both as bytes)."""
    if ids is None:
        return 0, 0, 0, 0, "", b"", b""
    a, b = ids
    ends_a, ends_b = enc.size_a[a].cumsum(), enc.size_b[b].cumsum()
    groups = group_ends(ends_a, ends_b, stretches(ends_a.tolist(), ends_b.tolist()))
    left, right = links(ends_a, ends_b)
    pairs, numbers = np.unique(a[left] << np.uint32(BITS) | b[right], return_counts=True)
    return (len(a), len(b), len(groups[0]), len(left), sha256(shown(enc.digits, a, b, *groups)).hexdigest(),
            pairs.astype("<u4").tobytes(), numbers.astype("<u4").tobytes())


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> one stored row per document: its numbers, digest, and distinct id pairs."""
    names = StructType.fromDDL(ROW).names[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold hundreds of thousands of tuples and no cycles
        enc = encoders(path_a, path_b)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                rows = [digest(enc, ids) for ids in enc.encode_all(some["text"].to_pylist())]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [some["row"], some["doc_id"], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["row", "doc_id", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(run, ROW), "aligned")


def groups_column(path_a: str, path_b: str):
    """Column function text -> array of (a ids, b ids) of its groups, for those who want the groups themselves."""
    schema = "array<struct<a array<int>, b array<int>>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoders(path_a, path_b)

        def one(ids):
            if ids is None:
                return []
            a, b = ids
            ends_a, ends_b = enc.size_a[a].cumsum(), enc.size_b[b].cumsum()
            groups = group_ends(ends_a, ends_b, stretches(ends_a.tolist(), ends_b.tolist()))
            return [{"a": x, "b": y} for x, y in zip(*(np.split(v.astype("i4"), g[:-1]) for v, g in zip(ids, groups)))]
        for texts in batches:
            yield pd.Series([one(ids) for ids in enc.encode_all(texts.tolist())], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, schema).asNondeterministic()


# ------------------------------------------------------------------ corpus counts
def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the pairs of a task's documents, handing sums on whenever many are held."""
    held, size = [], 0

    def out():
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([n for _, n in held]).astype(np.int64))
        return keys, sums

    for batch in batches:
        for pairs, numbers in zip(batch["pairs"], batch["numbers"]):
            held.append((np.frombuffer(pairs.as_py(), "<u4"), np.frombuffer(numbers.as_py(), "<u4")))
            size += len(held[-1][0])
            if size >= FLUSH:
                held = [out()]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield _pair_batch(*held[0])
                    held, size = [], 0
    if held:
        yield _pair_batch(*out())


def _pair_batch(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], ["pair", "n"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """Stored rows of `align` -> pair, n (corpus count), best (whether it is the highest of its second id)."""
    sums = store(rows.select("pairs", "numbers").mapInArrow(_sum_pairs, "pair long, n long")
                 .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << BITS) - 1)
    best = sums.groupBy(second.alias("second")).agg(F.max("n").alias("most"))  # a row per id of that vocabulary
    return sums.join(F.broadcast(best), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Stored rows of `align` -> row, n_best, count_sum for the rows with links."""
    counts = store(pair_counts(rows), "pairs")
    total = rows.agg(F.sum("n_links")).first()[0] or 0
    often = F.col("n") >= F.lit(cfg.share * total)
    table = counts.where(often).orderBy("pair").toPandas()  # at most 1 / share rows
    shared = rows.sparkSession.sparkContext.broadcast(
        (table["pair"].to_numpy(np.uint32), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        for batch in batches:
            out = []
            for row, pairs, numbers in zip(*(batch[c].to_pylist() for c in ("row", "pairs", "numbers"))):
                pairs, numbers = np.frombuffer(pairs, "<u4"), np.frombuffer(numbers, "<u4").astype(np.int64)
                at = np.searchsorted(keys, pairs)
                here = at < len(keys)
                here[here] = keys[at[here]] == pairs[here]
                at, n = at[here], numbers[here]
                out.append((row, int(n[best[at]].sum()), int((n * count[at]).sum()),
                            pairs[~here].astype(np.int64), numbers[~here]))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["row", "n_best", "count_sum", "rest", "times"])

    looked = store(rows.where("n_links > 0").select("row", "pairs", "numbers").mapInArrow(
        known, "row long, n_best long, count_sum long, rest array<long>, times array<long>"), "links-known")
    rest = looked.select("row", F.explode(F.arrays_zip("rest", "times")).alias("p")).select("row", "p.rest", "p.times")
    rare = rest.join(counts.where(~often), rest["rest"] == counts["pair"]).select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return looked.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, cfg: Config = Config()) -> DataFrame:
    """docs (doc_id, text) -> one row per document: numbers, sums over its links, digest of its groups."""
    rows = align(docs, path_a, path_b)
    zero = F.lit(0).cast("long")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(
        link_counts(rows, cfg), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")

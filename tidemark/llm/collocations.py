"""Phrases whose words stand together more often than apart, found by dynamic itemset counting.

Counting. Rows are dealt to `Config.shards` stored shards, which are scanned in a cycle. A phrase is a
candidate once its first words and its last words (all but one) have reached the threshold, at whatever place of
the cycle that happens, so lengths are counted side by side; words are candidates from the start. A candidate's
hash slot is counted until each shard was scanned once since. When the slot reaches the threshold, the phrase gets
a counter of its own, again for one whole cycle. A shard that is visited again only gives what became active since
its last visit. The scans end when no shard has anything more to give. Every phrase that reaches the threshold is
found: its parts and its slot count at least as much, and counts only grow.

What reached the threshold is kept as a bitmap of `1 << Config.bits` slots, fed by sums per slot (a byte each, which
stops at the threshold). Slots that phrases share only make a phrase active without need, which costs work and changes
no result: each phrase is counted by its text, once per shard, and the threshold is applied to its exact
count at the end. So what is broadcast and what the driver holds (bitmaps of 2 MB, counters of 16 MB) do not grow
with the data; with far more phrases than slots, more bits keep the pruning sharp. Tasks number their words, count in
arrays and hand sums on per few million words, so a phrase that is everywhere is counted once per flush. The sums
are stored and moved packed: a row for each language, length and group of slots, which holds phrases and counts.

Scores follow from the frequent phrases alone, by joins on (language, phrase). The best per language
are taken in rounds over salted groups of bounded size.

Special cases. Null text is empty, null lang is `und`. Texts without words give nothing; an empty table gives an
empty result. Repeated rows count each time. Ties in score go by count, then by the phrase's bytes. Columns
beside text and lang are not read. Very long texts are counted like others.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, store
from tidemark.session import scratch_dir

#: Bytes of lower-cased texts as they are split: stops (which no phrase spans) to one line end, tabs to spaces.
STOPS = b".,;:!?\n\v\f\r"
PLAIN = bytes.maketrans(STOPS + b"\t", b"\n" * len(STOPS) + b" ")
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
COUNTS = "lang string, size byte, slot int, n long, keys binary, counts binary"
NAMES = ["lang", "size", "slot", "n", "keys", "counts"]
RANGE = 16      # bits of a range of slots: an offset in it fits two bytes
GROUP = 6       # bits of a group of slots: the phrases of one group, language and length are packed and added up together
COMBINED = 8 << 20  # bytes of packed counts that a task adds up before they are moved
JOINED = 8 << 20  # bytes of text that are split at once


@dataclass(frozen=True)
class Config:
    least: int = 30
    longest: int = 4
    shards: int = 2
    bits: int = 24
    scale: int = 2_000_000
    inside: int = 80
    top: int = 2000
    #: Words per flush and word numbers per task, both bounds of a task's memory; group size of a salted round.
    flush: int = 2_000_000
    vocabulary: int = 600_000
    group: int = 100_000
    #: Phrases that are held unadded when packed counts are added up.
    pending: int = 1_000_000


class Bitmap:
    """Slots of phrases that reached the threshold."""

    def __init__(self, bits: int, raw: bytes | None = None):
        self.bits = bits
        self.raw = np.zeros(1 << bits >> 3, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes ^ hashes >> np.uint64(29)) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, slots: np.ndarray) -> np.ndarray:
        return (self.raw[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


class Scanner:
    """What one task counts of a shard: only what its last visit (with the bitmap `before`) did not count.

    A phrase is a candidate once its parts are in the bitmap; then its slot is counted. Once its own slot is
    in the bitmap too, it is counted by its text.
    """

    def __init__(self, cfg: Config, now: Bitmap, before: Bitmap | None):
        self.cfg, self.now, self.before = cfg, now, before
        self.slots, self.waiting = [], 0
        self.clear()

    def clear(self) -> None:
        self.of_lang: dict[str, dict[bytes, int]] = {}
        self.words, self.langs, self.hashes = [b""], [""], [0]
        self.held, self.size = [], 0

    def _numbers(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        """Numbers of distinct tokens: 0 for a stop, -1 for what lies between two spaces."""
        import xxhash
        known = self.of_lang.setdefault(lang, {b"\n": 0, b"": -1})
        seed = xxhash.xxh64_intdigest(lang)
        for word in tokens:
            if word not in known:
                known[word] = len(self.words)
                self.words.append(word)
                self.langs.append(lang)
                self.hashes.append(xxhash.xxh64_intdigest(word, seed))
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Whole texts of one language; a stop stands between them."""
        raw = b"\n".join([b"", *texts]).lower().translate(PLAIN).replace(b"\n", b" \n ")
        split = pc.split_pattern(pa.array([raw], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
        ids = self._numbers(lang, split.dictionary.to_pylist())[split.indices.to_numpy()]
        self.held.append(ids[ids >= 0])
        self.size += len(self.held[-1])
        if self.size >= self.cfg.flush or len(self.words) > self.cfg.vocabulary:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Sums of the held words; the word numbers stay while they are few."""
        if self.held:
            ids, self.held, self.size = np.concatenate(self.held), [], 0
            yield from self._count(ids)
        if len(self.words) > self.cfg.vocabulary:
            self.clear()
        if self.waiting >= 2 * self.cfg.flush:
            yield from self.give_slots()

    def give_slots(self) -> Iterator[pa.RecordBatch]:
        if self.slots:
            yield _slot_rows(np.concatenate([x for x, _ in self.slots]), np.concatenate([n for _, n in self.slots]), self.cfg.least)
        self.slots, self.waiting = [], 0

    def _slots(self, slots: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            slots, n = np.unique(slots.astype(np.int32), return_counts=True)
        self.slots.append((slots.astype(np.int32), np.minimum(n, self.cfg.least).astype(np.uint8)))
        self.waiting += len(n)

    def _count(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, langs = pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(self.langs, pa.string()).dictionary_encode()
        hashes = np.array(self.hashes, np.uint64)
        own, n = self.now.slots(hashes), np.bincount(ids, minlength=len(hashes))
        n[0] = 0
        seen = n > 0
        reached = self.now.has(own)
        reached[0] = False
        if self.before is None:
            self._slots(own[seen], n[seen])
            of = np.array(self.langs, object)[seen]
            for lang in set(of):
                yield _batch([lang], 0, [0], [n[seen][of == lang].sum()], [None], [None])
        was = np.zeros_like(reached) if self.before is None else self.before.has(own) & reached
        new = np.flatnonzero(seen & reached & ~was)
        if len(new):
            yield _packed(1, langs.take(pa.array(new)), names.take(pa.array(new)), own[new] >> self.cfg.bits - GROUP, n[new])
        active, earlier, h = reached[ids], was[ids], hashes[ids]
        word_hash = h
        for size in range(2, self.cfg.longest + 1):
            if len(ids) < size:
                return
            active, earlier = active[:-1] & active[1:], earlier[:-1] & earlier[1:]
            h = h[:-1] * MULTIPLIER + word_hash[size - 1:]
            at = np.flatnonzero(active)
            if not len(at):
                return
            slots, had = self.now.slots(h[at]), earlier[at]
            if not had.all():
                self._slots(slots[~had])
            here = self.now.has(slots)
            there = np.zeros_like(here) if self.before is None else had & self.before.has(slots)
            new = here & ~there
            if new.any():
                first, n = _distinct(ids, at[new], size, len(hashes))
                parts = [names.take(pa.array(ids[first + k])) for k in range(size)]
                yield _packed(size, langs.take(pa.array(ids[first])), pc.binary_join_element_wise(*parts, " "),
                              self.now.slots(h[first]) >> self.cfg.bits - GROUP, n)
            active[at], earlier[at] = here, there


def _batch(langs, size, slots, n, keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(np.broadcast_to(np.asarray(size, np.int8), len(keys)).copy()), pa.array(np.asarray(slots, np.int32)),
         pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], NAMES)


def _squeeze(raw) -> bytes:
    """Compressed bytes after their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _whole(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), codec="zstd", asbytes=True)


def _cells(key: np.ndarray, lines: pa.LargeStringArray, n: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes], list[bytes]]:
    """Of rising keys: each distinct one, the number of its lines, these and their counts packed."""
    keys, start = np.unique(key, return_index=True)
    parts, n = list(zip(start, [*start[1:], len(key)])), n.astype("<i8")
    ends, text = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1], lines.buffers()[2]
    return (keys, [j - i for i, j in parts], [_squeeze(text.slice(ends[i], ends[j] - ends[i])) for i, j in parts],
            [_squeeze(n[i:j].tobytes()) for i, j in parts])


def _packed(size: int, langs: pa.DictionaryArray, phrases: pa.Array, groups: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of distinct phrases by text: a row per language and group. No phrase holds a line end, so each ends with one."""
    key = langs.indices.to_numpy().astype(np.int64) << GROUP | groups
    order = np.argsort(key, kind="stable")
    lines = pc.binary_join_element_wise(phrases.take(pa.array(order)), "", "\n").cast(pa.large_string())
    keys, *cells = _cells(key[order], lines, np.asarray(n)[order])
    return _batch(langs.dictionary.take(pa.array(keys >> GROUP)), size, keys & (1 << GROUP) - 1, *cells)


def _lines(keys: bytes, counts: bytes) -> pa.Table:
    """The phrases (each with its line end) and counts of a packed row."""
    raw = _whole(keys)
    ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1]).astype(np.int64)
    lines = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
    return pa.table({"line": lines, "n": pa.array(np.frombuffer(_whole(counts), "<i8"))})


def _rows(lang: str, size: int, lines: pa.Table) -> pa.RecordBatch:
    """lang, size, phrase, count."""
    phrases = pc.replace_substring(lines["line"].combine_chunks(), "\n", "").cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)), pa.repeat(pa.scalar(size, pa.int8()), len(phrases)), phrases,
                                       lines["n"].combine_chunks()], ["lang", "size", "phrase", "n"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield _rows(r["lang"], r["size"], _lines(r["keys"], r["counts"]))


def _added(held: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(held).group_by(by, use_threads=False).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows -> one for each group of what a task reads (COMBINED bytes at once), its phrases sorted."""
    codes: dict[tuple, int] = {}
    held, waiting = [], 0

    def given() -> Iterator[pa.RecordBatch]:
        if held:
            rows = _added(held, ["code", "line"]).sort_by([("code", "ascending"), ("line", "ascending")])
            own, *cells = _cells(rows["code"].to_numpy(), rows["line"].combine_chunks(), rows["n"].to_numpy())
            langs, sizes, slots = zip(*map(list(codes).__getitem__, own))
            yield _batch(langs, sizes, slots, *cells)
    for batch in batches:
        for *at, keys, counts in zip(*(batch[c].to_pylist() for c in ("lang", "size", "slot", "keys", "counts"))):
            lines = _lines(keys, counts)
            held.append(lines.append_column("code", pa.repeat(pa.scalar(codes.setdefault(tuple(at), len(codes)), pa.int64()), len(lines))))
            waiting += len(keys) + len(counts)
            if waiting >= COMBINED:
                yield from given()
                held, waiting = [], 0
    yield from given()


def _add_up(batches: Iterator[pa.RecordBatch], least: int, pending: int) -> Iterator[pa.RecordBatch]:
    """Packed rows in the order of their groups -> the phrases of each group that reach the threshold.

    What is held is the distinct phrases of one group and `pending` more.
    """
    group, held, waiting = None, [], 0

    def reached() -> Iterator[pa.RecordBatch]:
        if held:
            every = _added(held, ["line"])
            yield _rows(group[0], group[1], every.filter(pc.greater_equal(every["n"], least)))
    for batch in batches:
        for lang, size, slot, keys, counts in zip(*(batch[c] for c in ("lang", "size", "slot", "keys", "counts"))):
            at = lang.as_py(), size.as_py(), slot.as_py()
            if at != group:
                yield from reached()
                group, held, waiting = at, [], 0
            held.append(_lines(keys.as_py(), counts.as_py()))
            waiting += len(held[-1])
            if waiting >= pending:
                held, waiting = [_added(held, ["line"])], 0
    yield from reached()


class Counts:
    """Stored packed counts, a table per scan. Iterating gives their rows by phrase: lang, size, phrase, n."""

    def __init__(self, packed: list[DataFrame]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[DataFrame]:
        return (t.where("size >= 1").mapInArrow(_unpack, "lang string, size byte, phrase string, n long") for t in self.packed)

    def where(self, condition: str) -> DataFrame:
        return reduce(DataFrame.unionByName, self.packed).where(condition)


def _slot_rows(slots: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
    """Sums per slot, up to the threshold: a row per range of slots, with offsets and counts as bytes."""
    slots, at = np.unique(slots, return_inverse=True)
    sums = np.bincount(at, n)
    ranges, start = np.unique(slots >> RANGE, return_index=True)
    parts = list(zip(start, [*start[1:], len(slots)]))
    offsets, counts = slots.astype("<u2"), np.minimum(sums, least).astype("u1")
    none = [None] * len(ranges)
    return _batch(none, -1, ranges, none, [offsets[i:j].tobytes() for i, j in parts], [counts[i:j].tobytes() for i, j in parts])


def _distinct(ids: np.ndarray, at: np.ndarray, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the number of each distinct phrase of `size` words that starts at `at`."""
    key = ids[at].astype(np.int64)
    top = count
    for k in range(1, size):
        if top > (1 << 62) // count:  # number the beginnings anew, so that a key fits 64 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = len(at) + 1
        key, top = key * count + ids[at + k], top * count
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


# ------------------------------------------------------------------ cyclic scans
def count_phrases(docs: DataFrame, cfg: Config = Config()) -> tuple[Counts, Bitmap]:
    """docs (text, lang) -> stored counts (they add up by lang, size and phrase) and the final bitmap."""
    if not 8 <= cfg.bits <= 31 or not 1 <= cfg.least <= 255:
        raise ValueError("bits must be 8 to 31, and the threshold 1 to 255")
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cfg.shards)).cast("int")
    shards = store(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
                               shard.alias("shard")), "collocation-shards", by="shard")
    counts: list[DataFrame] = []
    now, visited, step = Bitmap(cfg.bits), [None] * cfg.shards, 0
    sums = np.zeros(1 << cfg.bits, np.uint8)
    while True:
        if step >= cfg.shards:
            same = [np.array_equal(v.raw, now.raw) for v in visited]
            if all(same):
                return Counts(counts), now
            while same[step % cfg.shards]:
                step += 1
        s = step % cfg.shards
        counts.append(_store_small(_scan(shards.where(F.col("shard") == s), cfg, now, visited[s])))
        visited[s] = now
        now = _reached(counts[-1], sums, cfg)
        step += 1


def _store_small(counts: DataFrame) -> DataFrame:
    """Stored once like `store`, with the stronger compression."""
    path = scratch_dir(counts.sparkSession, "collocation-counts")
    counts.write.option("compression", "zstd").parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def _scan(rows: DataFrame, cfg: Config, now: Bitmap, before: Bitmap | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((now.raw.tobytes(), None if before is None else before.raw.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the word numbers hold no cycles
        a, b = shared.value
        scanner = Scanner(cfg, Bitmap(cfg.bits, a), None if b is None else Bitmap(cfg.bits, b))
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            size = 0
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
                texts.setdefault(lang, []).append(text.as_py())
                size += len(texts[lang][-1])
                if size >= JOINED:
                    for x, some in texts.items():
                        yield from scanner.add(x, some)
                    texts, size = {}, 0
            for x, some in texts.items():
                yield from scanner.add(x, some)
        yield from scanner.flush()
        yield from scanner.give_slots()
    return rows.select("lang", "text").mapInArrow(run, COUNTS)


def _range_sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The counters of whole ranges, each up to the threshold."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, offsets, counts in zip(*(batch[c].to_pylist() for c in ("slot", "keys", "counts"))):
            sums = held.setdefault(r, np.zeros(1 << RANGE, np.uint8))
            at = np.frombuffer(offsets, "<u2")
            sums[at] = np.minimum(sums[at].astype(np.uint16) + np.frombuffer(counts, "u1"), least)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                     ["range", "sums"])


def _reached(new: DataFrame, sums: np.ndarray, cfg: Config) -> Bitmap:
    """Add new rows to the counters of the slots (a byte each, up to the threshold); the slots that reached it.

    The counters are bounded by the number of slots, whatever the data.
    """
    least = cfg.least
    parts = new.where("size = -1").select("slot", "keys", "counts")
    whole = parts.repartition("slot").mapInArrow(lambda b: _range_sums(b, least), "range int, sums binary")
    for r in whole.toLocalIterator():
        add = np.frombuffer(r["sums"], "u1")
        at = slice(r["range"] << RANGE, (r["range"] << RANGE) + len(add))
        mine = sums[at]
        mine[:] = np.minimum(mine.astype(np.uint16) + add[:len(mine)], least)
    return Bitmap(cfg.bits, np.packbits(sums >= least, bitorder="little").tobytes())


def frequent_phrases(counts: Counts, reached: Bitmap, cfg: Config = Config()) -> DataFrame:
    """lang, size, phrase, a for all phrases that reach the threshold. (Only phrases whose slots are in `reached` were counted.)"""
    least, pending = cfg.least, cfg.pending
    groups = counts.where("size >= 1").mapInArrow(_combine, COUNTS).repartition("lang", "size", "slot")
    return groups.sortWithinPartitions("lang", "size", "slot").mapInArrow(
        lambda b: _add_up(b, least, pending), "lang string, size byte, phrase string, n long").withColumnRenamed("n", "a")


# ------------------------------------------------------------------ scores
def _slice(words: str, start, size) -> F.Column:
    return F.array_join(F.slice(words, start, size), " ")


def score_phrases(frequent: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Stored frequent phrases -> lang, phrase, a, l, r, score of the candidates that no longer one holds."""
    big = "decimal(20,0)"
    words = frequent.where("size >= 2").withColumn("words", F.split("phrase", " ")).withColumn("size", F.col("size").cast("int"))
    cuts = words.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _slice("words", F.lit(1), F.col("k")).alias("first"),
        _slice("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    sides = [frequent.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)) for part, name in (("first", "l"), ("rest", "r"))]
    cuts = cuts.join(sides[0], ["lang", "first"]).join(sides[1], ["lang", "rest"])
    score = F.expr(f"({cfg.scale}BD * cast(a as {big})) div (cast(l as {big}) + cast(r as {big}))")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    held = words.where("size >= 3").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")).select(
        "lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("k")).select(
        "lang", "a", _slice("words", F.col("k"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return least.join(held, ["lang", "phrase"], "left").where(F.expr(
        f"longer is null or 100BD * cast(longer as {big}) < {cfg.inside}BD * cast(a as {big})")).drop("longer")


def top_phrases(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The first `cfg.top` rows of each language with their rank; groups of a round hold about `cfg.group` rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt, place = fresh(scored, "salt"), fresh(scored, "place")
    rows, size = scored, scored.count()
    while size > cfg.group:
        n = ceil(size / cfg.group)
        rows = store(rows.withColumn(salt, F.pmod(F.xxhash64("phrase"), F.lit(n))).withColumn(
            place, F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col(place) <= cfg.top).drop(salt, place),
            "collocation-top")
        left = rows.count()
        if left >= size:
            break
        size = left
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= cfg.top)


def collocations(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs (text, lang) -> lang, rank, phrase, a, l, r, n, score."""
    counts, reached = count_phrases(docs, cfg)
    frequent = store(frequent_phrases(counts, reached, cfg), "collocation-frequent")
    words = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    top = top_phrases(store(score_phrases(frequent, cfg), "collocation-scores"), cfg)
    return top.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

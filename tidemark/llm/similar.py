"""Near-duplicate classes of documents by the Jaccard similarity of their 5-word shingles.

Each text is shingled once: its distinct shingles give a node (a hash of the set), their number, BANDS
bands of ROWS minima, and a byte of each minimum as a sketch. Only these are stored and moved. Sets are
candidates if they agree in a band (a pair at a similarity of 0.8 agrees in none with probability 5e-6), if
their sizes allow the similarity, and if their sketches agree in at least ALIKE of the bytes (a pair at 0.8 falls
below with probability under 1e-12). Candidates become links if their exact similarity is at least SIMILAR; a class is a
component of the links.

Sets are shingled again for this last step, for candidates only: their rows are picked by a bitmap of row keys
of fixed size, and no text is moved. It takes two rounds. First each set meets the one of its bands' least
sets that its sketch resembles most, so a set of a large class is compared once. Then, in bands whose members are
still in different classes, the members outside the band's largest class meet all others, and no pair that a band names is left out.

Special cases. Null and empty texts form one class; a text of fewer than five words is one shingle. Of repeated rows one
stays. A class whose ids are all null keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.common import fresh, settle, store
from tidemark.llm.components import components
from tidemark.llm.simhash import SEED, fingerprint, words_of
from tidemark.llm.simhash import links as links_of_prints

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 6
ALIKE = 0.6
PICK_BITS = 24
TEXTS = 200
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct word shingles, rising; none without words."""
    words = words_of(text)
    if len(words) < SHINGLE:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def _profile(text: str | None) -> tuple[int, int, bytes, list[int]]:
    """Node, number of shingles, sketch and bands; node 0 without words."""
    h = shingles(text)
    if not len(h):
        return 0, 0, b"", []
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for lo in range(0, len(h), 256):
        least = np.minimum(least, (h[lo:lo + 256] * _FACTORS + _SHIFTS).min(axis=1))
    bands = [xxhash.xxh64_intdigest(x.tobytes(), k) - 2**63 for k, x in enumerate(least.reshape(BANDS, ROWS))]
    sketch = (least >> np.uint64(32)).astype(np.uint8).tobytes()
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - 2**63, len(h), sketch, bands


def _key():
    """What tells rows apart, together with doc_id."""
    return F.xxhash64("doc_id", "text")


def profiles(docs: DataFrame) -> DataFrame:
    """Stored: doc_id, key, fp (node), print (SimHash fingerprint), size, sketch, bands of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                cols = zip(*(((p := _profile(t))[0], fingerprint(t), *p[1:]) for t in (x.as_py() for x in some["text"])))
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["key"], *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                                 ["doc_id", "key", "fp", "print", "size", "sketch", "bands"])
        batch = some = cols = None
        settle()
    rows = docs.select("doc_id", _key().alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key long, fp long, print long, size int, sketch binary, bands array<long>")
    return store(rows, "profiles")


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal bytes of two sketches."""
    return pd.Series([float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) for x, y in zip(a, b)], dtype=float)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored: the distinct pairs (a, b) whose sizes and sketches allow a similarity of SIMILAR, with their agreement."""
    side = lambda c: nodes.select(F.col("fp").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(
        F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))
    return store(both.select("a", "b", agreement("sa", "sb").alias("alike")).where(F.col("alike") >= ALIKE), "plausible")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar; the sets are made anew from the rows that stand for them."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = store(ends.join(nodes.select("fp", "key"), "fp"), "wanted")
    slot = F.pmod("key", F.lit(1 << PICK_BITS))
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toPandas()  # at most 2 ** (PICK_BITS - 6) rows
    picked = np.zeros(1 << PICK_BITS - 6, np.uint64)
    picked[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(picked.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch["key"].to_numpy() % (1 << PICK_BITS)
            some = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for lo in range(0, some.num_rows, TEXTS):
                part = some.slice(lo, TEXTS)
                sets = [shingles(t.as_py()).view(np.int64) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])
        batch = some = part = sets = None
        settle()

    made = docs.select(_key().alias("key"), "text").mapInArrow(run, "key long, set array<long>")
    sets = store(made.join(wanted, "key").groupBy("fp").agg(F.first("set").alias("set")), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return store(both.where(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select("a", "b"), "similar")


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, members.fp == roots.node, "left").select("band", "fp", F.coalesce("root", "fp").alias("root"))


def _across(members: DataFrame) -> DataFrame:
    """Pairs of a band's members in different classes: those outside its largest class with all others."""
    per = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = per.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("classes"))
    mixed = store(members.join(largest.where("classes > 1").select("band", "largest"), "band"), "mixed")
    few = mixed.where("root <> largest").select("band", F.col("fp").alias("one"), F.col("root").alias("other"))
    return few.join(mixed, "band").where("root <> other").select(F.least("one", "fp").alias("a"), F.greatest("one", "fp").alias("b"))


def print_links(rows: DataFrame) -> DataFrame:
    """Stored links (a, b) that join the sets of every SimHash class: of each fingerprint, its least set to its others
    and to the least set of each fingerprint that it links to."""
    pairs = store(rows.select("fp", "print").distinct(), "prints")
    least = store(pairs.groupBy("print").agg(F.min("fp").alias("least")), "least-sets")
    own = pairs.join(least, "print").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    side = lambda c: least.select(F.col("print").alias(c), F.col("least").alias(f"{c}_set"))
    near = links_of_prints(least.select(F.col("print").alias("fp"))).join(side("a"), "a").join(side("b"), "b").select(
        F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    return store(own.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                 "print-links")


def classes(docs: DataFrame, rows: DataFrame | None = None, prints: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, key, fp (of the shingle set), root, component_id.

    With ``prints`` the links of SimHash fingerprints count as well.
    """
    rows = profiles(docs) if rows is None else rows
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("size").alias("size"),
                                         F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "nodes")
    at = nodes.select("fp", F.explode("bands").alias("band"))
    met = store(at.join(at.groupBy("band").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "band"), "met")
    first = _plausible(met.where("a <> fp").select("a", F.col("fp").alias("b")), nodes)
    best = first.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a")).select("a", "b")
    links = _links(store(best, "best"), nodes, docs)
    if prints:
        links = links.unionByName(print_links(rows))
    members = _with_roots(met.select("band", "fp"), components(links))
    more = _plausible(_across(members), nodes)
    roots = components(links.unionByName(_links(more.select("a", "b"), nodes, docs)))
    named = store(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "key", "fp").join(named.join(ids, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "key", "fp", "root", "component_id")


def keep_first(docs: DataFrame, prints: bool = False) -> DataFrame:
    """One row of each class: the row with its least doc_id. Rows are found by id and key; only repeated rows are grouped."""
    found = store(classes(docs.select("doc_id", "text"), prints=prints), "found")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("key", "doc_id")).alias("row")).select("row.key", "row.doc_id")
    times = found.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    key, own, n = (fresh(docs, x) for x in ("key", "own", "times"))
    chosen = store(kept.join(times, (kept.key == times.key) & kept.doc_id.eqNullSafe(times.doc_id)).select(
        kept.key.alias(key), kept.doc_id.alias(own), times.n.alias(n)), "kept")
    keyed = docs.withColumn(fresh(docs, "row"), _key())
    here = keyed.join(chosen, (F.col(fresh(docs, "row")) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)))
    once = here.where(F.col(n) == 1).select(docs.columns)
    again = here.where(F.col(n) > 1).dropDuplicates([key, own]).select(docs.columns)
    return once.unionByName(again)

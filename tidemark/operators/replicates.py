"""Statistics of many resamples of the same rows, with one shuffle of the rows at most.

A draw is a pure function of (unit hash, replicate), so it does not depend on where a row lives, and no
row is ever copied per replicate: tasks draw for all replicates of a row at once, in arrays, and add up
vectors with one entry per replicate.

Ranking statistics take two passes over score buckets. The first sums each bucket's rows and values, which
gives what stands before a bucket; the second walks each bucket in score order from there. Every bound of
the buckets is a bucket of its own, so a score that many rows share is settled by its sums and its
rows are not moved; the buckets between hold few rows each, sorted by Spark and read as a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.operators.ranking import column_bounds

CHUNK = 1 << 20          # cells of a (rows x replicates) array
CELLS, SPREAD = 64, 6.0  # window of the permutation cut, in cells and standard deviations
BLOCK = 200              # replicates per row when vectors of many cells are summed
_ONE = np.uint64(1)


def mixed(units: np.ndarray, replicates: int, first: int = 0) -> np.ndarray:
    """A 64-bit hash per (unit hash, replicate)."""
    b = np.arange(first + 1, first + replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = units.astype(np.int64).view(np.uint64)[:, None] ^ b[None, :]
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def uniform(units: np.ndarray, replicates: int, first: int = 0) -> np.ndarray:
    return (mixed(units, replicates, first) >> np.uint64(11)) * 2.0 ** -53


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(units: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) counts, the weights of a bootstrap that draws whole units (rows x replicates)."""
    return np.searchsorted(_POISSON, uniform(units, replicates), "right").astype(float)


def _chunks(batch: pa.RecordBatch, replicates: int) -> Iterator[dict[str, np.ndarray]]:
    step = max(1, CHUNK // replicates)
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield {c: part[c].to_numpy(zero_copy_only=False) for c in part.schema.names}


def sum_vectors(df: DataFrame, keys: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """Element-wise sums of array<double> columns per integer key, one row per key."""
    schema = ", ".join([*[f"{k} int" for k in keys], *[f"{v} array<double>" for v in vectors]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(batch[k][row].as_py() for k in keys)
                values = [batch[v][row].values.to_numpy() for v in vectors]
                held[key] = [a + b for a, b in zip(held[key], values)] if key in held else values
        cols = [pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))]
        cols += [pa.array([h[i] for h in held.values()], pa.list_(pa.float64())) for i in range(len(vectors))]
        yield pa.RecordBatch.from_arrays(cols, [*keys, *vectors])
    return df.repartition(*keys).mapInArrow(run, schema)


def _emit(rows: Sequence[tuple], names: Sequence[str], keys: int) -> pa.RecordBatch:
    kinds = [pa.int32()] * keys + [pa.list_(pa.float64())] * (len(names) - keys)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


# ------------------------------------------------------------------ bootstrap
@dataclass
class Resampled:
    """Sums per replicate; those by model are models x replicates."""
    n: np.ndarray
    v: np.ndarray
    squares: np.ndarray
    errors: np.ndarray
    area: np.ndarray    # sum over tied groups of rows x (value before + half of the group's value)
    ap: np.ndarray      # sum over tied groups of value x (value so far / rows so far)
    top: np.ndarray     # value in the top share

    def roc_auc(self) -> np.ndarray:
        return (self.area - self.v ** 2 / 2) / (self.v * (self.n - self.v))

    def average_precision(self) -> np.ndarray:
        return self.ap / self.v

    def gini(self) -> np.ndarray:
        return 2 * self.area / (self.n * self.v) - 1


def _steps(n, v, before_n, before_v, target):
    """What groups in score order add to area, ap and top."""
    upto = before_n + n
    with np.errstate(divide="ignore", invalid="ignore"):
        ap = np.where(upto > 0, v * (before_v + v) / upto, 0.0)
        top = np.where((before_n < target) & (target <= upto), before_v + v * (target - before_n) / n, 0.0)
    return n * (before_v + v / 2), ap, top


def bucket_of(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Odd: equal to a bound; even: between two bounds."""
    at = np.searchsorted(bounds, scores, "left")
    if not len(bounds):
        return at
    return 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == scores)


def resample(df: DataFrame, scores: Mapping[str, str], value: str, cluster: str, replicates: int, seed: int,
             share: float = 0.1) -> Resampled:
    """All sums of a bootstrap over whole clusters. Rows with a null score or value are left out for every model."""
    names = [f"s{k}" for k in range(len(scores))]
    rows = cut(df.select(F.xxhash64(F.col(cluster), F.lit(seed)).alias("c"), F.col(value).cast("double").alias("v"),
                         *[F.col(c).cast("double").alias(s) for s, c in zip(names, scores.values())]).dropna())
    bounds = [np.array(sorted(set(b))) for b in column_bounds(rows, names)]
    models, size = range(len(names)), replicates

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2 * len(b) + 1, 2, size)) for b in bounds]
        other = np.zeros((len(names), 2, size))
        for batch in batches:
            for part in _chunks(batch, size):
                w = poisson_weights(part["c"], size)
                wv = w * part["v"][:, None]
                for k, s in enumerate(names):
                    at = bucket_of(part[s], bounds[k])
                    order = np.argsort(at, kind="stable")
                    found, start = np.unique(at[order], return_index=True)
                    sums[k][found, 0] += np.add.reduceat(w[order], start)
                    sums[k][found, 1] += np.add.reduceat(wv[order], start)
                    miss = part["v"] - part[s]
                    other[k] += (miss ** 2) @ w, np.abs(miss) @ w
        out = [(k, at, x[0], x[1]) for k in models for at, x in enumerate(sums[k]) if x[0].any()]
        yield _emit(out + [(k, -1, *other[k]) for k in models], ["model", "bucket", "n", "v"], 2)

    n_of = [np.zeros((2 * len(b) + 1, size)) for b in bounds]
    v_of, other = [x.copy() for x in n_of], np.zeros((2, len(names), size))
    parts = rows.mapInArrow(totals, "model int, bucket int, n array<double>, v array<double>")
    for r in sum_vectors(parts, ["model", "bucket"], ["n", "v"]).toLocalIterator():  # a row per model and bucket
        if r.bucket < 0:
            other[:, r.model] = r.n, r.v
        else:
            n_of[r.model][r.bucket], v_of[r.model][r.bucket] = r.n, r.v
    n, v = n_of[0].sum(0), v_of[0].sum(0)
    above = lambda x: np.cumsum(x[::-1], axis=0)[::-1] - x
    before = [(above(a), above(b)) for a, b in zip(n_of, v_of)]
    shared = rows.sparkSession.sparkContext.broadcast(([(a[::2], b[::2]) for a, b in before], share * n))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
            for k, s in enumerate(names):
                at = bucket_of(part[s], bounds[k])
                here = at % 2 == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(here.sum(), k, np.int32)), pa.array((at[here] // 2).astype(np.int32)),
                     *[pa.array(part[c][here]) for c in (s, "v", "c")]], ["model", "bucket", "s", "v", "c"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, target = shared.value
        sums, state, group = np.zeros((len(names), 3, size)), None, None

        def settle(n_g, v_g):
            """Add whole tied groups (groups x replicates) of the bucket at hand."""
            model, _, at_n, at_v = state
            upto_n, upto_v = at_n + np.cumsum(n_g, axis=0), at_v + np.cumsum(v_g, axis=0)
            for i, x in enumerate(_steps(n_g, v_g, upto_n - n_g, upto_v - v_g, target)):
                sums[model, i] += x.sum(0)
            state[2], state[3] = upto_n[-1], upto_v[-1]

        for batch in batches:
            for part in _chunks(batch, size):
                w = poisson_weights(part["c"], size)
                wv = w * part["v"][:, None]
                new = np.ones(len(w), bool)
                key = [part[c] for c in ("model", "bucket", "s")]
                new[1:] = np.any([x[1:] != x[:-1] for x in key], axis=0)
                start = np.flatnonzero(new)
                n_g, v_g = np.add.reduceat(w, start), np.add.reduceat(wv, start)
                for lo, hi in _same(key[0][start], key[1][start]):
                    here, first = (int(key[0][start[lo]]), int(key[1][start[lo]])), float(key[2][start[lo]])
                    if state is None or tuple(state[:2]) != here:
                        if group is not None:
                            settle(*group[1:])
                        model, bucket = here
                        state, group = [model, bucket, offsets[model][0][bucket], offsets[model][1][bucket]], None
                    a, b = n_g[lo:hi], v_g[lo:hi]
                    if group is not None and group[0] == first:
                        a[0] += group[1][0]
                        b[0] += group[2][0]
                    elif group is not None:
                        settle(*group[1:])
                    if hi - lo > 1:
                        settle(a[:-1], b[:-1])
                    group = float(key[2][start[hi - 1]]), a[-1:].copy(), b[-1:].copy()
        if group is not None:
            settle(*group[1:])
        yield _emit([(k, *sums[k]) for k in models], ["model", "area", "ap", "top"], 1)

    open_ = rows.mapInArrow(placed, "model int, bucket int, s double, v double, c long").repartition(
        "model", "bucket").sortWithinPartitions("model", "bucket", F.desc("s"))
    walked = open_.mapInArrow(walk, "model int, area array<double>, ap array<double>, top array<double>")
    out = np.zeros((3, len(names), size))
    for r in sum_vectors(walked, ["model"], ["area", "ap", "top"]).collect():  # a row per model
        out[:, r.model] += r.area, r.ap, r.top
    for k in models:  # scores that are bounds: the bucket is the tied group
        odd = slice(1, None, 2)
        for i, x in enumerate(_steps(n_of[k][odd], v_of[k][odd], before[k][0][odd], before[k][1][odd], share * n)):
            out[i, k] += x.sum(0)
    shared.unpersist()
    return Resampled(n, v, *other, *out)


def _same(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges in which all keys stay equal."""
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    edges = [0, *change.tolist(), len(keys[0])]
    return list(zip(edges[:-1], edges[1:]))


def interval_table(spark, models: Sequence[str], stats: Mapping[str, np.ndarray], references: Sequence[str]) -> DataFrame:
    """95 % percentile intervals per model, and of the paired differences to the named references.

    A replicate without a value (such as one without positives) is left out of that statistic.
    """
    rows = []

    def add(label, values):
        ends = [np.percentile(x[np.isfinite(x)], [2.5, 97.5]) if np.isfinite(x).any() else (np.nan, np.nan) for x in values]
        rows.append((label, int(len(values[0])), *[float(e) for pair in ends for e in pair]))

    for k, name in enumerate(models):
        add(name, [x[k] for x in stats.values()])
    for k, name in enumerate(models):
        for ref in references:
            if ref != name:
                add(f"{name} minus {ref}", [x[k] - x[models.index(ref)] for x in stats.values()])
    ends = ", ".join(f"{s}_low double, {s}_high double" for s in stats)
    return spark.createDataFrame(rows, f"model string, replicates long, {ends}")


# ------------------------------------------------------------------ permutations and A/A splits
def _unit_rows(units: DataFrame, unit: str, outcome: str, seed: int) -> DataFrame:
    return cut(units.select(F.xxhash64(F.col(unit), F.lit(seed)).alias("c"), F.col(outcome).cast("double").alias("y")).where(
        "y is not null"))


def split_sums(units: DataFrame, unit: str, outcome: str, replicates: int, share: float, seed: int) -> tuple:
    """Random arms, each unit treated with probability `share`: (n, total, treated units and their sums per replicate)."""
    rows = _unit_rows(units, unit, outcome, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, all_ = np.zeros(replicates), np.zeros(replicates), np.zeros(2)
        for batch in batches:
            for part in _chunks(batch, replicates):
                treated = uniform(part["c"], replicates) < share
                count += treated.sum(0)
                total += part["y"] @ treated
                all_ += len(part["y"]), part["y"].sum()
        yield _emit([(0, count, total, all_)], ["k", "n", "s", "all"], 1)

    found = sum_vectors(rows.mapInArrow(run, "k int, n array<double>, s array<double>, all array<double>"), ["k"], ["n", "s", "all"]).first()
    if found is None:
        return 0, 0.0, np.zeros(replicates), np.zeros(replicates)
    return int(found["all"][0]), float(found["all"][1]), np.array(found["n"]), np.array(found["s"])


def smallest_sums(units: DataFrame, unit: str, outcome: str, replicates: int, treated: int, seed: int) -> np.ndarray:
    """Per replicate, the outcome sum of the `treated` units with the smallest hash (ties by unit hash).

    The first pass counts and sums the units below a window around the expected cut and in the window's
    cells; the second sends only the units of the one cell that holds the cut. A cut outside the window falls in one of the
    two outer cells and is found the same way.
    """
    rows = _unit_rows(units, unit, outcome, seed)
    n = rows.count()
    share = treated / n if n else 0.0
    spread = SPREAD * math.sqrt(share * (1 - share) / n) if n else 0.0
    lo, width = share - spread, max(2 * spread / CELLS, 2.0 ** -50)
    cells = CELLS + 2

    def cell(c: np.ndarray, first: int, size: int) -> np.ndarray:
        return np.clip(np.floor((uniform(c, size, first) - lo) / width) + 1, 0, cells - 1).astype(np.int16)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((replicates, cells)), np.zeros((replicates, cells))
        for batch in batches:
            for part in _chunks(batch, replicates):
                at, y = cell(part["c"], 0, replicates), part["y"]
                below = at == 0
                count[:, 0] += below.sum(0)
                total[:, 0] += y @ below
                row, b = np.nonzero((at > 0) & (at < cells - 1))
                flat = b * cells + at[row, b]
                count += np.bincount(flat, minlength=count.size).reshape(count.shape)
                total += np.bincount(flat, y[row], minlength=count.size).reshape(count.shape)
                over = at == cells - 1
                count[:, -1] += over.sum(0)
                total[:, -1] += y @ over
        out = [(k, count[lo_:lo_ + BLOCK].ravel(), total[lo_:lo_ + BLOCK].ravel())
               for k, lo_ in enumerate(range(0, replicates, BLOCK))]
        yield _emit(out, ["k", "n", "s"], 1)

    count, total = np.zeros((replicates, cells)), np.zeros((replicates, cells))
    for r in sum_vectors(rows.mapInArrow(totals, "k int, n array<double>, s array<double>"), ["k"], ["n", "s"]).toLocalIterator():
        count[r.k * BLOCK:(r.k + 1) * BLOCK] = np.array(r.n).reshape(-1, cells)
        total[r.k * BLOCK:(r.k + 1) * BLOCK] = np.array(r.s).reshape(-1, cells)
    upto = count.cumsum(1)
    at_cut = (upto < treated).sum(1)  # the first cell that brings the count up to it
    ahead = np.arange(cells)[None, :] < at_cut[:, None]
    full, need = (total * ahead).sum(1), treated - (count * ahead).sum(1)
    shared = rows.sparkSession.sparkContext.broadcast(at_cut)

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value[None, :]
        for batch in batches:
            for part in _chunks(batch, replicates):
                row, b = np.nonzero(cell(part["c"], 0, replicates) == wanted)
                c = part["c"][row]
                z = np.array([], np.uint64) if not len(row) else _mixed_at(c, b)
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array((z >> _ONE).astype(np.int64)), pa.array(c),
                                                  pa.array(part["y"][row])], ["b", "z", "c", "y"])

    sent = rows.mapInArrow(edge, "b int, z long, c long, y double").withColumn(
        "r", F.row_number().over(Window.partitionBy("b").orderBy("z", "c")))
    limits = rows.sparkSession.createDataFrame([(k, int(x)) for k, x in enumerate(need)], "b int, need long")
    for r in sent.join(F.broadcast(limits), "b").where("r <= need").groupBy("b").agg(F.sum("y").alias("s")).toLocalIterator():
        full[r.b] += r.s  # a row per replicate
    return full


def _mixed_at(units: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """`mixed` for single (unit, replicate) pairs."""
    z = units.astype(np.int64).view(np.uint64) ^ ((replicate + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)

"""Histogram gradient boosting on Spark: log or Poisson loss, best-first trees with a leaf cap, L2.

Rows are binned once and stored as blocks of columns. One job per round sums gradients, Hessians and
rows per (fit, node, feature, bin): each task adds its blocks up and only these sums leave it. What is moved or held by
the driver so depends on nodes, features and bins, not on rows; beyond DIRECT tasks, reducers add the sums up first.
Of two children only the one with fewer rows is counted, the other has what the parent's sums leave. Features with few
bins share a code, so one pass over the rows counts several.

Trees grow best-first: of all leaves the one with the largest gain is split next. A round
asks for every node whose split the selection may still need, so a tree takes about as many rounds as it is
deep. Several fits (for example with and without the validation runs) share the rounds; each has its own
rows, trees and end.

A task gets a row's margin from the trees so far. Workers keep the margins of the blocks they last saw and add the new
trees only; every SETTLE trees the margins are stored with the blocks, and a worker without them starts from there and
comes to the same numbers. Sums are taken in block order, so they do not depend on the order of arrival. Rows that fill
no more than ALONE_BLOCKS blocks of BLOCK_ROWS rows (about 0.5 GB in a task) need no rounds: a task for each fit takes
them and grows the same trees, and asks for no node before it is needed. A job and its exchange take longer than
counting the rows up to there.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

BLOCK_ROWS = 750_000
KEPT_BYTES = 512 << 20
#: Blocks whose rows a task may hold to grow a fit by itself, and rows it counts in one pass (they stay in the processor's cache).
ALONE_BLOCKS, PASS_ROWS = 4, 1 << 16
#: Gains this close, as a share of what they are differences of, are equal.
TIE = 1e-11
#: Trees between two stores of the margins, and tasks whose sums the driver adds up itself.
SETTLE, DIRECT = 20, 32
#: Cells of features counted together, and bins of a feature that can be one of them.
CELLS, NARROW = 1024, 32


@dataclass(frozen=True)
class Boosting:
    loss: str                    # "log" (0/1 labels) or "poisson" (labels of at least 0)
    trees: int
    min_leaf: int
    rate: float = 0.05
    leaves: int = 15
    l2: float = 1.0
    bins: int = 255
    min_hessian: float = 1e-3

    def start(self, mean: float) -> float:
        if not 0 < mean < (1 if self.loss == "log" else math.inf):
            raise ValueError("boosting needs labels of both kinds" if self.loss == "log" else "boosting needs a positive mean")
        return math.log(mean / (1 - mean)) if self.loss == "log" else math.log(mean)

    def slopes(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss by the margin."""
        mean = self.mean(margin)
        return mean - y, mean * (1 - mean) if self.loss == "log" else mean

    def mean(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-margin)) if self.loss == "log" else np.exp(margin)


# ------------------------------------------------------------------ trees
@dataclass
class Node:
    g: float
    h: float
    n: float
    split: tuple | None = None     # (gain, feature, bin, left sums) once its histograms are known
    known: bool = False
    left: int = -1
    right: int = -1
    inner: bool = False            # chosen to be split


@dataclass
class Tree:
    """Arrays over nodes; a leaf points to itself."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(x.shape[1], np.int32), np.arange(x.shape[1])
        for _ in range(self.depth):
            at = np.where(x[self.feature[at], row] <= self.bin[at], self.left[at], self.right[at])
        return at

    def add(self, x: np.ndarray, margin: np.ndarray) -> None:
        """Add every row's value to its margin; a node looks at its own rows only."""
        open_ = [(0, np.arange(x.shape[1]))]
        while open_:
            i, rows = open_.pop()
            if self.left[i] == i:
                margin[rows] += self.value[i]
            elif len(rows):
                low = x[self.feature[i]].take(rows) <= self.bin[i]
                open_ += [(self.left[i], rows.compress(low)), (self.right[i], rows.compress(~low))]


class Growth:
    """One fit: its finished trees, and the nodes explored for the tree at work."""

    def __init__(self, cfg: Boosting, base: float, ahead: bool = True):
        self.cfg, self.base, self.trees, self.ahead = cfg, base, [], ahead
        self.restart()

    def restart(self) -> None:
        self.nodes, self.asked, self.hists = [Node(0, 0, 0)], [0], {}

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.cfg.trees

    def explored(self) -> Tree:
        """All explored nodes as a tree, so that rows find the asked ones."""
        return self._tree(lambda n: n.left >= 0)

    def _tree(self, inner) -> Tree:
        k, nodes = np.arange(len(self.nodes), dtype=np.int32), self.nodes
        split = [inner(n) for n in nodes]
        depth = np.zeros(len(nodes), int)
        for i, n in enumerate(nodes):  # children come after their parent
            if split[i]:
                depth[n.left] = depth[n.right] = depth[i] + 1
        pick = lambda f, other: np.array([f(n) if s else o for n, s, o in zip(nodes, split, other)], np.int32)
        return Tree(pick(lambda n: n.split[1], k * 0), pick(lambda n: n.split[2], k * 0), pick(lambda n: n.left, k),
                    pick(lambda n: n.right, k), np.array([-self.cfg.rate * n.g / (n.h + self.cfg.l2) for n in nodes]),
                    int(depth.max()))

    def _pairs(self) -> list[tuple[int, int, int]]:
        """(parent, child with fewer rows, other child) of the asked children; children are asked in pairs."""
        pairs, asked = [], set(self.asked)
        for i, n in enumerate(self.nodes):
            if n.left in asked:
                few, other = sorted((n.left, n.right), key=lambda k: (self.nodes[k].n, k))
                pairs.append((i, few, other))
        return pairs

    def counted(self) -> list[int]:
        """The asked nodes whose rows are added up: the root, or of two children the one with fewer rows."""
        return sorted(few for _, few, _ in self._pairs()) or self.asked

    def take(self, hists: Mapping[int, np.ndarray], sizes: np.ndarray) -> None:
        """Take the histograms (features x 3 x bins) of the counted nodes; the other child has what its parent's leave."""
        pairs = self._pairs()
        self.hists.update(hists)
        for parent, few, other in pairs:
            rest = self.hists.pop(parent)
            if few in self.hists:
                rest = rest - self.hists[few]
                rest *= rest[:, 2:] != 0  # a cell without rows has no sums, not what rounding leaves
            self.hists[other] = rest
        known = [i for i in self.asked if i in self.hists]
        if not known:
            return self.learn({})
        width = len(sizes)
        total, gain, k, left = best_of_sizes(np.array([self.hists[i] for i in known]), sizes, self.cfg)
        # The first feature on a tie: equal partings of a node differ by rounding only.
        near = TIE * (total[:, 0] ** 2 / (total[:, 1] + self.cfg.l2) + gain).reshape(-1, width)
        gains = gain.reshape(-1, width)
        best = (gains >= gains.max(axis=1, keepdims=True) - near).argmax(axis=1)
        at = np.arange(len(known)) * width + best
        self.learn({i: (tuple(t), (g, f, b, tuple(lo))) for i, t, g, f, b, lo in zip(
            known, total[at].tolist(), gain[at].tolist(), best.tolist(), k[at].tolist(), left[at].tolist())})

    def learn(self, best: Mapping[int, tuple]) -> None:
        """Take the answers for the asked nodes; then choose splits as far as they are certain."""
        for i in self.asked:
            node = self.nodes[i]
            node.known = True
            if i in best:
                total, split = best[i]
                node.g, node.h, node.n = total
                node.split = split if split[0] > 0 else None
        leaves, self.asked = self._select()
        if not self.asked:
            self.trees.append(self._tree(lambda n: n.inner))
            self.restart()

    def _select(self) -> tuple[set[int], list[int]]:
        """Leaves of the tree so far, and the nodes whose histograms it needs next (none: it is whole)."""
        nodes = self.nodes
        for n in nodes:
            n.inner = False
        leaves = {0}
        while len(leaves) < self.cfg.leaves and all(nodes[i].known for i in leaves):
            open_ = [i for i in leaves if nodes[i].split]
            if not open_:
                return leaves, []
            i = max(open_, key=lambda k: (nodes[k].split[0], -k))
            self._expand(i)
            nodes[i].inner = True
            leaves = leaves - {i} | {nodes[i].left, nodes[i].right}
        if len(leaves) >= self.cfg.leaves:
            return leaves, []
        ask = [i for i in leaves if not nodes[i].known]
        if not self.ahead:
            return leaves, sorted(ask)
        ready = sorted((i for i in leaves if nodes[i].split), key=lambda k: -nodes[k].split[0])
        for i in ready[:self.cfg.leaves - len(leaves)]:  # no other leaf can be chosen before these
            self._expand(i)
            ask += [k for k in (nodes[i].left, nodes[i].right) if not nodes[k].known]
        return leaves, sorted(ask)

    def _expand(self, i: int) -> None:
        n = self.nodes[i]
        if n.left < 0:
            _, _, _, (gl, hl, nl) = n.split
            n.left, n.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [Node(gl, hl, nl), Node(n.g - gl, n.h - hl, n.n - nl)]


# ------------------------------------------------------------------ inputs
@dataclass
class Inputs:
    """Bin edges of the numbers and levels of the categories, learned from the rows of the fits."""
    numeric: Sequence[str]
    categorical: Sequence[str]
    edges: list[np.ndarray] = field(default_factory=list)
    levels: list[list[str]] = field(default_factory=list)

    @property
    def columns(self) -> list[Column]:
        return [*[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(self.numeric)],
                *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(self.categorical)]]

    @property
    def names(self) -> list[str]:
        """Source feature of each binned column."""
        return [*self.numeric, *[c for c, ls in zip(self.categorical, self.levels) for _ in ls]]

    @property
    def sizes(self) -> np.ndarray:
        """Number of bins of each binned column."""
        return np.array([*[len(e) + 2 for e in self.edges], *[2 for ls in self.levels for _ in ls]], int)

    def binned(self, get) -> np.ndarray:
        """Bins (features x rows) of columns given by position; a missing number is above all others."""
        rows = []
        for i, e in enumerate(self.edges):
            v = get(f"_f{i}")
            rows.append(np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v, "left")).astype(np.uint8))
        for i, ls in enumerate(self.levels):
            v = get(f"_c{i}")
            rows += [(v == x).astype(np.uint8) for x in ls]
        return np.array(rows, np.uint8) if rows else np.zeros((0, 0), np.uint8)


def few_values(df: DataFrame, cols: Sequence[str], most: int) -> dict[str, list[float]]:
    """The values of each column that has at most ``most``, without missing ones; a task keeps no more than that of any column."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {c: np.zeros(0) for c in cols}
        for batch in batches:
            for c in [c for c, v in seen.items() if len(v) <= most]:
                v = _column(batch, c)
                seen[c] = np.union1d(seen[c], v[~np.isnan(v)])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[:most + 1] for v in seen.values()], pa.list_(pa.float64()))], ["c", "v"])

    if not cols:
        return {}
    union = F.slice(F.array_distinct(F.flatten(F.collect_list("v"))), 1, most + 1)
    found = df.select(*cols).mapInArrow(distinct, "c string, v array<double>").groupBy("c").agg(union.alias("v")).collect()  # a row per column
    values = {r.c: r.v for r in found}
    return {c: values.get(c, []) for c in cols if len(values.get(c, [])) <= most}


def learn_inputs(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 255) -> Inputs:
    """Edges halfway between neighbouring values where they are few, else between quantiles (one aggregate each)."""
    inputs = Inputs(numeric, categorical)
    src = cut(df.select(*inputs.columns))
    cols = [f"_f{i}" for i in range(len(numeric))]
    got = few_values(src, cols, bins - 20)
    exact, many = list(got), [c for c in cols if c not in got]
    if many:
        shares = [i / bins for i in range(1, bins)]
        got |= dict(zip(many, src.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in many]).approxQuantile(many, shares, 1 / 20_000)))
    for c in cols:
        v = np.unique(np.array(got[c], float))
        inputs.edges.append((v[1:] + v[:-1]) / 2 if c in exact else v)
    if categorical:  # one value per level of a declared domain
        inputs.levels += src.agg(*[F.array_sort(F.collect_set(f"_c{i}")) for i in range(len(categorical))]).first()
    return inputs


def _column(batch, name: str) -> np.ndarray:
    v = batch[name]
    if name.startswith("_c"):
        return np.array(v.to_pylist(), object)
    return v.to_numpy(zero_copy_only=False).astype("<i8" if name == "_m" else "<f8")


def make_blocks(df: DataFrame, inputs: Inputs, label: str, member: Sequence[Column], rows_in_all: int) -> DataFrame:
    """Stored blocks: binned columns, labels and, per fit, whether it learns from the row."""
    flags = F.lit(0)
    for k, m in enumerate(member):
        flags = flags + F.when(m, 1 << k).otherwise(0)
    rows = df.select(*inputs.columns, F.col(label).cast("double").alias("_y"), flags.cast("long").alias("_m"))
    most = BLOCK_ROWS
    if rows_in_all > ALONE_BLOCKS * most:  # several for each task of a round, so that they can be dealt evenly
        most = min(most, max(20_000, rows_in_all // (3 * df.sparkSession.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def out():
            x, y, m = (np.concatenate(v, axis=-1) for v in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:09d}-{made:06d}"]), *[pa.array([v.tobytes()]) for v in (x, y, m)]],
                                              ["block", "x", "y", "m"])
        for batch in batches:
            if batch.num_rows:
                held.append((inputs.binned(lambda c: _column(batch, c)), _column(batch, "_y"), _column(batch, "_m")))
                size += batch.num_rows
            if size >= most:
                yield out()
                held, size, made = [], 0, made + 1
        if held:
            yield out()
    return cut(rows.mapInArrow(run, "block string, x binary, y binary, m binary"))


# ------------------------------------------------------------------ one round
class Kept:
    """Blocks and margins a worker process saw last, up to a number of bytes."""

    def __init__(self):
        self.items: OrderedDict = OrderedDict()
        self.size = 0

    def get(self, key, make):
        item = self.items.pop(key, None)
        if item is None:
            item = make()
            self.size += item["bytes"]
            while self.size > KEPT_BYTES and self.items:
                self.size -= self.items.popitem(last=False)[1]["bytes"]
        self.items[key] = item
        return item


_KEPT = Kept()


def recall(key, make) -> dict:
    """What this worker process keeps (reached by name, so tasks do not carry a copy of their own)."""
    return _KEPT.get(key, make)


def _bundles(x: np.ndarray) -> list[tuple]:
    """(features, code per row, cells, marginals) of features that share one code: one pass over rows counts them together."""
    sizes = [int(v.max()) + 1 if len(v) else 1 for v in x]
    groups: list[list] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        group = next((g for g in groups if sizes[g[1]] <= NARROW and g[0] * sizes[f] <= CELLS), None)
        if group is None:
            groups.append([sizes[f], f])
        else:
            group[0] *= sizes[f]
            group.append(f)
    out = []
    for cells, *features in groups:
        code, at, parts = np.zeros(x.shape[1], np.uint16), np.arange(cells), []
        for f in features:
            code = code * np.uint16(sizes[f]) + x[f]
        for f in reversed(features):  # the bin of every feature in every cell
            parts.append((at % sizes[f])[:, None] == np.arange(sizes[f]))
            at = at // sizes[f]
        marginals = np.concatenate(parts[::-1], axis=1).astype(float) if len(features) > 1 else None
        out.append(([(f, sizes[f]) for f in features], code, cells, marginals))
    return out


def _block(row, width: int, bases: Sequence[float]) -> dict:
    x, y, m = np.frombuffer(row["x"], np.uint8), np.frombuffer(row["y"], "<f8"), np.frombuffer(row["m"], "<i8")
    x = x.reshape(width, -1)
    bundles = _bundles(x)
    return {"x": x, "y": y, "m": m, "done": [0] * len(bases), "bundles": bundles,
            "margin": [np.full(len(y), b) for b in bases], "slopes": {}, "nodes": {}, "counts": {},
            "bytes": x.size + len(y) * (2 * len(bundles) + 8 * (2 + 4 * len(bases)))}


def _rows_under(rows: dict, node: int) -> np.ndarray:
    """The rows of a node; a parted node has those of its children."""
    mine = rows[node]
    return np.concatenate([_rows_under(rows, k) for k in mine]) if isinstance(mine, tuple) else mine


def _node_rows(state: dict, fit: int, tree: Tree, count: int, asked: Sequence[int]) -> list[np.ndarray]:
    """The rows of the asked nodes, in order; the rows of a node are parted once, however many rounds its tree takes."""
    at, rows = state["nodes"].get(fit, (None, None))
    if at != count:
        rows = {0: np.flatnonzero(state["m"] >> fit & 1)}
        state["nodes"][fit] = count, rows
    parent = {int(k): i for i in range(len(tree.left)) if tree.left[i] != i for k in (tree.left[i], tree.right[i])}

    def part(node: int) -> np.ndarray:
        if node not in rows:
            up = parent[node]
            mine = part(up)
            low = state["x"][tree.feature[up]].take(mine) <= tree.bin[up]
            left, right = int(tree.left[up]), int(tree.right[up])
            rows[left], rows[right] = mine.take(np.flatnonzero(low)), mine.take(np.flatnonzero(~low))
            rows[up] = left, right
        return _rows_under(rows, node)
    return [part(node) for node in asked]


def _add_tree(state: dict, fit: int, tree: Tree, count: int, margin: np.ndarray) -> None:
    """Add the tree of this number to the margins of the fit's rows."""
    inner = np.flatnonzero(tree.left != np.arange(len(tree.left)))
    leaves = sorted({0, *tree.left[inner].tolist(), *tree.right[inner].tolist()} - set(inner.tolist()))
    for leaf, mine in zip(leaves, _node_rows(state, fit, tree, count, leaves)):
        margin[mine] += tree.value[leaf]


def _catch_up(state: dict, cfg: Boosting, fit: int, trees: Sequence[Tree]) -> None:
    if state["done"][fit] < len(trees) or fit not in state["slopes"]:
        margin, done = state["margin"][fit].copy(), state["done"][fit]
        for count in range(done, len(trees)):
            _add_tree(state, fit, trees[count], count, margin)
        state["margin"][fit], state["done"][fit] = margin, max(done, len(trees))
        state["slopes"][fit] = cfg.slopes(state["margin"][fit], state["y"])


def _count(state: dict, whole: int | None, rows: np.ndarray, g: np.ndarray, h: np.ndarray, hist: np.ndarray) -> None:
    """Add the rows to a histogram, PASS_ROWS at a time; the number of all rows of a fit (``whole``) in a cell is counted once."""
    bundles, known = state["bundles"], state["counts"].get(whole)
    sums = [np.zeros((3, cells)) for _, _, cells, _ in bundles]
    for start in range(0, len(rows), PASS_ROWS):
        some = rows[start:start + PASS_ROWS]
        weights = [g.take(some), h.take(some), None][:2 if known else 3]
        for (_, code, cells, _), total in zip(bundles, sums):
            cell = code.take(some).astype(np.intp)
            for i, w in enumerate(weights):
                total[i] += np.bincount(cell, w, cells)
    if known:
        for total, n in zip(sums, known):
            total[2] = n
    elif whole is not None:
        state["counts"][whole] = [total[2].copy() for total in sums]
    for (features, _, _, marginals), total in zip(bundles, sums):
        total, at = total if marginals is None else total @ marginals, 0
        for f, size in features:
            hist[f, :, :size] = total[:, at:at + size]
            at += size


def _sums(state: dict, cfg: Boosting, grow, bins: int, width: int):
    """(fit, asked nodes with rows, histograms as nodes x features x 3 x bins) of a block."""
    for fit, (trees, at_work, asked) in grow.items():
        _catch_up(state, cfg, fit, trees)
        g, h = state["slopes"][fit]
        parts = _node_rows(state, fit, at_work, len(trees), asked)
        nodes, parts = [n for n, p in zip(asked, parts) if len(p)], [p for p in parts if len(p)]
        if not nodes:
            continue
        out = np.zeros((len(nodes), width, 3, bins))
        for node, hist, rows in zip(nodes, out, parts):
            _count(state, fit if node == 0 else None, rows, g, h, hist)
        yield fit, nodes, out


def best_splits(hist: np.ndarray, cfg: Boosting) -> tuple[np.ndarray, ...]:
    """(sums, best gain, its bin, its left sums) of histograms (any x 3 x bins); gain 0 if no split is allowed."""
    left = hist.cumsum(axis=-1)
    total, left = left[..., -1], left[..., :-1]
    right = total[..., None] - left
    ok = ((left[:, 2] >= cfg.min_leaf) & (right[:, 2] >= cfg.min_leaf)
          & (left[:, 1] >= cfg.min_hessian) & (right[:, 1] >= cfg.min_hessian))
    gain = (left[:, 0] ** 2 / (left[:, 1] + cfg.l2) + right[:, 0] ** 2 / (right[:, 1] + cfg.l2)
            - (total[:, 0] ** 2 / (total[:, 1] + cfg.l2))[:, None])
    gain = np.where(ok, gain, 0.0)
    k = gain.argmax(axis=1)
    each = np.arange(len(k))
    return total, gain[each, k], k, left[each, :, k]


def best_of_sizes(hists: np.ndarray, sizes: np.ndarray, cfg: Boosting) -> tuple[np.ndarray, ...]:
    """``best_splits`` of (nodes x features x 3 x bins), in (node, feature) order; features with few bins are not searched to the end."""
    k, width = hists.shape[:2]
    total, gain, at, left = np.empty((k, width, 3)), np.empty((k, width)), np.empty((k, width), int), np.empty((k, width, 3))
    for of, most in ((np.flatnonzero(sizes <= NARROW), NARROW), (np.flatnonzero(sizes > NARROW), hists.shape[-1])):
        if len(of):
            found = best_splits(hists[:, of, :, :most].reshape(k * len(of), 3, -1), cfg)
            total[:, of], gain[:, of], at[:, of], left[:, of] = (v.reshape(k, len(of), *v.shape[1:]) for v in found)
    return total.reshape(-1, 3), gain.ravel(), at.ravel(), left.reshape(-1, 3)


def _alone(blocks: DataFrame, cfg: Boosting, bases: Sequence[float], width: int, bins: int, sizes: np.ndarray) -> list[list[Tree]]:
    """The trees of all fits; each fit grows in a task of its own that holds its rows of the few blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                mine = np.frombuffer(row["m"], "<i8") >> row["fit"] & 1 == 1
                held.setdefault(row["fit"], []).append((row["block"], np.frombuffer(row["x"], np.uint8).reshape(width, -1)[:, mine],
                                                        np.frombuffer(row["y"], "<f8")[mine]))
        for fit in sorted(held):
            _, *columns = zip(*sorted(held.pop(fit), key=lambda b: b[0]))
            x, y = (np.ascontiguousarray(np.concatenate(v, axis=-1)) for v in columns)
            state = _block({"x": x, "y": y, "m": np.ones(len(y), "<i8")}, width, [bases[fit]])
            growth = Growth(cfg, bases[fit], ahead=False)
            while not growth.done:
                found: dict = {}
                for _, nodes, hists in _sums(state, cfg, {0: (growth.trees, growth.explored(), growth.counted())}, bins, width):
                    found = dict(zip(nodes, hists))
                growth.take(found, sizes)
            yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([pickle.dumps(growth.trees)])], ["fit", "trees"])

    fits = blocks.select("block", "x", "y", "m", F.explode(F.array(*[F.lit(k) for k in range(len(bases))])).alias("fit"))
    grown = fits.repartitionById(len(bases), "fit").mapInArrow(run, "fit int, trees binary").collect()  # the trees of each fit
    return [pickle.loads(r["trees"]) for r in sorted(grown, key=lambda r: r["fit"])]


def _spread(blocks: DataFrame) -> RDD:
    """Kept (block, x, y, m, trees added, margins) of all blocks, dealt evenly to as many tasks as run at once."""
    sizes = {r.block: r.n for r in blocks.select("block", F.octet_length("y").alias("n")).collect()}  # a number per block
    loads, task = [0] * max(1, min(len(sizes), blocks.sparkSession.sparkContext.defaultParallelism)), {}
    for block in sorted(sizes, key=lambda b: (-sizes[b], b)):
        task[block] = loads.index(min(loads))
        loads[task[block]] += sizes[block]
    rows = blocks.select("block", "x", "y", "m").rdd.map(lambda r: (task[r.block], (r.block, bytes(r.x), bytes(r.y), bytes(r.m), None, None)))
    return rows.partitionBy(len(loads), int).values().persist(StorageLevel.MEMORY_AND_DISK)


def _state(row: tuple, name: str, width: int, bases: Sequence[float]) -> dict:
    """What this worker knows of a block: as it saw it last, or else with the margins that came with it."""
    block, x, y, m, done, margins = row

    def make() -> dict:
        state = _block({"x": x, "y": y, "m": m}, width, bases)
        if margins is not None:
            state["margin"] = list(np.frombuffer(margins, "<f8").reshape(len(bases), -1).copy())
            state["done"] = list(done)
        return state
    return recall((name, block), make)


def _settle(spread: RDD, trees: Broadcast, cfg: Boosting, bases: Sequence[float], width: int, name: str) -> RDD:
    """The blocks with margins up to these trees at least, so that a worker without them starts from there."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            state = _state(row, name, width, bases)
            for fit, grown in enumerate(trees.value):
                _catch_up(state, cfg, fit, grown)
            yield (*row[:4], list(state["done"]), np.array(state["margin"], "<f8").tobytes())

    new = spread.mapPartitions(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    new.count()
    spread.unpersist()
    return new


def _round(spread: RDD, cfg: Boosting, growths: Sequence[Growth], width: int, bins: int, sizes: np.ndarray, name: str,
           settled: Broadcast) -> dict:
    """(fit, node) -> histogram of every counted node, over all blocks."""
    grow = {k: (g.trees[len(settled.value[k]):], g.explored(), g.counted()) for k, g in enumerate(growths) if not g.done}
    bases, used = [g.base for g in growths], np.repeat((np.arange(bins) < sizes[:, None])[:, None], 3, axis=1)

    def partial(rows: Iterator[tuple]) -> Iterator[tuple]:
        sums, first = {}, None
        for row in rows:
            first = min(first or row[0], row[0])
            state, old = _state(row, name, width, bases), settled.value
            whole = {fit: (Joined(old[fit], new), tree, asked) for fit, (new, tree, asked) in grow.items()}
            for fit, nodes, hists in _sums(state, cfg, whole, bins, width):
                for node, hist in zip(nodes, hists):
                    sums[fit, node] = sums[fit, node] + hist if (fit, node) in sums else hist
        for key, hist in sums.items():
            yield key, (first, hist[used])

    parts = spread.mapPartitions(partial)
    if spread.getNumPartitions() > DIRECT:  # many tasks: their sums meet before they reach the driver
        parts = parts.groupByKey(min(DIRECT, spread.getNumPartitions())).mapValues(lambda ps: [(None, _in_order(ps))])
    else:
        parts = parts.map(lambda p: (p[0], [p[1]]))
    met: dict = {}
    for key, part in parts.collect():  # a histogram per counted node, from at most DIRECT tasks each
        met.setdefault(key, []).extend(part)
    out = {}
    for key, ps in met.items():
        out[key] = np.zeros((width, 3, bins))
        out[key][used] = _in_order(ps)
    return out


def _grow_in_rounds(blocks: DataFrame, cfg: Boosting, growths: Sequence[Growth], width: int, bins: int, sizes: np.ndarray) -> None:
    sc, bases, name = blocks.sparkSession.sparkContext, [g.base for g in growths], uuid.uuid4().hex
    spread, settled = _spread(blocks), sc.broadcast([[] for _ in growths])
    shared = [settled]  # the stored margins are made again from these if they are lost
    try:
        while not all(g.done for g in growths):
            met = _round(spread, cfg, growths, width, bins, sizes, name, settled)
            for k, g in enumerate(growths):
                if not g.done:
                    g.take({node: hist for (fit, node), hist in met.items() if fit == k}, sizes)
            count = min(len(g.trees) for g in growths)
            if count >= len(settled.value[0]) + SETTLE:  # fits may differ in their rounds; all are settled to the same tree
                settled = sc.broadcast([g.trees[:count] for g in growths])
                shared.append(settled)
                spread = _settle(spread, settled, cfg, bases, width, name)
    finally:
        spread.unpersist()
        for trees in shared:
            trees.destroy()


def _in_order(parts) -> np.ndarray:
    """The sum of (first block, histogram), in block order."""
    total = None
    for _, hist in sorted(parts, key=lambda p: p[0] or ""):
        total = hist if total is None else total + hist
    return total


class Joined(Sequence):
    """Settled trees and those grown since, by number."""

    def __init__(self, old: Sequence[Tree], new: Sequence[Tree]):
        self.old, self.new = old, new

    def __len__(self) -> int:
        return len(self.old) + len(self.new)

    def __getitem__(self, i):
        return self.old[i] if i < len(self.old) else self.new[i - len(self.old)]


# ------------------------------------------------------------------ fits and models
@dataclass
class BoostedModel:
    cfg: Boosting
    inputs: Inputs
    base: float
    trees: list[Tree]

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """df with the predicted mean in a new column."""
        cfg, inputs, base, trees = self.cfg, self.inputs, self.base, self.trees
        shared = df.sparkSession.sparkContext.broadcast((base, trees))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            start, grown = shared.value
            for frame in batches:
                x = inputs.binned(lambda c: frame[c].to_numpy(float) if c.startswith("_f") else frame[c].to_numpy(object))
                margin = np.full(len(frame), start)
                for tree in grown:
                    tree.add(x, margin)
                yield pd.Series(cfg.mean(margin))
        run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
        return df.withColumn(name, F.pandas_udf(run, "double")(F.struct(*inputs.columns)))


def fit_boosted(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, cfg: Boosting,
                member: Sequence[Column] | None = None) -> list[BoostedModel]:
    """One model per membership condition (all rows if none is given), grown in shared rounds.

    Bins and levels are those of the rows of the first fit, so it knows nothing of the others. Rows
    without a label, and rows that no fit learns from, are left out.
    """
    member = [F.lit(True)] if member is None else list(member)
    used = df.where(F.col(label).isNotNull() & F.greatest(*member, F.lit(False)))
    inputs = learn_inputs(used.where(member[0]), numeric, categorical, cfg.bins)
    means = used.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(m, F.col(label).cast("double"))).alias(f"m{k}") for k, m in enumerate(member)]).first()
    growths = [Growth(cfg, cfg.start(means[f"m{k}"] or 0.0)) for k in range(len(member))]
    blocks = make_blocks(used, inputs, label, member, means["n"]).persist()
    width, bins = len(inputs.names), cfg.bins + 2
    try:
        if means["n"] <= ALONE_BLOCKS * BLOCK_ROWS:
            for g, trees in zip(growths, _alone(blocks, cfg, [g.base for g in growths], width, bins, inputs.sizes)):
                g.trees = trees
        if not all(g.done for g in growths):
            _grow_in_rounds(blocks, cfg, growths, width, bins, inputs.sizes)
    finally:
        blocks.unpersist()
    return [BoostedModel(cfg, inputs, g.base, g.trees) for g in growths]

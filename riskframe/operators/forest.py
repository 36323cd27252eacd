"""Random forest (D2) of many deep trees.

Bootstrapped trees with Gini splits over binned features and a random subset of
sqrt(features) at each node, grown to their full depth and not pruned; a forest's
probability is the mean of its trees' leaves.  MLlib's forest passes over all rows
for each level of each tree from the root, which 1000 trees of depth 30 make too much.

Rows are binned once.  A row's copies in a tree come from a hash of its number, and a
node's features from a hash of its place in the tree, so a tree is the same however it
is grown: a table of at most ``WHOLE_BYTES`` goes to every task, which grows whole
trees; of a larger one the upper nodes are split by one grouped aggregate over
(node, feature, bin) a level, and the rows of a node of at most ``NODE_BYTES`` are
brought together and the rest of the tree below it grown there.  Grown trees are
written under the checkpoint folder and never gathered all at once.
"""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import materialize, scratch_path
from .histtrees import quantile_cuts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

WHOLE_BYTES = 64 << 20  # fixed value: binned table that goes to every task
NODE_BYTES = 16 << 20  # fixed value: binned rows of a node that one task grows on
PASS_BYTES = 512 << 20  # fixed value: binned rows shuffled at once
HIST_BYTES = 64 << 20  # fixed value: sums of a task in one pass
GROUP_BYTES = 64 << 20  # fixed value: trees that score at once
BLOCK = 1 << 16  # rows that a task works on at once
LEAF = -1
ARRAYS = "feature binary, cut binary, child binary, leaf binary"

_G, _A, _B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M = (1 << 64) - 1


def _mix(z: np.ndarray) -> np.ndarray:
    """A well spread hash of 64-bit numbers (the finisher of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def _poisson() -> np.ndarray:
    """Copies of a row in a bootstrap sample, by 16 random bits: Poisson of mean 1."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(below, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


_COPIES = _poisson()


def copies(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap sample."""
    start = int(_mix(np.array([(seed * _G + tree + 1) & _M], np.uint64))[0])
    return _COPIES[_mix(ids * np.uint64(_G) + np.uint64(start)) >> np.uint64(48)]


def _root(seed: int, tree: int) -> np.ndarray:
    return _mix(np.array([((seed + 1) * _G ^ (tree * 0xD6E8FEB86659FD93)) & _M], np.uint64))


def _below(keys: np.ndarray) -> np.ndarray:
    """Keys of the two children of each node."""
    return _mix(np.stack([keys + np.uint64(1), keys + np.uint64(2)], axis=1).ravel())


def _total(sums: np.ndarray) -> np.ndarray:
    """Sum over the last, short axis, one slot after the other (faster than along it)."""
    out = sums[..., 0].copy()
    for i in range(1, sums.shape[-1]):
        out += sums[..., i]
    return out


class Spec(NamedTuple):
    """What growing a tree needs to know, besides its rows."""
    n_features: int
    n_classes: int
    width: int  # bins of a feature at most
    subset: int  # features looked at in a node
    max_depth: int
    min_leaf: int
    weighted: bool
    seed: int

    @property
    def slots(self) -> int:
        """Numbers of a bin: the sum of each class, and the rows if they have weights."""
        return self.n_classes + self.weighted

    def features(self, keys: np.ndarray) -> np.ndarray:
        drawn = _mix(keys[:, None] + (np.arange(3, self.n_features + 3, dtype=np.uint64) * np.uint64(_G))[None, :])
        return np.sort(np.argpartition(drawn, self.subset - 1, axis=1)[:, :self.subset], axis=1) if self.subset < self.n_features \
            else np.broadcast_to(np.arange(self.n_features), drawn.shape)

    def rows_of(self, sums: np.ndarray) -> np.ndarray:
        return sums[..., -1] if self.weighted else _total(sums)

    def open(self, sums: np.ndarray, depth: int) -> np.ndarray:
        """Nodes that may be split further: of rows enough, of more than one class, above the last level."""
        c = sums[..., :self.n_classes]
        return (self.rows_of(sums) >= 2 * self.min_leaf) & ((c > 0).sum(axis=-1) > 1) & (depth < self.max_depth)


def _sums(spec: Spec, x: np.ndarray, at: np.ndarray, pos: np.ndarray, feature: np.ndarray, y: np.ndarray, n: np.ndarray,
          w: np.ndarray | None, nodes: int) -> np.ndarray:
    """Sums (node, bin, slot) of one looked-at feature a node; ``at`` are places of rows in ``x``."""
    key = (pos * spec.width + x[at * spec.n_features + feature[pos]]) * spec.slots
    size = nodes * spec.width * spec.slots
    out = np.bincount(key + y, weights=n if w is None else n * w, minlength=size)
    if w is not None:
        out += np.bincount(key + spec.n_classes, weights=n, minlength=size)
    return out.reshape(nodes, spec.width, spec.slots)


class Best:
    """The best split of each node so far, by Gini gain; the first of equal ones."""

    def __init__(self, spec: Spec, nodes: int):
        self.spec, self.gain = spec, np.full(nodes, 1e-12)
        self.feature, self.cut = np.full(nodes, LEAF, np.int16), np.zeros(nodes, np.uint8)
        self.left = np.zeros((nodes, spec.slots))

    def look(self, h: np.ndarray, feature: np.ndarray) -> None:
        spec, k = self.spec, self.spec.n_classes
        left = np.cumsum(h, axis=1)
        total = left[:, -1:, :]
        left = left[:, :-1, :]
        right = total - left
        ok = (spec.rows_of(left) >= spec.min_leaf) & (spec.rows_of(right) >= spec.min_leaf)

        def purity(s):
            c = s[..., :k]
            n = _total(c)
            return _total(c * c) / np.where(n > 0, n, 1.0)

        gain = (purity(left) + purity(right) - purity(total)) / np.maximum(_total(total[..., :k]), 1e-300)
        gain = np.where(ok, gain, -1.0)
        b = gain.argmax(axis=1)
        each = np.arange(len(b))
        better = np.flatnonzero(gain[each, b] > self.gain)
        self.gain[better], self.cut[better], self.feature[better] = gain[better, b[better]], b[better], feature[better]
        self.left[better] = left[better, b[better]]


class Tree:
    """Nodes in the order of their levels: the feature (or ``LEAF``), the last bin that goes left, the left
    child (the right one follows it), and the sums of the rows."""

    def __init__(self, sums: np.ndarray):
        self.feature, self.cut, self.child = [np.full(1, LEAF, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
        self.sums, self.size = [sums[None, :]], 1

    def add(self, sums: np.ndarray) -> np.ndarray:
        """New nodes; where they begin."""
        first, m = self.size, len(sums)
        self.feature.append(np.full(m, LEAF, np.int16))
        self.cut.append(np.zeros(m, np.uint8))
        self.child.append(np.zeros(m, np.int32))
        self.sums.append(sums)
        self.size += m
        return first

    def flat(self) -> None:
        for name in ("feature", "cut", "child", "sums"):
            setattr(self, name, [np.concatenate(getattr(self, name))])

    def arrays(self, spec: Spec) -> tuple[bytes, bytes, bytes, bytes]:
        """As bytes; a leaf's child is its place among the shares of the classes."""
        self.flat()
        f, c = self.feature[0], self.child[0].copy()
        ends = np.flatnonzero(f == LEAF)
        c[ends] = np.arange(len(ends))
        s = self.sums[0][ends, :spec.n_classes]
        n = s.sum(axis=1, keepdims=True)
        return f.tobytes(), self.cut[0].tobytes(), c.tobytes(), np.divide(s, n, out=np.full(s.shape, 1.0 / spec.n_classes), where=n > 0).tobytes()


def grow(spec: Spec, x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray | None, key: np.ndarray, depth: int) -> Tree:
    """The tree below a node whose rows are ``x`` (bins, flat), each ``n`` times, to its full depth."""
    at, n = np.flatnonzero(n), n.astype(np.float64)
    sums = np.bincount(y[at], weights=n[at] if w is None else n[at] * w[at], minlength=spec.slots)
    if w is not None:
        sums[-1] = n[at].sum()
    tree = Tree(sums)
    keys, pos = key, np.zeros(len(at), np.int64)
    front = np.arange(int(spec.open(sums, depth)))  # the level's open nodes
    sums = sums[None, :]
    step = max(1, (4 << 20) // (8 * spec.width * spec.slots))
    while len(front):
        m = len(front)
        best, looked = Best(spec, m), spec.features(keys)
        for lo in range(0, m, step):
            hi = min(m, lo + step)
            some = slice(None) if m <= step else np.flatnonzero((pos >= lo) & (pos < hi))
            a, p = at[some], pos[some] - lo
            part = Best(spec, hi - lo)
            ya, na, wa = y[a], n[a], None if w is None else w[a]
            for j in range(spec.subset):
                feature = looked[lo:hi, j]
                part.look(_sums(spec, x, a, p, feature, ya, na, wa, hi - lo), feature)
            best.feature[lo:hi], best.cut[lo:hi], best.left[lo:hi] = part.feature, part.cut, part.left
        split = np.flatnonzero(best.feature != LEAF)
        if not len(split):
            break
        depth += 1
        left = best.left[split]
        below = np.stack([left, sums[split] - left], axis=1).reshape(2 * len(split), -1)
        first = tree.add(below)
        _set(tree, front[split], best.feature[split], best.cut[split], first)
        # rows of nodes that were split go down; those in nodes that may be split again stay
        down = np.full(m, -1, np.int64)
        down[split] = np.arange(len(split)) * 2
        go = np.flatnonzero(down[pos] >= 0)
        at, pos = at[go], pos[go]
        pos = down[pos] + (x[at * spec.n_features + best.feature[pos]] > best.cut[pos])
        more = np.flatnonzero(spec.open(below, depth))
        kept = np.full(len(below), -1, np.int64)
        kept[more] = np.arange(len(more))
        pos = kept[pos]
        go = np.flatnonzero(pos >= 0)
        at, pos = at[go], pos[go]
        keys, sums, front = _below(keys[split])[more], below[more], first + more
    return tree


def _set(tree: Tree, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, first: int) -> None:
    """Splits the given nodes, all of one level; their children begin at ``first``."""
    at = 0
    for f, c, ch in zip(tree.feature, tree.cut, tree.child):
        here = np.flatnonzero((nodes >= at) & (nodes < at + len(f)))
        if len(here):
            f[nodes[here] - at], c[nodes[here] - at], ch[nodes[here] - at] = feature[here], cut[here], first + 2 * here
        at += len(f)


def _fall(x: np.ndarray, n_features: int, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, root: int = 0):
    """Where each row ends: (rows, nodes), out of order."""
    node, rows, ends = np.full(len(at), root, np.int64), at, []
    while len(rows):
        f = feature[node]
        inner = f != LEAF
        if not inner.all():
            out = np.flatnonzero(~inner)
            ends.append((rows[out], node[out]))
            inner = np.flatnonzero(inner)
            rows, node, f = rows[inner], node[inner], f[inner]
        node = child[node] + (x[rows * n_features + f] > cut[node])
    none = np.array([], np.int64)
    return (np.concatenate([e[0] for e in ends] or [none]), np.concatenate([e[1] for e in ends] or [none]))


# ---------------------------------------------------------------- rows

def _matrix(column: pa.Array, n_features: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, n_features)


def _place(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of features: the number of cuts below each value; NaN is above all."""
    out = np.empty(values.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, values[:, i], side="left")
    return out


def _few_values(n_features: int, bins: int):
    def run(batches):
        seen: list = [np.array([])] * n_features
        for batch in batches:
            v = _matrix(batch.column(0), n_features)
            for i in range(n_features):
                if seen[i] is not None:
                    seen[i] = np.unique(np.concatenate([seen[i], v[~np.isnan(v[:, i]), i]]))
                    seen[i] = seen[i] if len(seen[i]) <= bins else None
        yield pa.RecordBatch.from_arrays([pa.array(range(n_features), pa.int32()), pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))], ["i", "v"])
    return run


def feature_cuts(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Cuts of each feature (column ``x``): all its values if they are few, else quantiles and extremes;
    above the largest is only what is no number."""
    every: list = [set() for _ in range(n_features)]
    for r in rows.select("x").mapInArrow(_few_values(n_features, bins), "i int, v array<double>").collect():
        every[r.i] = None if every[r.i] is None or r.v is None else every[r.i] | set(r.v)
        every[r.i] = None if every[r.i] is not None and len(every[r.i]) > bins else every[r.i]
    many = [i for i, v in enumerate(every) if v is None]
    found = {}
    if many:
        known = rows.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"x{i}") for i in many])
        ends = known.agg(*[F.array(F.min(f"x{i}"), F.max(f"x{i}")).alias(f"x{i}") for i in many]).first()
        for i, q in zip(many, quantile_cuts(known, [f"x{i}" for i in many], bins - 1)):
            found[i] = np.unique([*ends[f"x{i}"], *q])
    return [found[i] if v is None else np.array(sorted(v), np.float64) for i, v in enumerate(every)]


def _chunked(cuts: list[np.ndarray], weighted: bool, size: int = 1024):
    """Binned rows, ``size`` a record; rows are numbered by their part and place."""
    def run(batches):
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = _place(_matrix(batch.column(0), len(cuts)), cuts)
            y = np.asarray(batch.column(1)).astype(np.uint8)
            w = np.asarray(batch.column(2), dtype=np.float64) if weighted else None
            at = range(0, len(y), size)
            yield pa.RecordBatch.from_arrays([
                pa.array([first + a for a in at], pa.int64()), pa.array([x[a:a + size].tobytes() for a in at], pa.binary()),
                pa.array([y[a:a + size].tobytes() for a in at], pa.binary()),
                pa.array([w[a:a + size].tobytes() if weighted else None for a in at], pa.binary())], ["id", "x", "y", "w"])
            first += len(y)
    return run


def _joined(ids, xs, ys, ws, weighted: bool):
    """Arrays of several records: numbers of the rows, bins, classes, weights."""
    y = [np.frombuffer(b, np.uint8) for b in ys]
    return (np.concatenate([np.arange(i, i + len(c), dtype=np.uint64) for i, c in zip(ids, y)]), np.frombuffer(b"".join(xs), np.uint8),
            np.concatenate(y), np.frombuffer(b"".join(ws), np.float64) if weighted else None)


def _blocks(batches, weighted: bool):
    held, n = [], 0
    for batch in batches:
        for r in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            held.append(r)
            n += len(r[2])
            if n >= BLOCK:
                yield _joined(*zip(*held), weighted)
                held, n = [], 0
    if held:
        yield _joined(*zip(*held), weighted)


# ---------------------------------------------------------------- growing

def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["tree", "node", "feature", "cut", "child", "leaf"])


def _whole_trees(spec: Spec, data):
    def run(batches):
        ids, x, y, w = data.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield _tree_batch([(t, 0, *grow(spec, x, y, copies(ids, spec.seed, t), w, _root(spec.seed, t), 0).arrays(spec))])
    return run


def _reached(spec: Spec, tops: list[tuple], ids, x):
    """Of each tree the rows that come to nodes of the pass: (rows, places, copies).  ``tops`` has of each
    tree its number, its upper nodes, and by node its place among those of the pass (or -1)."""
    for tree, feature, cut, child, places in tops:
        n = copies(ids, spec.seed, tree)
        at, node = _fall(x, spec.n_features, np.flatnonzero(n), feature, cut, child)
        place = places[node]
        here = np.flatnonzero(place >= 0)
        if len(here):
            yield at[here], place[here], n[at[here]]


def _partial_sums(spec: Spec, tops, looked: np.ndarray, per: int):
    """Sums of the nodes of a pass over a task's rows, ``per`` nodes a record."""
    def run(batches):
        m = len(looked.value)
        h = np.zeros((m, spec.subset, spec.width, spec.slots))
        for ids, x, y, w in _blocks(batches, spec.weighted):
            for at, place, n in _reached(spec, tops.value, ids, x):
                lo, hi = place.min(), place.max() + 1  # the nodes of a tree are neighbours
                for j in range(spec.subset):
                    feature = looked.value[lo:hi, j]
                    h[lo:hi, j] += _sums(spec, x, at, place - lo, feature, y[at], n.astype(np.float64), None if w is None else w[at], hi - lo)
        for b, lo in enumerate(range(0, m, per)):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([h[lo:lo + per].tobytes()], pa.binary())], ["b", "h"])
    return run


def _best_splits(spec: Spec, looked, per: int):
    def run(key, table):
        b, h = key[0].as_py(), 0.0
        for one in table.column("h"):
            h = h + np.frombuffer(one.as_buffer(), np.float64)
        feature = looked.value[b * per:(b + 1) * per]
        h = h.reshape(len(feature), spec.subset, spec.width, spec.slots)
        best = Best(spec, len(feature))
        for j in range(spec.subset):
            best.look(h[:, j], feature[:, j])
        return pa.table([pa.array([b], pa.int32()), pa.array([best.feature.tobytes()], pa.binary()), pa.array([best.cut.tobytes()], pa.binary()),
                         pa.array([best.left.tobytes()], pa.binary())], ["b", "feature", "cut", "l"])
    return run


def _rows_of_nodes(spec: Spec, tops):
    """The rows of each node of a pass, a record for a block of a task's rows."""
    names = ["place", "id", "x", "y", "n", "w"]

    def run(batches):
        for ids, x, y, w in _blocks(batches, spec.weighted):
            rows = x.reshape(-1, spec.n_features)
            for at, place, n in _reached(spec, tops.value, ids, x):
                order = np.lexsort((at, place))
                at, place, n = at[order], place[order], n[order]
                edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(at)]
                for lo, hi in zip(edges, edges[1:]):
                    a = at[lo:hi]
                    one = [int(place[lo]), int(ids[a[0]]), rows[a].tobytes(), y[a].tobytes(), n[lo:hi].tobytes(), None if w is None else w[a].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, [pa.int32(), pa.int64()] + [pa.binary()] * 4)], names)
    return run


def _lower_trees(spec: Spec, nodes):
    """Grows the trees below the nodes of a pass; ``nodes``: (tree, node, key, depth)."""
    def run(key, table):
        tree, node, k, depth = nodes.value[key[0].as_py()]
        table = table.sort_by("id")
        xs, ys, ns, ws = (table.column(c).to_pylist() for c in ("x", "y", "n", "w"))
        at = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
        t = grow(spec, at(xs, np.uint8), at(ys, np.uint8), at(ns, np.uint8), at(ws, np.float64) if spec.weighted else None, np.array([k], np.uint64), depth)
        return pa.Table.from_batches([_tree_batch([(tree, node, *t.arrays(spec))])])
    return run


def _first_sums(spec: Spec, trees: int):
    def run(batches):
        out = np.zeros((trees, spec.slots))
        for ids, _, y, w in _blocks(batches, spec.weighted):
            for t in range(trees):
                n = copies(ids, spec.seed, t).astype(np.float64)
                out[t, :spec.n_classes] += np.bincount(y, weights=n if w is None else n * w, minlength=spec.n_classes)
                if w is not None:
                    out[t, -1] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], ["t", "s"])
    return run


def _freed(spark: SparkSession, *shared) -> None:
    """Shuffle files and broadcast values of a pass that is over are given back."""
    for b in shared:
        b.destroy()
    spark.sparkContext._jvm.System.gc()


def _grow_in_parts(spec: Spec, n_trees: int, chunks: DataFrame, path: str, node_bytes: int, pass_bytes: int, hist_bytes: int) -> None:
    """Trees over a table of any size: upper nodes by sums, the rest where a node's rows meet."""
    spark, sc = chunks.sparkSession, chunks.sparkSession.sparkContext
    row = spec.n_features + 2 + 8 * spec.weighted
    start = np.zeros((n_trees, spec.slots))
    for r in chunks.mapInArrow(_first_sums(spec, n_trees), "t int, s array<double>").groupBy("t").agg(
            F.array(*[F.sum(F.col("s")[i]) for i in range(spec.slots)]).alias("s")).collect():
        start[r.t] = r.s
    trees = [Tree(s) for s in start]
    small: list[tuple[int, int, int, int, float]] = []  # tree, node, key, depth, rows
    level = [(t, 0, int(_root(spec.seed, t)[0]), trees[t].sums[0][0]) for t in range(n_trees)]
    depth = 0

    def shared(nodes):
        """The upper trees of a pass, its nodes being (tree, node, ...) in the order of the trees."""
        by: dict[int, list[tuple[int, int]]] = {}
        for i, one in enumerate(nodes):
            by.setdefault(one[0], []).append((i, one[1]))
        tops = []
        for t, some in by.items():
            trees[t].flat()
            place = np.full(trees[t].size, -1, np.int64)
            place[[node for _, node in some]] = [i for i, _ in some]
            tops.append((t, trees[t].feature[0], trees[t].cut[0], trees[t].child[0], place))
        return sc.broadcast(tops)

    while level:
        live = [one for one in level if spec.open(one[3], depth)]
        rows = [float(spec.rows_of(one[3])) for one in live]
        small += [(*one[:3], depth, r) for one, r in zip(live, rows) if r * row <= node_bytes]
        big, level = [one for one, r in zip(live, rows) if r * row > node_bytes], []
        cell = 8 * spec.subset * spec.width * spec.slots
        most, per = max(1, hist_bytes // cell), max(1, (1 << 20) // cell)
        for lo in range(0, len(big), most):
            nodes = big[lo:lo + most]
            keys = np.array([k for _, _, k, _ in nodes], np.uint64)
            tops, looked = shared(nodes), sc.broadcast(np.ascontiguousarray(spec.features(keys)))
            sums = chunks.mapInArrow(_partial_sums(spec, tops, looked, per), "b int, h binary")
            found = sums.groupBy("b").applyInArrow(_best_splits(spec, looked, per), "b int, feature binary, cut binary, l binary").collect()
            found.sort(key=lambda r: r.b)
            feature, cut = np.frombuffer(b"".join(r.feature for r in found), np.int16), np.frombuffer(b"".join(r.cut for r in found), np.uint8)
            left, below = np.frombuffer(b"".join(r.l for r in found), np.float64).reshape(len(nodes), -1), _below(keys)
            for i in np.flatnonzero(feature != LEAF).tolist():
                t, node, _, total = nodes[i]
                first = trees[t].add(np.stack([left[i], total - left[i]]))
                _set(trees[t], np.array([node]), feature[i:i + 1], cut[i:i + 1], first)
                level += [(t, first + k, int(below[2 * i + k]), trees[t].sums[-1][k]) for k in (0, 1)]
            _freed(spark, tops, looked)
        depth += 1
        level.sort(key=lambda one: one[:2])
    small.sort(key=lambda one: one[:2])
    while small:
        held, size = [], 0.0
        while small and (not held or size + small[0][4] * row <= pass_bytes):
            held.append(small.pop(0))
            size += held[-1][4] * row
        tops, nodes = shared(held), sc.broadcast([one[:4] for one in held])
        together = chunks.mapInArrow(_rows_of_nodes(spec, tops), "place int, id long, x binary, y binary, n binary, w binary")
        together.groupBy("place").applyInArrow(_lower_trees(spec, nodes), f"tree int, node int, {ARRAYS}").write.mode("append").parquet(path)
        _freed(spark, tops, nodes)
    upper = [(t, -1, *map(bytearray, tree.arrays(spec))) for t, tree in enumerate(trees)]
    spark.createDataFrame(upper, f"tree int, node int, {ARRAYS}").write.mode("append").parquet(path)


# ---------------------------------------------------------------- estimator and model

def _wrong() -> Column:
    """Rows whose class is no whole number from 0 to 255 or whose weight is no number of 0 or more."""
    y, w = F.col("y"), F.col("w")
    return y.isNull() | F.isnan(y) | (y < 0) | (y > 255) | (y != F.floor(y)) | w.isNull() | F.isnan(w) | (w < 0)


class RandomForest:
    """Estimator with the columns of MLlib's; ``fit`` gives a model whose ``transform`` adds
    rawPrediction, probability and prediction."""

    def __init__(self, features: str, label: str, weight: str | None, n_trees: int, max_depth: int, min_leaf: int, seed: int,
                 bins: int = 32, whole_bytes: int = WHOLE_BYTES, node_bytes: int = NODE_BYTES, pass_bytes: int = PASS_BYTES, hist_bytes: int = HIST_BYTES):
        self.features, self.label, self.weight = features, label, weight
        self.n_trees, self.max_depth, self.min_leaf, self.seed, self.bins = n_trees, max_depth, min_leaf, seed, bins
        self.limits = whole_bytes, node_bytes, pass_bytes, hist_bytes

    def fit(self, df: DataFrame) -> RandomForestModel:
        spark, whole_bytes, *limits = df.sparkSession, *self.limits
        y, w = F.col(self.label).cast("double"), F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array(self.features).alias("x"), y.alias("y"), w.alias("w"))
        r = rows.agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max(F.size("x")).alias("f"), F.count_if(_wrong()).alias("wrong")).first()
        if not r.n or r.wrong:
            raise ValueError(f"{r.n} training rows, {r.wrong} of them without a class from 0 to 255 or a weight of 0 or more")
        cuts = feature_cuts(rows, r.f, self.bins)
        spec = Spec(r.f, max(2, int(r.y) + 1), max(map(len, cuts)) + 1, math.ceil(math.sqrt(r.f)), self.max_depth, self.min_leaf, bool(self.weight), self.seed)
        chunks = rows.mapInArrow(_chunked(cuts, spec.weighted), "id long, x binary, y binary, w binary")
        tasks = spark.sparkContext.defaultParallelism
        path = scratch_path(spark, "forest")
        if r.n * (r.f + 9 + 8 * spec.weighted) <= whole_bytes:
            held = sorted(chunks.collect(), key=lambda c: c.id)
            data = spark.sparkContext.broadcast(_joined(*zip(*held), spec.weighted))
            numbers = spark.range(0, self.n_trees, 1, min(self.n_trees, 8 * tasks))
            numbers.mapInArrow(_whole_trees(spec, data), f"tree int, node int, {ARRAYS}").write.parquet(path)
            data.destroy()
        else:
            _grow_in_parts(spec, self.n_trees, materialize(chunks.repartition(max(tasks, int(r.n // 500_000))), "binned"), path, *limits)
        return RandomForestModel(spark, path, spec, cuts, self.n_trees, self.features)


def _one_array(parts: list, n_classes: int):
    """A tree's arrays: its upper nodes, and in their open ends the trees grown below them."""
    parts.sort(key=lambda p: p.node)
    read = lambda p: (np.frombuffer(p.feature, np.int16), np.frombuffer(p.cut, np.uint8), np.frombuffer(p.child, np.int32),
                      np.frombuffer(p.leaf, np.float64).reshape(-1, n_classes))
    if len(parts) == 1:
        return read(parts[0])
    nodes = leaves = 0
    out: list[list[np.ndarray]] = [[], [], [], []]
    roots = []
    for p in parts:
        f, c, ch, leaf = read(p)
        roots.append((p.node, nodes))
        for to, v in zip(out, (f, c, ch + np.where(f == LEAF, leaves, nodes).astype(np.int32), leaf)):
            to.append(v)
        nodes, leaves = nodes + len(f), leaves + len(leaf)
    f, c, ch, leaf = map(np.concatenate, out)
    for node, root in roots[1:]:
        f[node], c[node], ch[node] = f[root], c[root], ch[root]
    return f, c, ch, leaf


class RandomForestModel:
    """Trees in a table (tree, node they hang at or -1 for the upper nodes, arrays)."""

    def __init__(self, spark: SparkSession, path: str, spec: Spec, cuts: list[np.ndarray], n_trees: int, features: str):
        self.spark, self.path, self.spec, self.cuts, self.n_trees, self.features = spark, path, spec, cuts, n_trees, features

    def _groups(self, group_bytes: int) -> list[tuple[int, int]]:
        """First and last trees of groups that score at once."""
        size = F.sum(F.length("feature") + F.length("cut") + F.length("child") + F.length("leaf"))
        out, held = [], 0
        for r in sorted(self.spark.read.parquet(self.path).groupBy("tree").agg(size.alias("n")).collect()):
            if not out or held + r.n > group_bytes:
                out.append((r.tree, r.tree))
                held = 0
            out[-1], held = (out[-1][0], r.tree), held + r.n
        return out

    def trees(self, first: int = 0, last: int | None = None) -> list[tuple]:
        """(feature, cut, child, leaf) of each tree of a group."""
        by: dict[int, list] = {}
        for r in self.spark.read.parquet(self.path).where(F.col("tree").between(first, self.n_trees - 1 if last is None else last)).collect():
            by.setdefault(r.tree, []).append(r)
        return [_one_array(by[t], self.spec.n_classes) for t in sorted(by)]

    def transform(self, df: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
        groups, k = self._groups(group_bytes), self.spec.n_classes
        cur = df.withColumn("_votes", F.array(*[F.lit(0.0)] * k))
        for i, (first, last) in enumerate(groups):
            cur = cur.withColumn("_votes", self._voted(first, last)(vector_to_array(self.features), F.col("_votes")))
            if i + 1 < len(groups):
                cur = materialize(cur, "votes")
        share = F.transform("_votes", lambda v: v / F.lit(float(self.n_trees)))
        return cur.withColumns({"rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(share),
                                "prediction": (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")}).drop("_votes")

    def _voted(self, first: int, last: int):
        shared, cuts, m, k = self.spark.sparkContext.broadcast(self.trees(first, last)), self.cuts, self.spec.n_features, self.spec.n_classes

        @F.pandas_udf("array<double>")
        def votes(x, before):
            import pandas as pd

            bins = _place(np.stack(x.to_numpy()), cuts).ravel() if len(x) else np.array([], np.uint8)
            out = np.stack(before.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, k))
            for feature, cut, child, leaf in shared.value:
                rows, node = _fall(bins, m, np.arange(len(out)), feature, cut, child)
                out[rows] += leaf[child[node]]
            return pd.Series(list(out))
        return votes

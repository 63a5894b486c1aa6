"""Regression trees on a bounded group of rows: exact splits, a whole level of all nodes in each numpy step."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np


#: Values of features that are taken at once: few rows have many features in each numpy step.
AT_ONCE = 1 << 14


@dataclass
class Tree:
    """Nodes in order of depth. A leaf is its own child, so that rows may be sent on for as long as the tree is deep."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The value of the leaf of each row; x: features by rows."""
        node, row = np.zeros(x.shape[1], np.int32), np.arange(x.shape[1])
        for _ in range(self.depth):
            node = np.where(x[self.feature[node], row] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[node]


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """Row numbers by each feature."""
    return np.argsort(x, axis=1, kind="stable").astype(np.int32)


def _best_splits(x: np.ndarray, wy: np.ndarray, w: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, found) of each node: the split with the least squared error, halfway between two values; equal
    ones go to the first feature and the smallest value. Rows of `order` are grouped by node, from `begin` on."""
    nodes, n = len(begin), order.shape[1]
    end = begin + size - 1
    gains, places = np.empty((len(x), nodes)), np.empty((len(x), nodes), np.int64)
    step = max(1, AT_ONCE // n)
    for lo in range(0, len(x), step):  # some features at once, each summed by itself
        rows = order[lo : lo + step]
        some = np.arange(len(rows))[:, None]
        values = x[lo + some, rows]
        lw, ls = np.cumsum(w.take(rows), axis=1), np.cumsum(wy.take(rows), axis=1)
        up_to_w, up_to_s = lw[:, end], ls[:, end]
        lw -= np.repeat(np.pad(up_to_w[:, :-1], ((0, 0), (1, 0))), size, axis=1)
        ls -= np.repeat(np.pad(up_to_s[:, :-1], ((0, 0), (1, 0))), size, axis=1)
        rw, rs = np.repeat(lw[:, end], size, axis=1), np.repeat(ls[:, end], size, axis=1)
        rw -= lw
        rs -= ls
        open_ = np.empty(values.shape, bool)
        np.less(values[:, :-1], values[:, 1:], out=open_[:, :-1])
        open_[:, end] = False
        rw[~open_] = 1.0
        gain = ls * ls
        gain /= lw
        rs *= rs
        rs /= rw
        gain += rs
        gain[~open_] = -np.inf
        most = np.maximum.reduceat(gain, begin, axis=1)
        at = np.flatnonzero(gain == np.repeat(most, size, axis=1))
        gains[lo : lo + step] = most
        places[lo : lo + step] = at[np.searchsorted(at, some * n + begin)] - some * n
    best = gains.argmax(axis=0)
    at = places[best, np.arange(nodes)]
    low, high = x[best, order[best, at]], x[best, order[best, np.minimum(at + 1, n - 1)]]
    between = low + (high - low) / 2
    threshold = np.where(between < high, between, low)  # neighbouring doubles have nothing between them
    return best, threshold, gains.max(axis=0) > -np.inf


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: np.ndarray, depth: int | None = None) -> Tree:
    """A tree of the rows in order (features by rows, from sorted_rows(), rows of no weight left out), without a bound on
    its depth if there is none: nodes of one row, of one target, or without two different values of a feature are leaves."""
    parts, offset, level, wy = [], 0, 0, w * y
    begin, size = np.zeros(1, np.int64), np.array([order.shape[1]])
    while len(begin):
        rows = order[0]
        weights = w[rows]
        value = np.add.reduceat(wy[rows], begin) / np.add.reduceat(weights, begin)
        nodes = len(begin)
        open_ = (size > 1) & (np.maximum.reduceat(y[rows], begin) > np.minimum.reduceat(y[rows], begin))
        feature, threshold = np.zeros(nodes, np.int32), np.zeros(nodes)
        if (depth is None or level < depth) and open_.any():
            order, begin, size = _kept(order, size, open_)
            best, cut, found = _best_splits(x, wy, w, order, begin, size)
            if not found.all():
                order, begin, size = _kept(order, size, found)
                open_[np.flatnonzero(open_)[~found]] = False
                best, cut = best[found], cut[found]
        else:
            open_[:] = False
        child = np.arange(nodes) + offset
        left, right = child.copy(), child.copy()
        split = np.flatnonzero(open_)
        offset += nodes
        if len(split):
            feature[split], threshold[split] = best, cut
            left[split], right[split] = offset + 2 * np.arange(len(split)), offset + 2 * np.arange(len(split)) + 1
            order, begin, size = _parted(x, order, begin, size, best, cut)
        else:
            begin = begin[:0]
        parts.append((feature, threshold, left, right, value))
        level += 1
    return Tree(*(np.concatenate(p) for p in zip(*parts, strict=True)), depth=level - 1)


def _kept(order: np.ndarray, size: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the nodes that stay."""
    if not stay.all():
        order, size = order[:, np.repeat(stay, size)], size[stay]
    return order, np.cumsum(size) - size, size


def _parted(x: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows dealt to the two children of each node, in the same order within each."""
    node = np.repeat(np.arange(len(begin)), size)
    rows = order[0]
    goes_left = np.zeros(x.shape[1], bool)
    goes_left[rows] = x[feature[node], rows] <= threshold[node]
    n_left = np.add.reduceat(goes_left[rows].astype(np.int64), begin)
    out, before = np.empty_like(order), np.cumsum(n_left) - n_left
    to_left = np.repeat((begin - before - 1).astype(np.int32), size)
    place = np.arange(order.shape[1], dtype=np.int32) + np.repeat((n_left + before).astype(np.int32), size)
    step = max(1, AT_ONCE // order.shape[1])
    for lo in range(0, len(order), step):
        rows = order[lo : lo + step]
        left = goes_left.take(rows)
        seen = np.cumsum(left, axis=1, dtype=np.int32)
        # a left row goes to its node's begin plus the left rows before it, a right one behind all the left ones
        np.put_along_axis(out[lo : lo + step], np.where(left, seen + to_left, place - seen), rows, axis=1)
    both = np.column_stack([n_left, size - n_left]).ravel()
    return out, np.cumsum(both) - both, both


def forest(x: np.ndarray, y: np.ndarray, trees: int, seed: tuple[int, ...]) -> list[Tree]:
    """Trees of bootstrap samples."""
    order, out = sorted_rows(x), []
    for k in range(trees):
        w = np.bincount(np.random.default_rng((*seed, k)).integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        drawn = w > 0
        out.append(grow(x, y, w, order[drawn[order]].reshape(len(x), -1)))
    return out


def boosting(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int) -> list[Tree]:
    """Trees whose sum predicts: the mean, and `rounds` trees of the residuals, each at `rate`."""
    order, w, root = sorted_rows(x), np.ones(len(y)), np.zeros(1, np.int32)
    now, out = np.full(len(y), y.mean()), [Tree(root, np.zeros(1), root, root, np.array([y.mean()]), 0)]
    for _ in range(rounds):
        tree = grow(x, y - now, w, order, depth)
        tree.value = rate * tree.value
        now = now + tree.predict(x)
        out.append(tree)
    return out


def boosted(x: np.ndarray, y: np.ndarray, new: np.ndarray, rounds: int, rate: float, depth: int) -> np.ndarray:
    """Predictions for new rows of boosting()."""
    return sum(tree.predict(new) for tree in boosting(x, y, rounds, rate, depth))


def _numbers(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different items, and each one's number among them in the smallest type that holds it."""
    kinds, at = np.unique(items, return_inverse=True)
    return kinds, at.astype(np.min_scalar_type(max(len(kinds), 1)))


def pack(trees: list[Tree]) -> bytes:
    """Trees in few bytes for Groves: nodes are in order of depth and the two children of the k-th that splits are 1 + 2k and
    2 + 2k, so it takes a bit to say which split, their features and thresholds, and the values of the leaves."""
    leaf = np.concatenate([t.left == np.arange(len(t.left)) for t in trees])
    feature, threshold, value = (np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "threshold", "value"))
    thresholds, cut = _numbers(threshold[~leaf])
    values, of_leaf = _numbers(value[leaf])
    which = feature[~leaf]
    out = io.BytesIO()
    np.savez(out, nodes=[len(t.left) for t in trees], depth=[t.depth for t in trees], leaf=np.packbits(leaf), feature=which.astype(np.min_scalar_type(int(which.max(initial=0)))), thresholds=thresholds, cut=cut, values=values, of_leaf=of_leaf)
    return out.getvalue()


class Groves:
    """Packed trees by name, whose sums are taken over many rows at once.

    A row's value of a feature becomes its number among all the trees' thresholds, once for all trees; each step of all
    rows through a tree then compares small numbers, and rows that have reached a leaf drop out."""

    #: Levels before the first look for rows at a leaf, and between two.
    FIRST, EVERY = 8, 4

    def __init__(self, packed: dict[str, list[bytes]], n_features: int):
        nodes, depth, self.name, leaf, feature, threshold, value = [], [], [], [], [], [], []
        for name, parts in packed.items():
            for data in parts:
                z = np.load(io.BytesIO(data))
                nodes.append(z["nodes"])
                depth.append(z["depth"])
                self.name += [name] * len(z["nodes"])
                leaf.append(np.unpackbits(z["leaf"], count=int(z["nodes"].sum())).astype(bool))
                feature.append(z["feature"].astype(np.int32))
                threshold.append(z["thresholds"][z["cut"]])
                value.append(z["values"][z["of_leaf"]])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.names, self.depth, self.leaf, self.value = list(packed), join(depth, int), join(leaf, bool), join(value, float)
        self.begin = np.concatenate([[0], np.cumsum(join(nodes, int))])
        self.splits = np.concatenate([[0], np.cumsum(~self.leaf)])[self.begin]
        self.feature, threshold = join(feature, np.int32), join(threshold, float)
        self.thresholds, code = [], np.zeros(len(threshold), np.uint32)
        for f in range(n_features):
            own = np.flatnonzero(self.feature == f)
            kinds, code[own] = np.unique(threshold[own], return_inverse=True)
            self.thresholds.append(kinds)
        self.kind = np.min_scalar_type(max((len(t) for t in self.thresholds), default=0) + 1)
        self.code = code.astype(self.kind)

    def sums(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The sum of the trees of each name for each row; x: rows by features."""
        n, p = x.shape
        coded = np.empty((n, p), self.kind)
        for f, kinds in enumerate(self.thresholds):
            coded[:, f] = np.searchsorted(kinds, x[:, f])
        flat, first, out = coded.ravel(), np.arange(n) * p, {name: np.zeros(n) for name in self.names}
        for k, name in enumerate(self.name):
            out[name] += self._one(k, flat, first)
        return out

    def _one(self, k: int, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The values of tree k."""
        (a, b), (c, d) = self.begin[k : k + 2], self.splits[k : k + 2]
        leaf = self.leaf[a:b]
        split = np.flatnonzero(~leaf)
        feature, left, code, value = np.zeros(b - a, int), np.arange(b - a), np.full(b - a, np.iinfo(self.kind).max, self.kind), np.zeros(b - a)
        feature[split], left[split], code[split], value[leaf] = self.feature[c:d], 1 + 2 * np.arange(d - c), self.code[c:d], self.value[a - c : b - d]
        node, row, out = np.zeros(len(first), int), None, np.empty(len(first))
        for level in range(self.depth[k]):
            at = feature.take(node, mode="clip")
            at += first
            right = flat.take(at, mode="clip") > code.take(node, mode="clip")
            node = left.take(node, mode="clip")
            node += right
            if level >= self.FIRST and level % self.EVERY == 0:
                row = np.arange(len(first)) if row is None else row
                done = leaf.take(node)
                out[row[done]] = value[node[done]]
                on = np.flatnonzero(~done)
                node, row, first = node[on], row[on], first[on]
                if not len(on):
                    break
        out[slice(None) if row is None else row] = value[node]
        return out

"""Growing regression trees from sums over bins (numpy; no Spark here).

Rows are bytes: the bin of every feature.  To split a node one needs, for each feature and
bin, the number of rows, their weight and the sum of their targets: its *cells*.  Cells of
several blocks of rows add up, so the same code grows a tree from one block or from sums
that Spark has made over many.

A split sends rows of bins up to ``cut`` left; its gain is the fall of the penalised squared
error, S^2 / (W + l2) summed over the children less that of the node.  Gains that agree to
rounding count as equal: the first feature and the lowest cut win.  Trees grow level by
level; with ``max_leaves`` they grow leaf by leaf, the leaf with the largest gain first.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Bins of a feature; a missing value has the bin after the last.
MAX_BINS = 255
MISSING = 255
#: Gains that differ by less than this share of the node's squares are equal.
TIE = 1e-10


@dataclass(frozen=True)
class Rule:
    """When a node may be split and what its value is."""
    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    l2: float = 0.0
    max_leaves: int | None = None

    def __post_init__(self):
        if self.min_leaf < 1 or self.min_split < 2 or self.l2 < 0 or (self.max_leaves or 2) < 2 or (self.max_depth or 0) < 0:
            raise ValueError(f"no tree can grow by {self}")


@dataclass
class Tree:
    """Nodes in the order they were made, the root first; a left child's neighbour is the right one."""
    feature: np.ndarray   # -1: leaf
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    n: np.ndarray
    depth: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, self.feature[here]] > self.cut[here])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]

    def truncated(self, bins: np.ndarray, variants: list[tuple[int | None, int]]) -> np.ndarray:
        """Predictions (variants x rows) of the trees that the same rows and rule would have
        given with a smaller (max_depth, min_split): a row stops at the first node on its way
        that is too deep or too small to split."""
        out = np.empty((len(variants), len(bins)))
        at = np.zeros(len(bins), dtype=np.int64)
        stopped = np.zeros((len(variants), len(bins)), dtype=bool)
        rows = np.arange(len(bins))
        while len(rows):
            here = at[rows]
            ends = self.feature[here] < 0
            for v, (depth, least) in enumerate(variants):
                stop = ends | (self.n[here] < least)
                if depth is not None:
                    stop |= self.depth[here] >= depth
                stop &= ~stopped[v, rows]
                out[v, rows[stop]] = self.value[here[stop]]
                stopped[v, rows[stop]] = True
            rows = rows[~ends]
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, self.feature[here]] > self.cut[here])
        return out


def cells(bins: np.ndarray, node: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, n, w, s) of the cells that have rows, by key; key counts node, feature and bin up."""
    rows, features = bins.shape
    base = np.arange(features, dtype=np.int64) * 256
    key = ((node.astype(np.int64) * (features * 256))[:, None] + base + bins).ravel()
    many = int(node.max(initial=0) + 1) * features * 256
    ws, ss = np.repeat(weight, features), np.repeat(weight * target, features)
    if many <= 4 * len(key) + 4096:
        n = np.bincount(key, minlength=many)
        at = np.flatnonzero(n)
        return at, n[at], np.bincount(key, ws, many)[at], np.bincount(key, ss, many)[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.diff(np.append(head, len(key))), np.add.reduceat(ws[order], head), np.add.reduceat(ss[order], head)


def best_splits(key: np.ndarray, n: np.ndarray, w: np.ndarray, s: np.ndarray, features: int, rule: Rule) -> tuple[np.ndarray, ...]:
    """From cells in order: for each node that has any, (node, feature, cut, gain, n, w, s), the
    last three those of the left child; feature -1 where no split is allowed or gains anything."""
    column, node = key >> 8, key // (features * 256)
    head = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    size = np.diff(np.append(head, len(key)))

    def running(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each cell in its column, and the column's total."""
        total = np.cumsum(x)
        before = np.repeat(total[head] - x[head], size)
        return total - before, np.repeat(total[head + size - 1], size) - before

    (ln, tn), (lw, tw), (ls, ts) = running(n), running(w), running(s)
    whole = ts * ts / (tw + rule.l2)
    rw = tw - lw
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ls * ls / (lw + rule.l2) + (ts - ls) ** 2 / (rw + rule.l2) - whole
    fine = (ln >= rule.min_leaf) & (tn - ln >= rule.min_leaf) & (tn >= rule.min_split)
    gain = np.where(fine, gain, -np.inf)
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.maximum.reduceat(gain, start)
    count = np.diff(np.append(start, len(key)))
    slack = TIE * (np.abs(whole[start]) + np.where(np.isfinite(best), best, 0))
    hit = np.flatnonzero(gain >= np.repeat(best - slack, count))
    pick = hit[np.searchsorted(hit, start)]  # the first good one of each node
    ok = best > slack
    return (node[start], np.where(ok, column[pick] % features, -1), key[pick] & 255, np.where(ok, gain[pick], 0.0), ln[pick], lw[pick], ls[pick])


@dataclass
class Growing:
    """A tree under way: ``wanted`` says whose cells are needed next, ``put`` takes their splits."""
    rule: Rule
    feature: np.ndarray = field(default_factory=lambda: np.array([-1]))
    cut: np.ndarray = field(default_factory=lambda: np.array([0]))
    left: np.ndarray = field(default_factory=lambda: np.array([-1]))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    n: np.ndarray = field(default_factory=lambda: np.array([0]))
    w: np.ndarray = field(default_factory=lambda: np.zeros(1))
    s: np.ndarray = field(default_factory=lambda: np.zeros(1))
    depth: np.ndarray = field(default_factory=lambda: np.array([0]))
    known: np.ndarray = field(default_factory=lambda: np.array([False]))

    def start(self, n: int, w: float, s: float) -> Growing:
        self.n, self.w, self.s = np.array([n]), np.array([float(w)]), np.array([float(s)])
        return self

    def _open(self) -> np.ndarray:
        """Nodes not looked at that could be split."""
        may = ~self.known & (self.n >= max(2 * self.rule.min_leaf, self.rule.min_split))
        if self.rule.max_depth is not None:
            may &= self.depth < self.rule.max_depth
        return may

    def _by_gain(self) -> tuple[np.ndarray, np.ndarray]:
        """(split nodes, nodes to look at) when leaves are split by falling gain, as far as known."""
        may, queue, split, want = self._open(), [], [], []
        leaves = 1

        def meet(i: int) -> None:
            if may[i]:
                want.append(i)
            elif self.feature[i] >= 0:
                heapq.heappush(queue, (-self.gain[i], i))

        meet(0)
        while queue and leaves < self.rule.max_leaves:
            _, i = heapq.heappop(queue)
            split.append(i)
            leaves += 1
            meet(self.left[i])
            meet(self.left[i] + 1)
        return np.array(split, dtype=np.int64), np.array(sorted(want), dtype=np.int64)

    def wanted(self) -> np.ndarray:
        return np.flatnonzero(self._open()) if self.rule.max_leaves is None else self._by_gain()[1]

    def put(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, n: np.ndarray, w: np.ndarray, s: np.ndarray) -> None:
        """Splits of nodes; those with a feature get two children."""
        self.known[nodes] = True
        split = feature >= 0
        at = nodes[split]
        if not len(at):
            return
        self.feature[at], self.cut[at], self.gain[at] = feature[split], cut[split], gain[split]
        self.left[at] = len(self.feature) + 2 * np.arange(len(at))

        def both(l: np.ndarray, whole: np.ndarray) -> np.ndarray:
            return np.stack([l[split], whole[at] - l[split]], axis=1).ravel()

        new = 2 * len(at)
        n, w, s = both(n, self.n), both(w, self.w), both(s, self.s)
        self.n, self.w, self.s = np.concatenate([self.n, n]), np.concatenate([self.w, w]), np.concatenate([self.s, s])
        self.depth = np.concatenate([self.depth, np.repeat(self.depth[at] + 1, 2)])
        for name, value in (("feature", -1), ("cut", 0), ("left", -1), ("gain", 0.0), ("known", False)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(new, value, dtype=old.dtype)]))

    def pass_on(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows at nodes ``at`` are after their nodes were split."""
        split = self.feature[at] >= 0
        here = at[split]
        out = at.copy()
        out[split] = self.left[here] + (bins[split, self.feature[here]] > self.cut[here])
        return out

    def descend(self, bins: np.ndarray) -> np.ndarray:
        """The deepest known node of every row."""
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            new = self.pass_on(bins, at)
            if (new == at).all():
                return at
            at = new

    def done(self) -> Tree:
        """The tree; of a tree that grew by gain, the nodes beyond its leaves are cut off."""
        feature = self.feature.copy()
        if self.rule.max_leaves is not None:
            keep = np.zeros(len(feature), dtype=bool)
            keep[self._by_gain()[0]] = True
            feature[~keep] = -1
        weight = self.w + self.rule.l2
        value = np.divide(self.s, weight, out=np.zeros(len(weight)), where=weight > 0)
        reach = np.zeros(len(feature), dtype=bool)
        reach[0] = True
        for i in np.flatnonzero(feature >= 0):  # parents come before their children
            if reach[i]:
                reach[self.left[i]:self.left[i] + 2] = True
        place = np.cumsum(reach) - 1
        left = np.where(feature >= 0, place[np.where(feature >= 0, self.left, 0)], -1)
        return Tree(feature[reach].astype(np.int32), self.cut[reach].astype(np.int32), left[reach].astype(np.int32), value[reach],
                    self.n[reach].astype(np.int64), self.depth[reach].astype(np.int32))


def grow(bins: np.ndarray, weight: np.ndarray, target: np.ndarray, rule: Rule) -> Tree:
    """A tree from rows in memory (rows of weight 0 are left out)."""
    own = np.flatnonzero(weight > 0)
    if len(own) < len(bins):
        bins, weight, target = bins[own], weight[own], target[own]
    tree = Growing(rule).start(len(bins), weight.sum(), (weight * target).sum())
    at, features = np.zeros(len(bins), dtype=np.int64), bins.shape[1]
    while len(want := tree.wanted()):
        rank = np.full(len(tree.feature), -1, dtype=np.int64)
        rank[want] = np.arange(len(want))
        here = rank[at]
        rows = np.flatnonzero(here >= 0)
        x = bins[rows]
        node, *split = best_splits(*cells(x, here[rows], weight[rows], target[rows]), features, rule)
        tree.put(want[node], *split)
        at[rows] = tree.pass_on(x, at[rows])
    return tree.done()


def boost(bins: np.ndarray, y: np.ndarray, rule: Rule, step: float, rounds: int) -> tuple[float, list[Tree]]:
    """(start, trees) of gradient boosting with squared error on rows in memory."""
    if not len(y):
        raise ValueError("no training rows")
    start = float(y.mean())
    score, ones, trees = np.full(len(y), start), np.ones(len(y)), []
    for _ in range(rounds):
        tree = grow(bins, ones, y - score, rule)
        trees.append(tree)
        if len(tree.feature) == 1:
            break  # no split gains: none will in any later round
        score += step * tree.predict(bins)
    return start, trees


def bag(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by its 64-bit key) is in a tree's bootstrap sample: Poisson with mean
    1, from a hash, so that it is the same wherever the row lies."""
    mix = (seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % (1 << 64)
    x = key.astype(np.uint64) ^ np.uint64(mix)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))
    return np.searchsorted(steps, u, side="right").astype(np.float64)

"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is described by a dozen numbers that count characters, words and repetitions.
Each number is cut into bins at quantiles of the training rows.  Boosting goes round the
features in turn: a shallow tree over the bins of one feature is fitted to the gradient of
the logistic loss and added, scaled down, to that feature's lookup table.  The pairs whose
best four-way cut removes most of what is left then get two-way tables in the same way.  A
score is the sum of looked-up values through the logistic function.

Training rows are a bounded sample of labelled documents; their features (a few MB) are
fitted on the driver.  Scoring is one pass of executors over whole texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import train_labels

FEATURES = ("log_words", "word_length", "upper", "digit", "stops", "symbols", "lines",
            "distinct", "repeats", "top_word", "same_lines", "long_words")
#: At most about so many labelled rows are fitted.
TRAIN_ROWS = 40_000
#: Documents with at least this score are kept.
THRESHOLD = 0.3

_CLASS = np.full(256, 5, dtype=np.uint8)  # symbols
for _chars, _c in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3),
                   (b".,;:'\"?-()", 4), (b" \t\r\n\x0b\x0c", 0)):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 2  # bytes of letters beyond ASCII


def text_features(text: str | None) -> list[float]:
    """The numbers in ``FEATURES`` for a whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    space, upper, lower, digit, stop, symbol = np.bincount(_CLASS[raw], minlength=6).tolist()
    words = text.split()
    n, letters, solid = len(words), max(1, upper + lower), max(1, len(raw) - space)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = text.split("\n")
    return [np.log1p(n), solid / n, upper / letters, digit / solid, stop / n, symbol / solid, len(lines) / n,
            len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
            1 - len(set(lines)) / len(lines), sum(c for w, c in counts.items() if len(w) > 25) / n]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series([text_features(v) for v in t])

    return of(text)


@dataclass
class Additive:
    """Intercept, bin edges and a lookup table by feature, and tables by pair of features."""
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                            np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0)
    return [np.unique(cuts[:, f]) for f in range(x.shape[1])]


def _step(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Leaf values by bin of a greedy tree over ordered bins (gradient and weight sums)."""
    whole = np.full(len(g), _step(g.sum(), h.sum(), l2))
    if depth == 0 or len(g) < 2:
        return whole
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + l2) + 1e-12:
        return whole
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, l2), _tree(g[k:], h[k:], depth - 1, l2)])


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of both axes into four parts."""
    best, out = -1.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = []
            for c in (cg, ch):
                a, top, left, whole = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
                parts.append(np.array([a, top - a, left - a, whole - top - left + a]))
            gain = float((parts[0] ** 2 / (parts[1] + l2)).sum())
            if gain > best:
                best, v = gain, _step(parts[0], parts[1], l2)
                out = np.empty_like(g)
                out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 4,
                 bins: int = 48, coarse_bins: int = 8, depth: int = 2, rate: float = 0.1, l2: float = 2.0) -> Additive:
    """Cyclic boosting of lookup tables on rows ``x`` with labels ``y`` (0 or 1).  Without rows
    the score is 0.5; with one class only it is that class's smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        empty = [np.empty(0)] * len(FEATURES)
        return Additive(intercept, empty, [np.zeros(1)] * len(FEATURES), empty)
    edges, coarse = _edges(x, bins), _edges(x, coarse_bins)
    where = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, at in enumerate(where):
            g, h = slopes()
            size = len(tables[f])
            leaf = rate * _tree(np.bincount(at, g, size), np.bincount(at, h, size), depth, l2)
            tables[f] += leaf
            total += leaf[at]

    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = rough[a] * shape[1] + rough[b]
        g, h = slopes()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = {(a, b): _quadrants(*sums(a, b)[1:], l2)[0] for a in range(x.shape[1]) for b in range(a)}
    chosen = sorted(gains, key=gains.get, reverse=True)[:n_pairs]
    grids = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            at, g, h = sums(*p)
            leaf = rate * _quadrants(g, h, l2)[1]
            grids[p] += leaf
            total += leaf.ravel()[at]
    return Additive(intercept, edges, tables, coarse, [(a, b, v) for (a, b), v in grids.items()])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS,
        seed: int = 3) -> Additive:
    """The model learnt from the training fold's labels (at most about ``train_rows``)."""
    picked = train_labels(labels, label, train_rows, seed)
    # the sample's size is bounded by the parameter above: ids and labels of train_rows rows
    rows = (docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select("doc_id", "y", features(F.col("text")).alias("x")).dropDuplicates(["doc_id"]))
    got = rows.orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit_additive(x, got["y"].to_numpy(dtype=float))


def score(model: Additive, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([text_features(v) for v in t], dtype=float).reshape(len(t), len(FEATURES))))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (score >= threshold).

    Defined cases: null and empty texts are scored from features that are all 0; rows that
    share an id are scored each by its own text; without labels every score is 0.5; an
    empty table gives no rows.  Columns named score or predicted are replaced.
    """
    scored = docs.withColumn("score", score(fit(docs, labels, **options), F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

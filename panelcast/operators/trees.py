"""Forests, gradient boosting and their searches.

One table of bins serves every model: each feature is cut at quantiles of all training rows
(at most 255 bins), a missing value has a bin of its own and is read as the bin of the
median of the model's fold.  Models are *units*: a kind, its parameters and a fold.

* Growth is that of ``growth``: squared error, an L2 penalty on leaf values, leaf-wise
  where the number of leaves is bounded.
* **Nested forests.**  All sizes of a forest are prefixes of its largest, and smaller depths
  and larger ``minSplit`` stop its trees earlier, so a search grows one forest for each
  ``minInstancesPerNode`` and fold.
* **Prefixes of boosting.**  Rounds are scored as prefixes of the longest run.

Where the table of bins takes at most ``LOCAL_BYTES``, it is broadcast and every unit (of a
forest: every 50 trees) is a task of one Spark job.  Beyond that size the rows stay where
they lie, and all units grow together: a pass gives the cells of all nodes that any unit
looks at, Spark adds them up and finds each node's split; only splits reach the driver.
Both ways see the same cells, up to the order in which doubles are added.

Folds expand in time (a validation that trains on later rows would leak).
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import growth as gr
from panelcast.session import materialize

# Model presets of the reference (side A forest, both boosting sides; a
# boosting tree has at most 31 leaves).
RF_DEFAULTS = dict(numTrees=600, maxDepth=5, minInstancesPerNode=2)
GB_LIBRARY_DEFAULTS = dict(maxIter=100, stepSize=0.1, maxDepth=None, minInstancesPerNode=20, maxLeaves=31)
GB_SIDE_B = dict(maxIter=1200, stepSize=0.03, maxDepth=2, minInstancesPerNode=20, l2=0.1, maxLeaves=31)
# The reference's search grids.
RF_GRID = {"numTrees": [200, 400, 600], "maxDepth": [None, 5, 10], "minSplit": [2, 5], "minInstancesPerNode": [1, 2]}
GB_GRID = {"stepSize": [0.03, 0.05, 0.1], "maxDepth": [2, 3, 4], "maxIter": [300, 600, 1200], "l2": [0.0, 0.1, 1.0]}
# Parameter names of the reference's best-params tables and ours.
PARAM_NAMES = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
               "min_samples_split": "minSplit", "learning_rate": "stepSize", "max_iter": "maxIter",
               "l2_regularization": "l2"}
TO_REFERENCE = {v: k for k, v in PARAM_NAMES.items()}

#: A table of bins up to this size is broadcast.
LOCAL_BYTES = 64 << 20
#: Trees of a forest that one task grows.
CHUNK = 50
#: Rounds after which the scores of boosted rows are written anew; trees of a forest grown at once.
ROUNDS_HELD, TREES_AT_ONCE = 20, 8
#: Relative error of the ranks at which features are cut.
CUT_ACCURACY = 20_000
ALL = -1    # the fold of all training rows


@dataclass(frozen=True)
class Unit:
    """One model to fit: parts up to ``last`` train it (None: all), parts up to ``until`` validate."""
    kind: str
    params: dict
    fill: dict
    last: int | None = None
    until: int | None = None
    seed: int = 42

    def rule(self) -> gr.Rule:
        p = self.params
        return gr.Rule(p.get("maxDepth"), p.get("minInstancesPerNode", 1 if self.kind == "random_forest" else 20), p.get("minSplit") or 2,
                       p.get("l2") or 0.0, p.get("maxLeaves"))

    @property
    def size(self) -> int:
        return int(self.params["numTrees" if self.kind == "random_forest" else "maxIter"])


@dataclass
class Rows:
    """Rows of the table of bins, as arrays."""
    bins: np.ndarray
    y: np.ndarray
    part: np.ndarray
    key: np.ndarray

    def filled(self, unit: Unit, cuts: Sequence[np.ndarray], features: Sequence[str]) -> np.ndarray:
        return fill_bins(self.bins, fill_codes(unit.fill, cuts, features))

    def train(self, unit: Unit) -> np.ndarray:
        return np.ones(len(self.y), bool) if unit.last is None else self.part <= unit.last

    def val(self, unit: Unit) -> np.ndarray:
        return np.zeros(len(self.y), bool) if unit.last is None else (self.part > unit.last) & (self.part <= unit.until)


def fill_codes(fill: Mapping[str, float], cuts: Sequence[np.ndarray], features: Sequence[str]) -> np.ndarray:
    """The bin of each feature's fill value (0 where there is none)."""
    return np.array([np.searchsorted(c, float(fill.get(f) or 0.0)) for f, c in zip(features, cuts, strict=True)], dtype=np.uint8)


def fill_bins(bins: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.where(bins == gr.MISSING, codes, bins)


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of values (rows x features): the number of cuts below each; nan is missing."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), gr.MISSING, np.searchsorted(c, x[:, j]))
    return out


def feature_cuts(train: DataFrame, features: Sequence[str], max_bins: int = gr.MAX_BINS) -> list[np.ndarray]:
    """Values at which each feature is cut: its quantiles at multiples of 1 / max_bins, from one
    aggregate (a sketch whose ranks are exact below ``CUT_ACCURACY`` rows)."""
    at = [k / max_bins for k in range(1, max_bins)]
    cols = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features]
    row = train.agg(*[F.percentile_approx(c, at, CUT_ACCURACY).alias(f"q{j}") for j, c in enumerate(cols)],
                    *[F.max(c).alias(f"m{j}") for j, c in enumerate(cols)]).first()
    out = []
    for j in range(len(features)):
        q = np.unique(np.array(row[f"q{j}"] or [], dtype=float))
        out.append(q[q < row[f"m{j}"]] if row[f"m{j}"] is not None else q)  # nothing lies above the greatest
    return out


@dataclass
class Table:
    """The table of bins of a training set."""
    features: list[str]
    cuts: list[np.ndarray]
    blocks: DataFrame           # bins, y, part, key: bytes of many rows
    rows: int

    @property
    def local(self) -> bool:
        return self.rows * (len(self.features) + 20) <= LOCAL_BYTES

    def collected(self) -> Rows:
        return _rows_of(self.blocks.toPandas(), len(self.features))  # at most LOCAL_BYTES


def _rows_of(pdf: pd.DataFrame, features: int) -> Rows:
    def flat(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(pdf[name]), kind)

    return Rows(flat("bins", "u1").reshape(-1, features), flat("y", "<f8"), flat("part", "<i4"), flat("key", "<i8"))


def bin_table(train: DataFrame, features: Sequence[str], ends: Sequence[object] = (), *, time_col: str = "t",
              keys: Sequence[str] = ("entity", "t")) -> Table:
    """The table of bins of ``train`` (features and y).  Rows later than ``ends[i]`` are in a part
    after i; rows are told apart by ``keys`` where they have them, else by all values."""
    feats = list(features)
    cuts = feature_cuts(train, feats)
    named = [k for k in keys if k in train.columns] or [*feats, "y"]
    part = sum((F.when(F.col(time_col) > F.lit(e), 1).otherwise(0) for e in ends), F.lit(0))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = to_bins(pdf[[f"x{j}" for j in range(len(feats))]].to_numpy(dtype=float), cuts)
            yield pd.DataFrame({"bins": [bins.tobytes()], "y": [pdf["y"].to_numpy("<f8").tobytes()],
                                "part": [pdf["part"].to_numpy("<i4").tobytes()], "key": [pdf["key"].to_numpy("<i8").tobytes()],
                                "n": [len(pdf)]})

    flat = train.where(F.col("y").isNotNull()).select(
        *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(feats)], F.col("y").cast("double").alias("y"),
        part.cast("int").alias("part"), F.xxhash64(*named).alias("key"))
    blocks = materialize(flat.mapInPandas(cut, "bins binary, y binary, part binary, key binary, n long"))
    return Table(feats, cuts, blocks, int(blocks.agg(F.sum("n")).first()[0] or 0))


# ---------------------------------------------------------------- fits

@dataclass
class TreeFit:
    """A fitted ensemble: start + scale * sum of its trees."""
    kind: str
    features: list[str]
    cuts: list[np.ndarray]
    fill: dict
    start: float
    scale: float
    trees: list[gr.Tree]
    params: dict

    def bins(self, x: np.ndarray) -> np.ndarray:
        return fill_bins(to_bins(x, self.cuts), fill_codes(self.fill, self.cuts, self.features))

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.start + self.scale * sum((t.predict(bins) for t in self.trees), np.zeros(len(x)))

    def predict_col(self, spark: SparkSession) -> Column:
        sent = spark.sparkContext.broadcast(self)  # trees x nodes, parameters of the model

        @F.pandas_udf("double")
        def of(values: pd.Series) -> pd.Series:
            x = np.array([v.astype(float) for v in values]) if len(values) else np.empty((0, len(sent.value.features)))
            return pd.Series(sent.value.predict(x))

        nan = F.lit(float("nan"))
        return of(F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in self.features]))

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, self.predict_col(df.sparkSession))


class Failed(Exception):
    """A unit that could not be fitted, with the name of its error."""


def _grow_chunk(rows: Rows, table_cuts, features, unit: Unit, chunk: int) -> tuple[float, list[gr.Tree]]:
    """The start value and the trees of one task."""
    own = rows.train(unit)
    bins, y = rows.filled(unit, table_cuts, features)[own], rows.y[own]
    if not len(y):
        raise ValueError("no training rows")
    if unit.kind == "gradient_boosting":
        return gr.boost(bins, y, unit.rule(), unit.params["stepSize"], unit.size)
    start, rule = float(y.mean()), unit.rule()
    trees = range(chunk * CHUNK, min(unit.size, (chunk + 1) * CHUNK))
    return start, [gr.grow(bins, gr.bag(rows.key[own], k, unit.seed), y - start, rule) for k in trees]


def _tasks(units: Sequence[Unit]) -> list[tuple[int, int]]:
    """(unit, chunk), the longest first."""
    out = [(u, c) for u, unit in enumerate(units) for c in range(1 if unit.kind == "gradient_boosting" else -(-unit.size // CHUNK))]
    return sorted(out, key=lambda t: -(units[t[0]].size if units[t[0]].kind == "gradient_boosting" else 0))


def _local_fits(spark: SparkSession, table: Table, units: Sequence[Unit]) -> list[tuple[float, list[gr.Tree]] | Failed]:
    """(start, trees) of every unit, each chunk a task over the broadcast table."""
    tasks = _tasks(units)
    sent = spark.sparkContext.broadcast((table.collected(), table.cuts, table.features, list(units), tasks))  # at most LOCAL_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cuts, features, all_units, all_tasks = sent.value
        for pdf in batches:
            for k in pdf["id"]:
                u, c = all_tasks[k]
                try:
                    made, error = pickle.dumps(_grow_chunk(rows, cuts, features, all_units[u], c)), None
                except (ValueError, ArithmeticError) as exc:  # the model's own errors
                    made, error = None, type(exc).__name__
                yield pd.DataFrame({"unit": [u], "chunk": [c], "made": [made], "error": [error]})

    done = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInPandas(run, "unit int, chunk int, made binary, error string").collect()
    out: list = [None] * len(units)
    for r in sorted(done, key=lambda r: (r["unit"], r["chunk"])):
        u = r["unit"]
        if r["error"]:
            out[u] = Failed(r["error"])
        elif not isinstance(out[u], Failed):
            start, trees = pickle.loads(bytes(r["made"]))
            out[u] = (start, (out[u][1] if out[u] else []) + trees)
    return out


def _grow_over(blocks: DataFrame, table: Table, jobs: Sequence[tuple], targets) -> list[gr.Tree]:
    """Trees of jobs (unit, number of the tree, rule) grown together from rows that stay where they
    are.  ``targets(job, rows, bins, row of the block)`` gives the targets of a job, by its place."""
    features, cuts = table.features, table.cuts
    p = len(features)
    grown = [gr.Growing(rule).start(1 << 62, 0.0, 0.0) for _, _, rule in jobs]
    while any(len(g.wanted()) for g in grown):
        plan = [(k, unit, number, g.wanted(), g) for k, ((unit, number, _), g) in enumerate(zip(jobs, grown, strict=True)) if len(g.wanted())]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, block in pdf.iterrows():
                    rows = _rows_of(block.to_frame().T, p)
                    for k, unit, number, want, g in plan:
                        weight = rows.train(unit).astype(float)
                        if unit.kind == "random_forest":
                            weight *= gr.bag(rows.key, number, unit.seed)
                        own = np.flatnonzero(weight > 0)
                        bins = rows.filled(unit, cuts, features)
                        target = targets(k, rows, bins, block)
                        rank = np.full(len(g.feature), -1, dtype=np.int64)
                        rank[want] = np.arange(len(want))
                        here = rank[g.descend(bins[own])]
                        own, here = own[here >= 0], here[here >= 0]
                        if len(own):
                            key, n, w, s = gr.cells(bins[own], here, weight[own], target[own])
                            yield pd.DataFrame({"job": np.full(len(key), k, np.int32), "key": key, "n": n, "w": w, "s": s})

        cells = (blocks.mapInPandas(count, "job int, key long, n long, w double, s double")
                 .groupBy("job", "key").agg(*[F.sum(c).alias(c) for c in "nws"]).withColumn("node", F.floor(F.col("key") / (256 * p))))
        rules = [rule for _, _, rule in jobs]

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key")
            node, feature, cut, gain, n, w, s = gr.best_splits(*[pdf[c].to_numpy() for c in ("key", "n", "w", "s")], p, rules[int(pdf["job"].iloc[0])])
            first = pdf[(pdf["key"] // 256) % p == 0]  # a node's rows are in some bin of the first feature
            return pd.DataFrame({"job": pdf["job"].iloc[:1], "node": node, "feature": feature, "cut": cut, "gain": gain, "n": n, "w": w, "s": s,
                                 "of_n": first["n"].sum(), "of_w": first["w"].sum(), "of_s": first["s"].sum()})

        schema = "job int, node long, feature long, cut long, gain double, n long, w double, s double, of_n long, of_w double, of_s double"
        found = cells.groupBy("job", "node").applyInPandas(split, schema).toPandas()  # one row a node
        for k, _, _, want, g in plan:
            own = found[found["job"] == k].sort_values("node")
            if want[0] == 0:
                if own.empty:
                    raise Failed("ValueError")
                g.start(*own[["of_n", "of_w", "of_s"]].iloc[0])
            at = want[own["node"].to_numpy(np.int64)]
            g.put(at, *[own[c].to_numpy() for c in ("feature", "cut", "gain", "n", "w", "s")])
            g.known[want] = True
    return [g.done() for g in grown]


def _spread_fits(table: Table, units: Sequence[Unit]) -> list[tuple[float, list[gr.Tree]] | Failed]:
    """(start, trees) of every unit; no rows leave their blocks."""
    features, cuts = table.features, table.cuts

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, block in pdf.iterrows():
                rows = _rows_of(block.to_frame().T, len(features))
                for u, unit in enumerate(units):
                    y = rows.y[rows.train(unit)]
                    yield pd.DataFrame({"unit": [u], "n": [len(y)], "s": [y.sum()]})

    sums = table.blocks.mapInPandas(means, "unit int, n long, s double").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    starts = {r["unit"]: r["s"] / r["n"] for r in sums.collect() if r["n"]}
    out: list = [None] * len(units)
    rules: dict = {}
    for u, unit in enumerate(units):
        try:
            rules[u] = unit.rule()
            out[u] = (starts[u], [])
        except (ValueError, KeyError):
            out[u] = Failed("ValueError")
    for u in [u for u in rules if u in starts and units[u].kind == "random_forest"]:
        start = starts[u]
        for k in range(0, units[u].size, TREES_AT_ONCE):
            jobs = [(units[u], t, rules[u]) for t in range(k, min(units[u].size, k + TREES_AT_ONCE))]
            out[u][1].extend(_grow_over(table.blocks, table, jobs, lambda k, rows, bins, block, start=start: rows.y - start))

    live = [u for u in rules if u in starts and units[u].kind == "gradient_boosting"]
    blocks, held = table.blocks.withColumn("scores", F.lit(None).cast("binary")), {u: [] for u in live}
    order = list(live)

    def scores(unit_no: int, unit: Unit, rows: Rows, bins: np.ndarray, block, trees: list[gr.Tree], names: list[int]) -> np.ndarray:
        if block["scores"] is None:
            score = np.full(len(rows.y), starts[unit_no])
        else:
            score = np.frombuffer(block["scores"], "<f8").reshape(len(names), -1)[names.index(unit_no)]
        return score + unit.params["stepSize"] * sum((t.predict(bins) for t in trees), np.zeros(len(rows.y)))

    for r in range(max([units[u].size for u in live], default=0)):
        now = [u for u in live if r < units[u].size]
        if not now:
            break
        jobs = [(units[u], u, rules[u]) for u in now]
        pending = {u: list(held[u]) for u in now}

        def residual(k: int, rows: Rows, bins: np.ndarray, block) -> np.ndarray:
            return rows.y - scores(now[k], units[now[k]], rows, bins, block, pending[now[k]], order)

        for u, tree in zip(now, _grow_over(blocks, table, jobs, residual), strict=True):
            out[u][1].append(tree)
            held[u].append(tree)
            if len(tree.feature) == 1:
                live.remove(u)  # no split gains: none will in any later round
        if (r + 1) % ROUNDS_HELD == 0:
            done = {u: list(held[u]) for u in order}

            def rescore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    made = []
                    for _, block in pdf.iterrows():
                        rows = _rows_of(block.to_frame().T, len(features))
                        made.append(np.stack([scores(u, units[u], rows, rows.filled(units[u], cuts, features), block, done[u], order)
                                              for u in order]).astype("<f8").tobytes())
                    yield pdf.assign(scores=made)

            blocks = materialize(blocks.mapInPandas(rescore, blocks.schema))
            held = {u: [] for u in order}
    return out


def fit_units(spark: SparkSession, table: Table, units: Sequence[Unit]) -> list[TreeFit | Failed]:
    """Every unit's model, in one job where the table of bins is small, else in shared passes."""
    if not units:
        return []
    made = _local_fits(spark, table, units) if table.local else _spread_fits(table, units)
    out: list = []
    for unit, fit in zip(units, made, strict=True):
        if isinstance(fit, Failed):
            out.append(fit)
            continue
        start, trees = fit
        scale = unit.params["stepSize"] if unit.kind == "gradient_boosting" else 1.0 / len(trees)
        out.append(TreeFit(unit.kind, table.features, table.cuts, dict(unit.fill), start, scale, trees, dict(unit.params)))
    return out


def fit_tree(train: DataFrame, features: Sequence[str], fill: Mapping[str, float], kind: str, params: Mapping,
             seed: int = 42, table: Table | None = None) -> TreeFit:
    """M6 / M7: one model on all of ``train``."""
    if kind not in ("random_forest", "gradient_boosting"):
        raise ValueError(kind)
    table = table or bin_table(train, features)
    fit = fit_units(train.sparkSession, table, [Unit(kind, dict(params), dict(fill), seed=seed)])[0]
    if isinstance(fit, Failed):
        raise ValueError(f"no model: {fit}")
    return fit


def with_params(defaults: Mapping, params: Mapping) -> dict:
    """Defaults with the tuned parameters that they know; whole numbers become ints.  (A null
    is dropped when tables of parameters are read, so that the default stays.)"""
    known = set(PARAM_NAMES.values())
    return dict(defaults) | {k: int(v) if isinstance(v, float) and v.is_integer() and k not in ("l2", "stepSize") else v
                             for k, v in params.items() if k in known}


# ---------------------------------------------------------------- folds

def fold_units(kind: str, params: Mapping, bounds: Sequence[tuple], fold_fill: Mapping[int, Mapping[str, float]],
               ends: Sequence[object], seed: int = 42) -> list[Unit]:
    """A unit for each (fold, last train period, last validation period)."""
    at = {e: k for k, e in enumerate(ends)}
    return [Unit(kind, dict(params), dict(fold_fill[f]), at[te], at[ve], seed) for f, te, ve in bounds]


def period_ends(bounds: Sequence[tuple]) -> list:
    """All periods at which a fold's training or validation rows end, in order."""
    return sorted({e for _, te, ve in bounds for e in (te, ve)})


def score_folds(rows: DataFrame, fits: Mapping[tuple[str, int], TreeFit], features: Sequence[str]) -> DataFrame:
    """(model, fold, role, y, p) of rows (fold, role, y and features): every model of the row's fold
    scores it, all in one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(dict(fits))  # folds x models x trees x nodes

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, own in pdf.groupby("fold"):
                x = own[[f"x{j}" for j in range(len(features))]].to_numpy(dtype=float)
                for (kind, f), fit in sent.value.items():
                    if f == fold:
                        yield pd.DataFrame({"model": kind, "fold": own["fold"], "role": own["role"], "y": own["y"], "p": fit.predict(x)})

    flat = rows.select("fold", "role", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    return flat.mapInPandas(score, "model string, fold int, role string, y double, p double")


# ---------------------------------------------------------------- search

def expand_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def _searched(kind: str, cands: Sequence[dict], defaults: Mapping) -> tuple[list[dict], list[tuple[int, int, int]]]:
    """The fits that score all candidates, and for each candidate (fit, variant, size): the variant
    is a place in the fit's ``variants``, the size its number of trees or rounds."""
    free = ("numTrees", "maxDepth", "minSplit") if kind == "random_forest" else ("maxIter",)
    fits: dict[tuple, dict] = {}
    own = []
    for c in cands:
        p = dict(defaults) | dict(c)
        name = tuple(sorted((k, v) for k, v in p.items() if k not in free))
        fit = fits.setdefault(name, {"params": p | {k: [] for k in free}, "variants": [], "sizes": set()})
        variant = (p.get("maxDepth"), p.get("minSplit") or 2) if kind == "random_forest" else (None, 2)
        if variant not in fit["variants"]:
            fit["variants"].append(variant)
        size = int(p["numTrees" if kind == "random_forest" else "maxIter"])
        fit["sizes"].add(size)
        own.append((list(fits).index(name), fit["variants"].index(variant), size))
    out = []
    for fit in fits.values():
        p, sizes = fit["params"], sorted(fit["sizes"])
        if kind == "random_forest":
            depths, splits = zip(*fit["variants"], strict=True)
            p |= {"numTrees": sizes[-1], "maxDepth": None if None in depths else max(depths), "minSplit": min(splits)}
        else:
            p |= {"maxIter": sizes[-1]}
        out.append({"params": p, "variants": fit["variants"], "sizes": sizes})
    return out, own


def _sums_of(unit: Unit, fit: dict, bins: np.ndarray, start: float, trees: Sequence[gr.Tree], first: int = 0) -> dict[int, np.ndarray]:
    """For each size: the sum (variants x rows) of those of the trees, numbered from ``first``, that
    an ensemble of that size has; boosting with its start and step."""
    total, out = np.zeros((len(fit["variants"]), len(bins))), {}
    if unit.kind == "gradient_boosting":
        total += start
    todo = [s for s in fit["sizes"] if s > first]
    for k, tree in enumerate(trees, first + 1):
        total += tree.truncated(bins, fit["variants"]) if unit.kind == "random_forest" else unit.params["stepSize"] * tree.predict(bins)
        while todo and todo[0] == k:
            out[todo.pop(0)] = total.copy()
    for s in todo:  # the trees end here: a chunk, or boosting that came to rest
        out[s] = total.copy()
    return out


def _rmse_frame(unit: int, sums: Mapping[int, np.ndarray], y: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([(unit, v, size, float(((p - y) ** 2).sum()), len(y)) for size, made in sums.items() for v, p in enumerate(made)],
                        columns=["unit", "variant", "size", "sse", "n"])


_SCORES = "unit int, variant int, size int, sse double, n long"


def _local_scores(spark: SparkSession, table: Table, units: Sequence[Unit], shapes: Sequence[dict]) -> DataFrame:
    """Squared errors on the validation rows of each unit, by variant and size."""
    tasks = _tasks(units)
    sent = spark.sparkContext.broadcast((table.collected(), table.cuts, table.features, list(units), list(shapes), tasks))  # at most LOCAL_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cuts, features, all_units, all_shapes, all_tasks = sent.value
        for pdf in batches:
            for k in pdf["id"]:
                u, c = all_tasks[k]
                unit, shape = all_units[u], all_shapes[u]
                try:
                    start, trees = _grow_chunk(rows, cuts, features, unit, c)
                except (ValueError, ArithmeticError):
                    continue  # a candidate without scores
                own = rows.val(unit)
                sums = _sums_of(unit, shape, rows.filled(unit, cuts, features)[own], start, trees, c * CHUNK)
                yield pd.DataFrame([(u, c, size, start, m.astype("<f8").tobytes()) for size, m in sums.items()],
                                   columns=["unit", "chunk", "size", "start", "sums"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        """The chunks of one unit and size together."""
        rows, _, _, all_units, all_shapes, _ = sent.value
        u, size = int(pdf["unit"].iloc[0]), int(pdf["size"].iloc[0])
        unit, y = all_units[u], rows.y[rows.val(all_units[u])]
        whole = sum(np.frombuffer(s, "<f8").reshape(len(all_shapes[u]["variants"]), -1) for s in pdf["sums"])
        if unit.kind == "random_forest":
            if len(pdf) < -(-size // CHUNK):
                return _rmse_frame(u, {}, y)  # a chunk failed
            whole = float(pdf["start"].iloc[0]) + whole / size
        return _rmse_frame(u, {size: whole}, y)

    made = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInPandas(run, "unit int, chunk int, size int, start double, sums binary")
    return materialize(made).groupBy("unit", "size").applyInPandas(total, _SCORES)


def _spread_scores(spark: SparkSession, table: Table, units: Sequence[Unit], shapes: Sequence[dict]) -> DataFrame:
    fits = _spread_fits(table, units)
    sent = spark.sparkContext.broadcast((table.cuts, table.features, list(units), list(shapes), fits))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, features, all_units, all_shapes, all_fits = sent.value
        for pdf in batches:
            for _, block in pdf.iterrows():
                rows = _rows_of(block.to_frame().T, len(features))
                for u, (unit, shape, fit) in enumerate(zip(all_units, all_shapes, all_fits, strict=True)):
                    own = rows.val(unit)
                    if isinstance(fit, Failed) or not own.any():
                        continue
                    start, trees = fit
                    sums = _sums_of(unit, shape, rows.filled(unit, cuts, features)[own], start, trees)
                    if unit.kind == "random_forest":
                        sums = {size: start + s / size for size, s in sums.items()}
                    yield _rmse_frame(u, sums, rows.y[own])

    return table.blocks.mapInPandas(score, _SCORES)


def grid_search(train: DataFrame, features: Sequence[str], bounds: Sequence[tuple], fold_fill: Mapping[int, Mapping[str, float]],
                kind: str, grid: Mapping[str, Sequence], *, defaults: Mapping | None = None, seed: int = 42,
                table: Table | None = None) -> tuple[dict, DataFrame]:
    """Every candidate on every expanding fold; score = mean validation RMSE
    (lowest wins, first candidate on ties).  ``bounds`` are (fold, last train period, last
    validation period); ``table`` is a bin table with the ends of their periods.  Returns
    (best candidate, table of candidate, params, fold, val_RMSE)."""
    spark = train.sparkSession
    cands = expand_grid(grid)
    if not cands or not bounds:
        raise ValueError("a search needs candidates and folds")
    ends = period_ends(bounds)
    table = table or bin_table(train, features, ends)
    base = defaults if defaults is not None else {"maxLeaves": 31, "minInstancesPerNode": 20} if kind == "gradient_boosting" else {}
    fits, own = _searched(kind, cands, base)
    units, shapes, names = [], [], []
    for k, fit in enumerate(fits):
        for f, unit in zip([b[0] for b in bounds], fold_units(kind, fit["params"], bounds, fold_fill, ends, seed), strict=True):
            units.append(unit)
            shapes.append(fit)
            names.append((k, f))
    scored = _local_scores(spark, table, units, shapes) if table.local else _spread_scores(spark, table, units, shapes)
    errors = scored.groupBy("unit", "variant", "size").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()  # candidates x folds
    rmse = {(names[r["unit"]], r["variant"], r["size"]): (r["sse"] / r["n"]) ** 0.5 for r in errors if r["n"]}
    rows = [(ci, str(cands[ci]), f, rmse.get(((k, f), v, size))) for ci, (k, v, size) in enumerate(own) for f, _, _ in bounds]
    table_out = spark.createDataFrame(rows, "candidate int, params string, fold int, val_RMSE double")
    means: dict[int, list] = {}
    for ci, _, _, r in rows:
        means.setdefault(ci, []).append(r)
    score = {ci: sum(v) / len(v) for ci, v in means.items() if all(x is not None for x in v)}
    if not score:
        raise ValueError("no candidate could be scored on every fold")
    best = min(score, key=lambda ci: (score[ci], ci))
    return cands[best], table_out


def best_params_frame(spark, params: Mapping, prefix: str = "model__") -> DataFrame:
    """S7 payload: one row, one nullable column per parameter, named as in the
    reference's tables (``model__max_depth``, ``model__n_estimators``, ...)."""
    cols = {f"{prefix}{TO_REFERENCE.get(k, k)}": (None if v is None else float(v)) for k, v in params.items()}
    schema = ", ".join(f"`{k}` double" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema)

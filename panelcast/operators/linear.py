"""Least squares and ridge from distributed QR factors.

Pipeline reproduced: median imputer (fit on train) -> standard scaler (train mean,
population std, std 0 -> 1) -> least squares (minimum norm when rank deficient) or
ridge (intercept not penalised).

How it runs on Spark:

* one exact distributed median per (fold, feature)  (``quantile.wide_medians``);
* one scan gives, for each period *block*, the R factor of a QR factorisation of the rows
  ``v = [coalesce(x - c, 0), is_missing(x), 1, y - c_y]`` (TSQR: a task factors its rows
  batch by batch, factors of many tasks are stacked and factored again, in two levels);
  the driver receives ``blocks`` triangles of ``d x d``, never rows.  A factor has the
  condition of the data; their Gram matrix would have its square, and lose half of the
  digits where features are nearly collinear (time and its square);
* because ``v`` does not depend on the medians, a fold's imputed rows are the linear map
  ``V A'`` (``f = x0 + (median - c) * missing``): the factors of the blocks a fold has are
  stacked, mapped, centred and scaled, so every expanding fold and the final fit come from
  the same scan;
* the solve (d <= 2p+2) is numpy on the driver, by singular values; predictions go back to
  Spark as one JVM-side column expression per fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.quantile import wide_medians

EPS = np.finfo(np.float64).eps
#: Factors of tasks are stacked in so many groups a block before the last step.
GROUPS = 64


@dataclass
class LinearFit:
    """A fitted imputer -> scaler -> linear model, usable as a Spark column."""
    features: list[str]
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    n: int
    alpha: float = 0.0
    extra: dict = field(default_factory=dict)

    def predict_col(self) -> Column:
        expr = F.lit(float(self.intercept))
        for j, c in enumerate(self.features):
            w = float(self.coef[j] / self.scale[j])
            if w == 0.0:
                continue
            xj = F.coalesce(F.col(c).cast("double"), F.lit(float(self.fill[j])))
            expr = expr + F.lit(w) * (xj - F.lit(float(self.mean[j])))
        return expr


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R factor of ``rows`` (columns x columns: filled up with zeros where rows are few)."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if r.shape[0] == d else np.vstack([r, np.zeros((d - r.shape[0], d))])


def block_factors(df: DataFrame, features: Sequence[str], shift: np.ndarray, y_shift: float,
                  block_col: str = "block", y: str = "y") -> dict[int, np.ndarray]:
    """Per-block R factor of v = [coalesce(x-c,0) (p), missing (p), 1, y-c_y]: factored per task in
    numpy, then by groups of tasks, then by block; returns {block: d x d}."""
    feats = list(features)
    p = len(feats)
    d = 2 * p + 2
    cols = [F.col(block_col).cast("int").alias("block"),
            *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(feats)],
            F.col(y).cast("double").alias("y")]
    shift = np.asarray(shift, dtype=float)

    def frame(made: dict[int, np.ndarray]):
        import pandas as pd
        return pd.DataFrame({"block": list(made), "r": [m.ravel().tolist() for m in made.values()]})

    def partial(batches):
        made: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[[f"x{j}" for j in range(p)]].to_numpy(dtype=float)
            miss = np.isnan(x)
            x0 = np.where(miss, 0.0, x - shift)
            v = np.concatenate([x0, miss.astype(float), np.ones((len(pdf), 1)),
                                (pdf["y"].to_numpy(dtype=float) - y_shift)[:, None]], axis=1)
            for b, idx in pdf.groupby("block").indices.items():
                own = [made[int(b)]] if int(b) in made else []
                made[int(b)] = triangle(np.vstack([*own, v[idx]]))
        if made:
            yield frame(made)

    def stacked(pdf):
        """The factor of a group's factors, taken in one by one."""
        r = None
        for m in pdf["r"]:
            m = np.asarray(m, dtype=float).reshape(d, d)
            r = triangle(m if r is None else np.vstack([r, m]))
        return frame({int(pdf["block"].iloc[0]): r})

    schema = "block int, r array<double>"
    parts = df.select(*cols).mapInPandas(partial, schema).withColumn("task", F.spark_partition_id() % GROUPS)
    some = parts.groupBy("block", "task").applyInPandas(stacked, schema)
    whole = some.groupBy("block").applyInPandas(stacked, schema)    # at most GROUPS factors a block
    # blocks x d^2 numbers: bounded by features and folds
    return {int(r["block"]): np.array(r["r"]).reshape(d, d) for r in whole.collect()}


def solve_from_factor(R: np.ndarray, features: Sequence[str], medians: np.ndarray, shift: np.ndarray,
                      y_shift: float, alpha: float = 0.0, rcond: float = 1e-12,
                      keep_empty: bool = True) -> LinearFit:
    """Imputed, standardised, centred solve from a factor ``R`` of the raw rows (see module doc)."""
    p = len(features)
    med = np.where(np.isnan(medians), 0.0, medians)      # all-NULL column -> fill 0 (keep_empty)
    filled = R[:, :p] + R[:, p:2 * p] * (med - shift)    # inner products of these are those of the rows
    ones, target = R[:, 2 * p], R[:, 2 * p + 1]
    n = float(ones @ ones)
    if n < 0.5:
        raise ValueError("no training rows")
    s, sy = ones @ filled / n, float(ones @ target / n)
    centred, yc = filled - np.outer(ones, s), target - ones * sy
    var = (centred ** 2).sum(axis=0) / n
    mean = s + shift
    const = var <= n * EPS * var + (n * (mean) * EPS) ** 2
    scale = np.where(const | (var == 0), 1.0, np.sqrt(var))
    Z = np.where(const, 0.0, centred / scale)
    if not keep_empty:
        Z[:, np.isnan(medians)] = 0.0
    u, sv, vt = np.linalg.svd(Z, full_matrices=False)
    if alpha > 0:
        gain = sv / (sv ** 2 + alpha)
    else:
        gain = np.divide(1.0, sv, out=np.zeros_like(sv), where=sv > rcond * sv.max(initial=0.0))
    coef = vt.T @ (gain * (u.T @ yc)) if p else np.zeros(0)
    return LinearFit(list(features), med, mean, scale, coef, sy + y_shift, int(round(n)), alpha)


def imputer_scaler_stats(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """A8 + A9 as a table: per feature the exact train median (fill value; 0 when the
    column is all NULL), then the mean and population std of the filled column and the
    scale used (std, or 1 when the std is 0).  Two grouped passes for the medians and
    one aggregate for all means and stds."""
    feats = list(features)
    med = wide_medians(train, feats)
    fills = {r["feature"]: r["median"] for r in med.collect()}       # one value per feature
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c) or 0.0))) for c in feats]
    agg = train.agg(*[F.avg(x).alias(f"m{j}") for j, x in enumerate(filled)],
                    *[F.stddev_pop(x).alias(f"s{j}") for j, x in enumerate(filled)])
    pairs = ", ".join(f"'{c}', {float(fills.get(c) or 0.0)!r}D, `m{j}`, `s{j}`" for j, c in enumerate(feats))
    return (agg.selectExpr(f"stack({len(feats)}, {pairs}) AS (feature, median, mean, std)")
               .withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))))


def fold_medians(rows: DataFrame, features: Sequence[str], fold_ends: Sequence[object], *,
                 time_col: str = "t", y: str = "y") -> dict[tuple[int, str], float | None]:
    """Exact medians of every feature (and of ``y``) on every expanding fold's train
    rows (fold i: ``t <= fold_ends[i]``) and on the full set (fold -1), in one grouped
    distributed quantile.  Returns {(fold, column): median or None when all NULL}."""
    t = F.col(time_col)
    fold_of = F.explode(F.array(F.lit(-1), *[F.when(t <= F.lit(e), F.lit(i)) for i, e in enumerate(fold_ends)]))
    exploded = rows.select(fold_of.alias("fold"), *[F.col(c) for c in features], F.col(y)).filter(
        F.col("fold").isNotNull())
    med: dict[tuple[int, str], float | None] = {}
    for r in wide_medians(exploded, [*features, y], ["fold"], small_groups=True).collect():   # (folds+1) x p values
        med[(int(r["fold"]), r["feature"])] = r["median"]
    return med


def fit_linear_folds(rows: DataFrame, features: Sequence[str], fold_ends: Sequence[object],
                     alphas: Mapping[str, float], *, time_col: str = "t", y: str = "y",
                     rcond: float = 1e-12, medians: Mapping | None = None,
                     keep_empty: bool = True) -> dict[tuple[str, int], LinearFit]:
    """Fit every model in ``alphas`` (0 = least squares) on every expanding fold and on
    the full set in one scan.

    ``rows``: the training rows.  ``fold_ends``: sorted last train period of each fold
    (fold i trains on ``t <= fold_ends[i]``); the full set is fold ``-1``.
    Returns {(model, fold): LinearFit}.
    """
    feats = list(features)
    ends = list(fold_ends)
    t = F.col(time_col)
    block = F.lit(0)
    for e in ends:
        block = block + F.when(t > F.lit(e), 1).otherwise(0)
    blocked = rows.withColumn("block", block)
    med = dict(medians) if medians is not None else fold_medians(rows, feats, ends, time_col=time_col, y=y)
    shift = np.array([med.get((-1, c)) if med.get((-1, c)) is not None else 0.0 for c in feats])
    y_shift = med.get((-1, y)) or 0.0
    factors = block_factors(blocked, feats, shift, y_shift, y=y)
    out: dict[tuple[str, int], LinearFit] = {}
    for fold in [-1, *range(len(ends))]:
        own = [r for b, r in sorted(factors.items()) if fold == -1 or b <= fold]
        if not own:
            raise ValueError("no training rows")
        R = triangle(np.vstack(own))
        m = np.array([np.nan if med.get((fold, c)) is None else med[(fold, c)] for c in feats])
        for name, alpha in alphas.items():
            out[(name, fold)] = solve_from_factor(R, feats, m, shift, y_shift, alpha, rcond, keep_empty)
    return out


def fit_linear(train: DataFrame, features: Sequence[str], alpha: float = 0.0, **kw) -> LinearFit:
    """M4 (alpha = 0) / M5 (alpha > 0) on one training set."""
    return fit_linear_folds(train, features, [], {"m": alpha}, **kw)[("m", -1)]


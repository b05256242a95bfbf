"""Permutation importance.

For every repeat the test rows are ranked twice, by key and by a digest of repeat and key;
the row ranked i by key takes feature values from the row ranked i by digest.  That is one
uniform permutation of the whole test set per repeat, shared by all features, at every
size.  The model re-scores the rows with one feature exchanged at a time, and importance =
RMSE(permuted) - RMSE(original); mean and population std over repeats.

Ranks come from a range-partitioned sort: the place within a partition plus the rows of
the partitions before it, so the test set is never gathered in one task.  Only keys and
ranks are shuffled; the rows times features are formed where they are scored.

Tree ensembles are scored in part: a row's sum over all trees is made once, and for each
feature and repeat only the trees that test the feature are followed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.operators.trees import TreeFit
from panelcast.session import materialize

Predictor = Callable[[DataFrame], DataFrame]
#: Rows whose trees' values are held at once.
HELD_ROWS = 2_000


def global_rank(df: DataFrame, group: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with the place (from 1) of each row in its ``group`` by ``order``."""
    part = materialize(df.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    sizes = part.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__part").orderBy(*order)
    return (part.join(offsets, [group, "__part"])
            .withColumn(name, F.col("__offset") + F.row_number().over(inside))
            .drop("__part", "__offset"))


def _rmse(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    e = F.col("y") - F.col("p")
    return df.groupBy(*groups).agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def _base(rows: DataFrame, feats: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows' keys (under private names: a key may be a feature too), y and features."""
    knames = [f"__key{i}" for i in range(len(keys))]
    return materialize(rows.select(*[F.col(k).alias(kn) for k, kn in zip(keys, knames)], "y",
                                   *[F.col(c).cast("double").alias(c) for c in feats])), knames


def _exchanged(base: DataFrame, knames: Sequence[str], feats: Sequence[str], n_repeats: int, seed: int) -> DataFrame:
    """(keys, __r, __given): for every row and repeat the features of the row it takes from."""
    repeat = F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("__r")
    drawn = base.select(*knames, repeat).withColumn("__draw", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col("__r").cast("string"), *[F.col(k).cast("string") for k in knames])))
    takers = global_rank(drawn.drop("__draw"), "__r", knames)
    donors = global_rank(drawn, "__r", ["__draw", *knames]).select(
        "__r", "rank", *[F.col(k).alias(f"__from{i}") for i, k in enumerate(knames)])
    pairs = takers.join(donors, ["__r", "rank"]).drop("rank")
    given = base.select(*[F.col(k).alias(f"__from{i}") for i, k in enumerate(knames)],
                        F.array(*[F.col(c) for c in feats]).alias("__given"))
    return pairs.join(given, [f"__from{i}" for i in range(len(knames))]).select(*knames, "__r", "__given")


def _named(scored: DataFrame, feats: Sequence[str], base_rmse) -> DataFrame:
    """(feature, importance, std) from the rmse of each __j (place of the feature) and __r."""
    names = F.element_at(F.array(*[F.lit(c) for c in feats]), F.col("__j") + 1)
    return (scored.select(names.alias("feature"), (F.col("rmse") - base_rmse).alias("imp"))
                  .groupBy("feature").agg(F.avg("imp").alias("importance"),
                                          F.stddev_pop("imp").alias("std")))


def permutation_importance(rows: DataFrame, features: Sequence[str], predict: Predictor, *,
                           n_repeats: int = 30, seed: int = 42,
                           keys: Sequence[str] = ("entity", "t")) -> DataFrame:
    """(feature, importance, std) for a fitted model given as ``predict(df) -> df with p``."""
    feats = list(features)
    base, knames = _base(rows, feats, keys)
    base_rmse = _rmse(predict(base)).select("rmse").scalar()
    joined = _exchanged(base, knames, feats, n_repeats, seed).join(base, knames)
    each = F.explode(F.sequence(F.lit(0), F.lit(len(feats) - 1))).alias("__j")
    taken = F.element_at("__given", F.col("__j") + 1)
    changed = joined.select("*", each).select(
        "y", "__r", "__j", *[F.when(F.col("__j") == j, taken).otherwise(F.col(c)).alias(c) for j, c in enumerate(feats)])
    return _named(_rmse(predict(changed), ["__j", "__r"]), feats, base_rmse)


def partial_errors(fit: TreeFit, x: np.ndarray, y: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared errors (features x repeats) of rows ``x`` with one feature taken from ``given`` (rows
    x repeats x features), and that of the rows as they are."""
    bins = fit.bins(x)
    rows, repeats, features = given.shape
    other = fit.bins(given.reshape(rows * repeats, features)).reshape(rows, repeats, features)
    whole = fit.start + fit.scale * sum((t.predict(bins) for t in fit.trees), np.zeros(rows))
    change = np.zeros((features, repeats, rows))
    for tree in fit.trees:
        tested = np.unique(tree.feature[tree.feature >= 0])
        if not len(tested):
            continue
        own = tree.predict(bins)
        for j in tested:
            moved = np.repeat(bins, repeats, axis=0)
            moved[:, j] = other[:, :, j].ravel()
            change[j] += tree.predict(moved).reshape(rows, repeats).T - own
    errors = ((y - whole - fit.scale * change) ** 2).sum(axis=2)
    return errors, float(((y - whole) ** 2).sum())


def tree_importance(rows: DataFrame, fit: TreeFit, *, n_repeats: int = 30, seed: int = 42,
                    keys: Sequence[str] = ("entity", "t")) -> DataFrame:
    """(feature, importance, std) of a tree ensemble, with the permutations of
    ``permutation_importance``.  Each task returns one sum of squares a feature and repeat."""
    feats = fit.features
    base, knames = _base(rows, feats, keys)
    given = (_exchanged(base, knames, feats, n_repeats, seed).groupBy(*knames)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "__given"))), lambda s: s["__given"]).alias("__given")))
    joined = given.join(base, knames).select(F.col("y").cast("double").alias("y"), F.array(*feats).alias("__x"),
                                             F.flatten("__given").alias("__given"))
    sent = base.sparkSession.sparkContext.broadcast(fit)  # trees x nodes, parameters of the model

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, base_sum, n = np.zeros((len(feats), n_repeats)), 0.0, 0
        for pdf in batches:
            for k in range(0, len(pdf), HELD_ROWS):
                part = pdf.iloc[k:k + HELD_ROWS]
                x = np.array([v.astype(float) for v in part["__x"]])
                other = np.array([v.astype(float) for v in part["__given"]]).reshape(len(part), n_repeats, len(feats))
                errors, plain = partial_errors(sent.value, x, part["y"].to_numpy(float), other)
                total, base_sum, n = total + errors, base_sum + plain, n + len(part)
        if n:
            j, r = np.divmod(np.arange(total.size), n_repeats)
            yield pd.DataFrame({"__j": np.append(j, -1), "__r": np.append(r, -1), "sse": np.append(total.ravel(), base_sum), "n": n})

    sums = joined.mapInPandas(score, "__j int, __r int, sse double, n long")
    scored = materialize(sums.groupBy("__j", "__r").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse")))
    return _named(scored.where("__j >= 0"), feats, scored.where("__j < 0").select("rmse").scalar())

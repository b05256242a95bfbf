"""Exact quantiles without gathering a column in one task.

``percentile``/``median`` are exact but keep every distinct value of a group in one
aggregation buffer.  Here the exact order statistic is found in two distributed
passes:

1. ``percentile_approx`` brackets the wanted rank: the values at ``q -/+ 3/accuracy``
   enclose it (the sketch's rank error is at most ``n/accuracy``);
2. one aggregation classifies every value as below / inside / above the bracket,
   grouped by (group, class, value-if-inside): the map-side partial aggregate turns
   all outside rows into one count per group and class, and inside rows into
   *distinct values with counts* (so heavy ties, e.g. a third of the rows equal to 0,
   become one row).  A running count over that small set finds the values at ranks
   ``floor(h)`` and ``floor(h)+1`` with ``h = (n-1) q``; the result is interpolated as
   NumPy's default ("linear") method does.

Should a bracket ever miss the rank, that group alone is recomputed over all its
distinct values; when no group misses, the fallback join has an empty side and AQE
drops it at run time.  The result is always exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_ACCURACY = 100_000


def _pick(distinct_counts: DataFrame, groups: list[str], base: str) -> DataFrame:
    """From (groups, __v, __cnt, base, __r0, __r1): the values at ranks r0 and r1."""
    w = Window.partitionBy(*groups).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct_counts.withColumn("__cum", F.col(base) + F.sum("__cnt").over(w))
    return (ranked.groupBy(*groups)
                  .agg(F.min(F.when(F.col("__cum") > F.col("__r0"), F.col("__v"))).alias("__v0"),
                       F.min(F.when(F.col("__cum") > F.col("__r1"), F.col("__v"))).alias("__v1")))


def grouped_quantile(df: DataFrame, value_col: str, q: float, group_cols: Sequence[str] = (),
                     *, accuracy: int = DEFAULT_ACCURACY, out_col: str = "quantile",
                     small_groups: bool = False, bracket: float = 3.0, exact: bool = True) -> DataFrame:
    """Exact linear-interpolated quantile of ``value_col`` per group.

    Returns ``group_cols + [n, out_col]``; groups with no non-NULL value are absent.
    ``small_groups`` says that the caller bounds the number of groups (e.g. features x
    folds): the per-group statistics are then broadcast; otherwise they are shuffled.
    NULL values are ignored (as NumPy after dropping missing values).  ``bracket`` is the
    half-width of the bracket in units of ``1/accuracy`` (tests set 0 to exercise the
    fallback).  ``exact=False`` returns ``percentile_approx`` in one pass (an element
    within ``n/accuracy`` ranks of the target, no interpolation).
    """
    q = float(q)
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    groups = list(group_cols)
    if not groups:
        df = df.withColumn("__qgrp", F.lit(0))
        groups, small_groups = ["__qgrp"], True
    v = F.col(value_col).cast("double")
    vals = df.select(*groups, v.alias("__v")).filter(F.col("__v").isNotNull())
    if not exact:
        approx = vals.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                           F.percentile_approx("__v", q, accuracy).alias(out_col))
        return approx if group_cols else approx.drop("__qgrp")
    qlo = max(q - bracket / accuracy, 0.0)
    qhi = min(q + bracket / accuracy, 1.0)

    # pass 1: size, bracket and target ranks per group
    stats = (vals.groupBy(*groups)
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.percentile_approx("__v", [qlo, qhi], accuracy).alias("__br"))
                 .select(*groups, "n", F.col("__br")[0].alias("__lo"), F.col("__br")[1].alias("__hi"),
                         F.floor((F.col("n") - 1) * F.lit(q)).cast("bigint").alias("__r0"))
                 .withColumn("__r1", F.least(F.col("__r0") + 1, F.col("n") - 1))
                 .withColumn("__frac", (F.col("n") - 1) * F.lit(q) - F.col("__r0")))

    def side(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if small_groups else t

    # pass 2: below / inside (distinct values) / above, one grouped aggregate
    cls = (F.when(F.col("__v") < F.col("__lo"), F.lit(-1))
            .when(F.col("__v") > F.col("__hi"), F.lit(1)).otherwise(F.lit(0)))
    classified = (vals.join(side(stats.select(*groups, "__lo", "__hi")), groups)
                      .select(*groups, cls.alias("__cls"),
                              F.when(cls == 0, F.col("__v")).alias("__v"))
                      .groupBy(*groups, "__cls", "__v").agg(F.count(F.lit(1)).alias("__cnt")))
    per_group = (classified.groupBy(*groups)
                           .agg(F.sum(F.when(F.col("__cls") == -1, F.col("__cnt")).otherwise(0)).alias("__c_lo"),
                                F.sum(F.when(F.col("__cls") == 0, F.col("__cnt")).otherwise(0)).alias("__m"))
                           .join(stats.select(*groups, "__r0", "__r1"), groups)
                           .withColumn("__ok", (F.col("__c_lo") <= F.col("__r0"))
                                       & (F.col("__c_lo") + F.col("__m") > F.col("__r1"))))
    inside = (classified.filter(F.col("__cls") == 0)
                        .join(per_group.filter("__ok").select(*groups, "__c_lo", "__r0", "__r1"), groups))
    fast = _pick(inside, groups, "__c_lo")

    # fallback (never expected): groups whose bracket missed, over all distinct values
    missed = per_group.filter(~F.col("__ok")).select(*groups, "__r0", "__r1")
    slow_vals = (vals.join(side(missed), groups)
                     .groupBy(*groups, "__v", "__r0", "__r1").agg(F.count(F.lit(1)).alias("__cnt"))
                     .withColumn("__zero", F.lit(0).cast("bigint")))
    slow = _pick(slow_vals, groups, "__zero")

    picked = fast.unionByName(slow)
    a, b, t = F.col("__v0"), F.col("__v1"), F.col("__frac")
    lerp = F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)
    out = stats.select(*groups, "n", "__frac").join(picked, groups).select(
        *groups, "n", F.when(t == 0, a).otherwise(lerp).alias(out_col))
    if group_cols:
        return out
    return out.drop("__qgrp")


def quantile_scalar(df: DataFrame, value_col: str, q: float, **kw):
    """Exact quantile as a scalar-subquery ``Column`` (NULL on an empty input)."""
    return grouped_quantile(df, value_col, q, **kw).select(kw.get("out_col", "quantile")).scalar()


def wide_medians(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = (),
                 **kw) -> DataFrame:
    """Exact medians of many columns at once: stack to (group, feature, value) and run
    one grouped quantile (two passes for all columns together).  ``small_groups`` as in
    ``grouped_quantile``, for ``group_cols``; without them the groups are the columns."""
    kw.setdefault("small_groups", not group_cols)
    if not columns:
        raise ValueError("no columns")
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(*[f"`{g}`" for g in group_cols],
                         f"stack({len(columns)}, {pairs}) AS (feature, value)")
    return grouped_quantile(long, "value", 0.5, [*group_cols, "feature"], out_col="median", **kw)

"""Report tables.

Data behind the reference's figures and dashboard, as DataFrames (no drawing).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.functions.scalar import clip_lower0
from panelcast.operators.panel import attach_row
from panelcast.operators.reshape import pivot_mean

# Fallback order of models for the detailed report when the metrics
# table has no usable row.
MODEL_FALLBACK = ["gradient_boosting", "random_forest", "ridge", "linear_regression",
                  "neural_net_mlp", "xgboost"]


def best_model(metrics: DataFrame, *, by: str = "test_RMSE", group: Sequence[str] = ("tag",),
               exclude_prefix: str | None = None, fallback: str | None = None) -> DataFrame:
    """H2: per group, the model with the lowest score (NULL scores last, ties by model
    name).  ``exclude_prefix="baseline"`` drops baselines (dashboard / side B);
    ``fallback`` names a model for groups left empty."""
    m = metrics if exclude_prefix is None else metrics.filter(~F.col("model").startswith(exclude_prefix))
    w = Window.partitionBy(*group).orderBy(F.col(by).asc_nulls_last(), F.col("model"))
    best = m.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    if fallback is None:
        return best
    groups = metrics.select(*group).distinct()
    return (groups.join(best, list(group), "left")
                  .withColumn("model", F.coalesce(F.col("model"), F.lit(fallback))))


def leaderboard(metrics: DataFrame, by: str = "test_RMSE",
                cols: Sequence[str] = ("tag", "model", "test_RMSE", "test_MAE", "test_R2")) -> DataFrame:
    """H3: sort by score, NULLs last, ties by model name."""
    present = [c for c in cols if c in metrics.columns]
    return metrics.select(*present).orderBy(F.col(by).asc_nulls_last(), F.col("model"))


def top_k(df: DataFrame, by: str, k: int, tie_break: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """H4 / H5: the first k rows by a score (a top-k report: the limit is the feature).
    Spark plans ``TakeOrderedAndProject``: each partition keeps its own k best rows,
    so only partitions x k rows reach the final merge."""
    order = [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(),
             *[F.col(c) for c in tie_break]]
    return df.orderBy(*order).limit(int(k))


def run_comparison(metrics: DataFrame, *, exclude_prefix: str | None = "baseline",
                   reference_model: str = "baseline_roll3_mean") -> DataFrame:
    """Per tag, the best model (lowest test RMSE, baselines excluded by default)
    against the rolling-mean baseline: gain = baseline RMSE - best RMSE."""
    best = best_model(metrics, exclude_prefix=exclude_prefix).select(
        "tag", F.col("model").alias("best_model"), F.col("test_RMSE").alias("best_test_RMSE"),
        F.col("test_R2").alias("best_test_R2"))
    ref = metrics.filter(F.col("model") == reference_model).groupBy("tag").agg(
        F.first("test_RMSE").alias("baseline_roll3_test_RMSE"))
    return (best.join(ref, "tag", "left")
                .withColumn("rmse_gain_vs_roll3", F.col("baseline_roll3_test_RMSE") - F.col("best_test_RMSE")))


def histogram(df: DataFrame, col: str, bins: int = 30, min_values: int = 6,
              transform: str = "raw") -> DataFrame:
    """A10: equal-width histogram over [min, max] with the last bin closed (NumPy
    rules, including its edge corrections); values NULL -> dropped, clipped at 0;
    ``transform="log1p"`` bins log(1 + x).  Empty when fewer than ``min_values``
    values.  Returns every bin (``bin, lo, hi, count``), empty bins included."""
    x = clip_lower0(col)
    if transform == "log1p":
        x = F.log1p(x)
    vals = df.filter(F.col(col).isNotNull()).select(x.alias("x"))
    stats = vals.agg(F.min("x").alias("mn0"), F.max("x").alias("mx0"), F.count(F.lit(1)).alias("n"))
    stats = stats.filter(F.col("n") >= min_values).select(
        "n",
        F.when(F.col("mn0") == F.col("mx0"), F.col("mn0") - 0.5).otherwise(F.col("mn0")).alias("mn"),
        F.when(F.col("mn0") == F.col("mx0"), F.col("mx0") + 0.5).otherwise(F.col("mx0")).alias("mx"))
    nb = F.lit(float(bins))
    # the statistics row (at most one row by construction) is broadcast to the values
    v = (attach_row(vals, stats.select("mn", "mx"))
             .withColumn("step", (F.col("mx") - F.col("mn")) / nb)
             .withColumn("f", ((F.col("x") - F.col("mn")) * (nb / (F.col("mx") - F.col("mn")))).cast("int")))

    def edge(i):
        return F.when(i >= bins, F.col("mx")).otherwise(i * F.col("step") + F.col("mn"))
    # stepwise columns: each index refers to the previous one by name (no expression blow-up)
    v = v.withColumn("i0", F.when(F.col("f") >= bins, bins - 1).otherwise(F.col("f")))
    v = v.withColumn("i1", F.when(F.col("x") < edge(F.col("i0")), F.col("i0") - 1).otherwise(F.col("i0")))
    v = v.withColumn("bin", F.when((F.col("x") >= edge(F.col("i1") + 1)) & (F.col("i1") != bins - 1),
                                   F.col("i1") + 1).otherwise(F.col("i1")))
    counts = v.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select("mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) \
                .withColumn("step", (F.col("mx") - F.col("mn")) / nb)
    return (grid.join(counts, "bin", "left")
                .select(F.lit(transform).alias("scale"), F.col("bin").cast("int").alias("bin"),
                        edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
                        F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def eda_target(panel: DataFrame, target: str = "gdp_growth") -> DataFrame:
    """Target series per entity and period."""
    return panel.select("entity", "t", F.col(target).alias("target"))


def eda_events(panel: DataFrame) -> DataFrame:
    """Event count and log(1 + damage) per entity and period (damage clipped at 0)."""
    return panel.select("entity", "t", "n_events",
                        F.log1p(clip_lower0("total_damage")).alias("log_total_damage"))


def error_vs_proxy(predictions: DataFrame, features: DataFrame,
                   proxy: str = "damage_share_gdp_lag1", fallback: str | None = "n_events_lag1") -> DataFrame | None:
    """Prediction errors joined to a disaster proxy of the same (entity, t).
    When the proxy column is absent, ``fallback`` (event count, side B) is used;
    ``fallback=None`` returns None (side A: no figure)."""
    col = proxy if proxy in features.columns else fallback
    if col is None or col not in features.columns:
        return None
    return (predictions.join(features.select("entity", "t", col), ["entity", "t"], "left")
                       .select("entity", "t", "error", col))


def cv_stability(cv: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Fold x model mean validation RMSE (explicit model list saves a job)."""
    return pivot_mean(cv, "fold", "model", "val_RMSE", models)

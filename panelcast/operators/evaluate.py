"""Scoring.

Predictions are kept *long* and model-agnostic:
``model, side, entity, t, y, p, n_ev, dmg`` where ``n_ev`` / ``dmg`` are the lag-1
event count and damage share used for the shock subsets.  Any table of that shape
(predictions made elsewhere included) can be scored; every metric of every model
comes out of one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import is_finite
from panelcast.operators.quantile import grouped_quantile

PRED_COLUMNS = ["model", "side", "entity", "t", "y", "p", "n_ev", "dmg"]
SUBSETS = {"any_disaster": "any", "severe_disaster": "severe", "multi_event": "multi"}


def with_shock_proxies(ds: DataFrame, events_col: str = "n_events_lag1",
                       share_col: str = "damage_share_gdp_lag1") -> DataFrame:
    """A6 inputs: lag-1 event count and damage share, NULL (or absent) read as 0."""
    n_ev = F.coalesce(F.col(events_col).cast("double"), F.lit(0.0)) if events_col in ds.columns else F.lit(0.0)
    dmg = F.coalesce(F.col(share_col).cast("double"), F.lit(0.0)) if share_col in ds.columns else F.lit(0.0)
    return ds.withColumn("n_ev", n_ev).withColumn("dmg", dmg)


def train_mean(split: DataFrame, y: str = "y", side_col: str = "side") -> Column:
    """A2 as a scalar subquery."""
    return split.filter(F.col(side_col) == "train").agg(F.avg(y)).scalar()


def baseline_predictions(split: DataFrame, *, lag1: str = "gdp_growth_lag1",
                         roll3: str = "gdp_growth_roll3_mean") -> DataFrame:
    """M1-M3 in one pass: train mean, last value, rolling-3 mean else last value.
    One exploded array instead of a union of three scans."""
    split = with_shock_proxies(split) if "n_ev" not in split.columns else split
    mean_tr = train_mean(split)
    models = [F.struct(F.lit("baseline_mean_train").alias("model"), mean_tr.cast("double").alias("p")),
              F.struct(F.lit("baseline_last_year").alias("model"), F.col(lag1).cast("double").alias("p"))]
    if roll3 in split.columns:
        models.append(F.struct(F.lit("baseline_roll3_mean").alias("model"),
                               F.coalesce(F.col(roll3), F.col(lag1)).cast("double").alias("p")))
    return (split.select("side", "entity", "t", "y", "n_ev", "dmg", F.explode(F.array(*models)).alias("m"))
                 .select(F.col("m.model").alias("model"), "side", "entity", "t", "y",
                         F.col("m.p").alias("p"), "n_ev", "dmg"))


def severe_threshold(split: DataFrame, q: float = 0.85, *, fallback: str = "zero", min_pos: int = 3,
                     side_col: str = "side", approx: bool = False) -> DataFrame:
    """A5: one row (threshold, n_pos) from TRAIN rows only.

    Positive finite lag-1 damage shares of train rows; exact linear quantile ``q``
    floored at 0.  With fewer than ``min_pos`` positives: ``fallback="zero"`` gives
    0.0 (side A: every event row is then severe), ``"all"`` the quantile of all train
    values (side B), ``"none"`` NULL (empty severe group).  ``approx=True`` uses the
    one-pass approximate quantile instead of the exact one.
    """
    tr = split.filter(F.col(side_col) == "train")
    tr = with_shock_proxies(tr) if "dmg" not in tr.columns else tr
    pos = tr.filter(is_finite("dmg") & (F.col("dmg") > 0)).select("dmg")
    # one-row tables combined by one-row joins: no subquery inside the threshold row
    spark = split.sparkSession
    q_pos = grouped_quantile(pos, "dmg", q, exact=not approx).select(F.col("n").alias("n_pos"), F.col("quantile").alias("q"))
    row = spark.range(1).select(F.lit(1).alias("__k")).join(q_pos.withColumn("__k", F.lit(1)), "__k", "left")
    if fallback == "all":
        q_all = grouped_quantile(tr.filter(is_finite("dmg")).select("dmg"), "dmg", q, exact=not approx).select(
            F.col("quantile").alias("q_all")).withColumn("__k", F.lit(1))
        row = row.join(q_all, "__k", "left")
        fb = F.greatest(F.coalesce(F.col("q_all"), F.lit(0.0)), F.lit(0.0))
    elif fallback == "zero":
        fb = F.lit(0.0)
    elif fallback == "none":
        fb = F.lit(None).cast("double")
    else:
        raise ValueError("fallback must be 'zero', 'all' or 'none'")
    n_pos = F.coalesce(F.col("n_pos"), F.lit(0)).cast("bigint")
    thr = F.when(n_pos >= min_pos, F.greatest(F.col("q"), F.lit(0.0))).otherwise(fb)
    return row.select(thr.alias("threshold"), n_pos.alias("n_pos"))


def _r2(cond: Column, e2: Column, y: Column) -> Column:
    """R2 over rows where ``cond``: NULL below 2 rows; constant target gives 1.0 when
    perfect else 0.0 (the reference library's finite convention)."""
    n = F.count_if(cond)
    sse = F.sum(F.when(cond, e2))
    sst = F.var_pop(F.when(cond, y)) * n
    return (F.when(n < 2, F.lit(None).cast("double"))
             .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise(F.lit(1.0) - sse / sst))


def metrics_table(preds: DataFrame, threshold: DataFrame | None = None, *, severe_q: float = 0.85,
                  r2_min_n: int = 5, subset_min_n: int = 1,
                  meta: Mapping[str, object] | None = None) -> DataFrame:
    """A3-A7 + P17: one row per model (per tag and model, where predictions carry a tag) with train/test MAE, RMSE, R2, non-finite counts
    and the any / severe / multi test subsets.

    Non-finite predictions are counted, then replaced by the train mean of ``y``
    (one row per tag and model, broadcast: bounded by the number of models).
    """
    groups = ["tag", "model"] if "tag" in preds.columns else ["model"]
    mean_tr = (preds.filter(F.col("side") == "train").groupBy(*groups)
                    .agg(F.avg("y").alias("__mean_train")))
    df = preds.join(F.broadcast(mean_tr), groups, "left")
    ps = F.when(is_finite("p"), F.col("p")).otherwise(F.col("__mean_train"))
    df = df.withColumn("__e", F.col("y") - ps)
    if threshold is not None:
        tsc = threshold.select(F.struct("threshold", "n_pos").alias("s")).scalar()   # one subquery
        thr_col, npos_col = tsc["threshold"], tsc["n_pos"]
    else:
        thr_col, npos_col = F.lit(0.0), F.lit(None).cast("bigint")
    df = df.withColumn("__any", F.col("n_ev") > 0) \
           .withColumn("__severe", (F.col("n_ev") > 0) & (F.col("dmg") >= thr_col)) \
           .withColumn("__multi", F.col("n_ev") >= 2)
    e, y = F.col("__e"), F.col("y")
    e2 = e * e
    tr = F.col("side") == "train"
    te = F.col("side") == "test"

    aggs = [
        F.avg(F.when(tr, F.abs(e))).alias("train_MAE"),
        F.sqrt(F.avg(F.when(tr, e2))).alias("train_RMSE"),
        _r2(tr, e2, y).alias("train_R2"),
        F.avg(F.when(te, F.abs(e))).alias("test_MAE"),
        F.sqrt(F.avg(F.when(te, e2))).alias("test_RMSE"),
        _r2(te, e2, y).alias("test_R2"),
        F.count_if(tr & ~is_finite("p")).alias("n_nonfinite_pred_train"),
        F.count_if(te & ~is_finite("p")).alias("n_nonfinite_pred_test"),
    ]
    for name, key in SUBSETS.items():
        m = te & F.col(f"__{key}")
        cnt = F.count_if(m)
        aggs += [
            cnt.alias(f"test_count_{name}"),
            F.when(cnt >= subset_min_n, F.sqrt(F.avg(F.when(m, e2)))).alias(f"test_RMSE_{name}"),
            F.when(cnt >= subset_min_n, F.avg(F.when(m, F.abs(e)))).alias(f"test_MAE_{name}"),
            F.when(cnt >= F.lit(max(r2_min_n, subset_min_n)), _r2(m, e2, y)).alias(f"test_R2_{name}"),
        ]
    aggs += [
        F.count_if(te & (F.col("dmg") > 0)).alias("test_count_positive_damage_share"),
        F.count_if(tr).alias("n_train"),
        F.count_if(te).alias("n_test"),
    ]
    out = df.groupBy(*groups).agg(*aggs)
    out = out.select("*", F.lit(float(severe_q)).alias("severe_quantile_used"),
                     thr_col.alias("severe_threshold_damage_share_train"),
                     npos_col.alias("train_count_positive_damage_share"))
    if meta:
        out = out.select("*", *[F.lit(v).alias(k) for k, v in meta.items() if k not in groups])
    return out


def run_metadata(tag: str, mode: str, include_macro: bool, include_oil: bool, include_covid: bool,
                 start: int | None, test_ratio: float, n_features: int) -> dict:
    """Metadata carried on every metrics row (F13 sentinel for "no start")."""
    return {"tag": tag, "mode": mode, "include_macro": bool(include_macro),
            "include_oil": bool(include_oil), "include_covid": bool(include_covid),
            "start_year": -1 if start is None else int(start), "test_ratio": float(test_ratio),
            "n_features": int(n_features)}


def shock_table(metrics: DataFrame, model: str | None = None) -> DataFrame:
    """Three rows (subset, count, RMSE, MAE, R2, threshold) for one model (or all)."""
    m = metrics if model is None else metrics.filter(F.col("model") == model)
    parts = ", ".join(
        f"'{name}', `test_count_{name}`, `test_RMSE_{name}`, `test_MAE_{name}`, `test_R2_{name}`"
        for name in SUBSETS)
    return m.selectExpr("model", "severe_threshold_damage_share_train AS threshold",
                        f"stack({len(SUBSETS)}, {parts}) AS (subset, n, RMSE, MAE, R2)")


def model_summary(metrics: DataFrame, model: str | None = None) -> DataFrame:
    """train/test RMSE, MAE, R2 of the chosen model (or all models)."""
    m = metrics if model is None else metrics.filter(F.col("model") == model)
    return m.select("model", "train_RMSE", "test_RMSE", "train_MAE", "test_MAE", "train_R2", "test_R2")


def simple_scores(preds: DataFrame, group_cols: Sequence[str] = ("model", "side")) -> DataFrame:
    """RMSE, MAE, R2 per group (R2 NULL below 2 rows or on errors)."""
    e = F.col("y") - F.col("p")
    return preds.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg(F.abs(e)).alias("MAE"),
        _r2(F.lit(True), e * e, F.col("y")).alias("R2"))

"""One benchmark run and suites of runs.

``run_all_models`` = dataset -> chronological split -> expanding-fold CV report ->
baselines, least squares, ridge, forest, boosting -> one long predictions table ->
one metrics aggregate.  The split dataset is checkpointed once (the only reuse
point); everything the driver receives is bounded by folds x features x models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.operators import evaluate as ev
from panelcast.operators import split as sp
from panelcast.operators import trees as tr
from panelcast.operators import report as rp
from panelcast.operators.importance import permutation_importance, tree_importance
from panelcast.operators.linear import fit_linear_folds, fold_medians
from panelcast.plans import standard as st
from panelcast.plans.standard import RunConfig
from panelcast.sources import results as rs
from panelcast.session import materialize

ALL = tr.ALL
LINEAR_MODELS = {"linear_regression": 0.0, "ridge": 5.0}
PRED_KEEP = ["side", "entity", "t", "y", "n_ev", "dmg"]


@dataclass
class RunResult:
    metrics: DataFrame
    cv: DataFrame
    predictions: DataFrame
    features: list[str]
    fits: dict = field(default_factory=dict)
    best_params: dict = field(default_factory=dict)
    searches: dict = field(default_factory=dict)


def _fold_role(t, bounds: Sequence[tuple[int, object, object]]):
    """(fold, role) structs for a row at period ``t`` given collected fold bounds."""
    return F.filter(F.array(*[
        F.struct(F.lit(f).alias("fold"),
                 F.when(t <= F.lit(te), F.lit("train")).when(t <= F.lit(ve), F.lit("val")).alias("role"))
        for f, te, ve in bounds]), lambda s: s["role"].isNotNull())


def _scores(df: DataFrame, groups: Sequence[str], role_col: str, roles=("train", "val")) -> DataFrame:
    e2 = (F.col("y") - F.col("p")) ** 2
    aggs = []
    for r in roles:
        c = F.col(role_col) == r
        aggs += [F.sqrt(F.avg(F.when(c, e2))).alias(f"{r}_RMSE"), ev._r2(c, e2, F.col("y")).alias(f"{r}_R2")]
    return df.groupBy(*groups).agg(*aggs)


def run_all_models(spark: SparkSession, split: DataFrame, feats: Sequence[str], cfg: RunConfig, *,
                   models: Sequence[str] = ("linear_regression", "ridge", "random_forest", "gradient_boosting"),
                   rf_params: Mapping = tr.RF_DEFAULTS, gb_params: Mapping = tr.GB_LIBRARY_DEFAULTS,
                   tune_rf: bool = False, tune_gb: bool = False,
                   rf_grid: Mapping | None = None, gb_grid: Mapping | None = None,
                   n_splits: int = 5, cv: bool = True,
                   checkpoint: bool = True, bounds: Sequence[tuple] | None = None) -> RunResult:
    feats = list(feats)
    keep = list(dict.fromkeys(["side", "entity", "t", "y", "n_ev", "dmg", "gdp_growth_lag1",
                               "gdp_growth_roll3_mean", *feats]))
    s = split.select(*[c for c in keep if c in split.columns])
    if checkpoint:
        s = materialize(s)
    train = s.filter(F.col("side") == "train")

    if bounds is None:
        fb = sp.fold_bounds(train, n_splits).orderBy("fold").collect()     # <= n_splits rows
        bounds = [(int(r["fold"]), r["train_end_t"], r["val_end_t"]) for r in fb]
    bounds = [(int(f), te, ve) for f, te, ve in bounds]
    ends = [b[1] for b in bounds]
    med = fold_medians(train, feats, ends)
    fill = {f: {c: med.get((f, c)) for c in feats} for f in [-1, *range(len(bounds))]}

    lin = {m: a for m, a in LINEAR_MODELS.items() if m in models}
    fits = fit_linear_folds(train, feats, ends, lin, medians=med) if lin else {}

    # ---- trees: searches, then every fold's model and the final ones from one table of bins
    kinds = {k: dict(p) for k, p in (("random_forest", rf_params), ("gradient_boosting", gb_params)) if k in models}
    best_params, searches, cv_fits = {}, {}, {}
    folds = list(bounds) if cv else []
    if kinds:
        table = tr.bin_table(train, feats, tr.period_ends(bounds))
        units, names = [], []
        for kind, params in kinds.items():
            units += tr.fold_units(kind, params, folds, fill, tr.period_ends(bounds))
            names += [(kind, f) for f, _, _ in folds]
            if {"random_forest": tune_rf, "gradient_boosting": tune_gb}[kind] and bounds:
                grid = (rf_grid or tr.RF_GRID) if kind == "random_forest" else (gb_grid or tr.GB_GRID)
                best_params[kind], searches[kind] = tr.grid_search(train, feats, bounds, fill, kind, grid, table=table)
                params = tr.with_params(params, best_params[kind])
            units.append(tr.Unit(kind, params, dict(fill[ALL])))
            names.append((kind, ALL))
        made = dict(zip(names, tr.fit_units(spark, table, units), strict=True))
        for name, fit in made.items():
            if name[1] != ALL:
                cv_fits[name] = fit
            elif isinstance(fit, tr.Failed):
                raise ValueError(f"{name[0]} cannot be fitted: {fit}")
            else:
                fits[name] = fit

    # ---- CV report (M10): every model x fold, train and validation scores
    cv_parts = []
    if folds:
        rows = (train.select("entity", "t", "y", *feats, F.explode(_fold_role(F.col("t"), bounds)).alias("fr"))
                     .select(F.col("fr.fold").alias("fold"), F.col("fr.role").alias("role"), "entity", "t", "y", *feats))
        if lin:
            per_model = []
            for m in lin:
                expr = None
                for f, _, _ in bounds:
                    e = fits[(m, f)].predict_col()
                    expr = F.when(F.col("fold") == f, e) if expr is None else expr.when(F.col("fold") == f, e)
                per_model.append(F.struct(F.lit(m).alias("model"), expr.alias("p")))
            lp = rows.select("fold", "role", "y", F.explode(F.array(*per_model)).alias("mp")) \
                     .select(F.col("mp.model").alias("model"), "fold", "role", "y", F.col("mp.p").alias("p"))
            cv_parts.append(_scores(lp, ["model", "fold"], "role").withColumn("status", F.lit("ok")))
        if cv_fits:
            ok = {name: fit for name, fit in cv_fits.items() if not isinstance(fit, tr.Failed)}
            if ok:
                cv_parts.append(_scores(tr.score_folds(rows, ok, feats), ["model", "fold"], "role").withColumn("status", F.lit("ok")))
            failed = [(kind, f, None, None, None, None, f"fail:{fit}") for (kind, f), fit in cv_fits.items() if (kind, f) not in ok]
            if failed:      # a failing model keeps its row, as in the reference
                cv_parts.append(spark.createDataFrame(failed, "model string, fold int, train_RMSE double, train_R2 double, "
                                                              "val_RMSE double, val_R2 double, status string"))
    cv_df = None
    for part in cv_parts:
        part = part.select("fold", "model", "train_RMSE", "val_RMSE", "train_R2", "val_R2", "status")
        cv_df = part if cv_df is None else cv_df.unionByName(part)

    # ---- final fits and long predictions
    preds = [ev.baseline_predictions(s).select("model", *PRED_KEEP, "p")]
    if lin:
        arr = F.array(*[F.struct(F.lit(m).alias("model"), fits[(m, -1)].predict_col().alias("p")) for m in lin])
        preds.append(s.select(*PRED_KEEP, F.explode(arr).alias("mp"))
                      .select(F.col("mp.model").alias("model"), *PRED_KEEP, F.col("mp.p").alias("p")))
    for kind in kinds:
        fit = fits[(kind, ALL)]
        preds.append(fit.transform(s).select(F.lit(kind).alias("model"), *PRED_KEEP, "p"))
    long = preds[0]
    for part in preds[1:]:
        long = long.unionByName(part.select(*long.columns))

    thr = ev.severe_threshold(s, cfg.severe_q, fallback=cfg.fallback, min_pos=cfg.min_pos)
    meta = ev.run_metadata(cfg.tag, cfg.mode, cfg.include_macro, cfg.include_oil, cfg.include_covid,
                           cfg.start, cfg.test_ratio, len(feats))
    metrics = ev.metrics_table(long, thr, severe_q=cfg.severe_q, subset_min_n=cfg.subset_min_n, meta=meta)
    if cv_df is None:
        cv_df = spark.createDataFrame([], "fold int, model string, train_RMSE double, val_RMSE double, "
                                          "train_R2 double, val_R2 double, status string")
    return RunResult(metrics, cv_df.withColumn("tag", F.lit(cfg.tag)), long.withColumn("tag", F.lit(cfg.tag)),
                     feats, fits, best_params, searches)


def prepare_run(spark: SparkSession, sf_dir: str, cfg: RunConfig, features: DataFrame | None = None,
                n_splits: int = 5, checkpoint: bool | None = None):
    """Dataset, split and fold bounds from one aggregate.  The dataset is checkpointed
    unless told otherwise (default: unless ``features`` is given, i.e. already a
    checkpointed feature table).  Returns (split, features, bounds)."""
    ds, feats = st.dataset(spark, sf_dir, cfg, features)
    if checkpoint if checkpoint is not None else features is None:
        ds = materialize(ds)
    split, bounds = sp.chrono_split_with_folds(ds, cfg.test_ratio, n_splits)
    return ev.with_shock_proxies(split), feats, bounds


def run_config(spark: SparkSession, sf_dir: str, cfg: RunConfig, features: DataFrame | None = None,
               n_splits: int = 5, checkpoint: bool | None = None, **kw) -> RunResult:
    split, feats, bounds = prepare_run(spark, sf_dir, cfg, features, n_splits, checkpoint)
    return run_all_models(spark, split, feats, cfg, checkpoint=False, n_splits=n_splits, bounds=bounds, **kw)


def run_suite(spark: SparkSession, sf_dir: str, configs: Sequence[RunConfig], **kw) -> DataFrame:
    """Several specifications, one metrics table (unionByName).  The feature
    table is built once and checkpointed; every run reads it."""
    ft = materialize(st.feature_table(spark, sf_dir))
    out = None
    for cfg in configs:
        m = run_config(spark, sf_dir, cfg, features=ft, **kw).metrics
        out = m if out is None else out.unionByName(m)
    return out


def alpha_search(train: DataFrame, features: Sequence[str], bounds: Sequence[tuple], alphas: Sequence[float]) -> DataFrame:
    """(alpha, fold, val_RMSE, mean_val_RMSE, best) of ridge over expanding folds; the
    best alpha has the lowest mean (the smaller alpha on ties).  One Gram scan fits all
    candidates and folds, one pass scores them."""
    bounds = [(int(f), te, ve) for f, te, ve in bounds]
    fits = fit_linear_folds(train, features, [te for _, te, _ in bounds], {str(a): a for a in alphas})
    each = [F.struct(F.lit(f).alias("fold"), F.lit(float(a)).alias("alpha"), fits[(str(a), k)].predict_col().alias("p"),
                     ((F.col("t") > F.lit(te)) & (F.col("t") <= F.lit(ve))).alias("val"))
            for k, (f, te, ve) in enumerate(bounds) for a in alphas]
    rows = train.select("y", F.explode(F.array(*each)).alias("c")).filter("c.val")
    scored = rows.groupBy("c.alpha", "c.fold").agg(F.sqrt(F.avg((F.col("y") - F.col("c.p")) ** 2)).alias("val_RMSE"))
    means = scored.groupBy("alpha").agg(F.avg("val_RMSE").alias("mean_val_RMSE"))
    # a row per candidate: the list of alphas is a parameter
    order = Window.orderBy("mean_val_RMSE", "alpha")
    ranked = means.withColumn("best", F.row_number().over(order) == 1)
    return scored.join(ranked, "alpha").select("alpha", "fold", "val_RMSE", "mean_val_RMSE", "best")


def export_predictions(preds: DataFrame, model: str, side: str = "test") -> DataFrame:
    """Per-period predictions of one model with error and absolute error."""
    return (preds.filter((F.col("model") == model) & (F.col("side") == side))
                 .select("entity", "t", F.col("y").alias("actual"), F.col("p").alias("pred"),
                         (F.col("y") - F.col("p")).alias("error"), F.abs(F.col("y") - F.col("p")).alias("abs_error")))


def write_run(spark: SparkSession, result: RunResult, root: str, importance: DataFrame | None = None) -> dict[str, str]:
    """C4's outputs (S7) under ``root``, each a table with a partition for the run's tag: metrics, CV
    scores, the test predictions of the model with the lowest test RMSE, tuned parameters of
    each searched model with its table of scores, and permutation importance where given.
    Returns their paths by name."""
    metrics = materialize(result.metrics)
    best = rp.best_model(metrics).select("tag", "model").collect()      # one row a tag
    tag, model = best[0]["tag"], best[0]["model"]
    outputs = {"model_metrics": metrics, "cv_scores": result.cv,
               "predictions": export_predictions(result.predictions, model).withColumn("model", F.lit(model))}
    for kind, params in result.best_params.items():
        outputs[f"best_params_{kind}"] = tr.best_params_frame(spark, params)
        outputs[f"search_{kind}"] = result.searches[kind]
    if importance is not None:
        outputs["feature_importance"] = importance
    paths = {}
    for name, table in outputs.items():
        paths[name] = f"{root}/{name}"
        rs.write_tagged(table.withColumn("tag", F.lit(tag)), paths[name])
    return paths


def importance_for(result: RunResult, split: DataFrame, model: str, **kw) -> DataFrame:
    """M11 for a fitted model of a run, on its test rows."""
    fit = result.fits[(model, -1)]
    test = split.filter(F.col("side") == "test")
    if isinstance(fit, tr.TreeFit):
        return tree_importance(test, fit, **kw)

    def predict(df):
        return df.withColumn("p", fit.predict_col())
    return permutation_importance(test, result.features, predict, **kw)

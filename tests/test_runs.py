import numpy as np
from pyspark.sql import functions as F

from panelcast.operators import evaluate as ev
from panelcast.operators import features as fe
from panelcast.operators import split as sp
from panelcast.plans import runs
from panelcast.plans.standard import RunConfig, config_from_metrics


def synthetic_split(spark, n=40):
    rng = np.random.default_rng(7)
    rows = []
    for e in (1, 2):
        y = np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            rows.append((e, 1000 + i, float(y[i]), int(rng.integers(0, 3)), float(rng.exponential(100)),
                         float(50 + i)))
    panel = spark.createDataFrame(rows, "entity int, t int, gdp_growth double, n_events bigint, "
                                        "total_damage double, oil_price_usd double")
    panel = panel.withColumn("damage_share_gdp", F.col("total_damage") / 1e4) \
                 .withColumn("log_total_damage", F.log1p("total_damage")) \
                 .withColumn("total_deaths", F.col("n_events").cast("double")) \
                 .withColumn("avg_magnitude", F.lit(1.0))
    ds, feats = fe.make_dataset(fe.add_features(panel, regime_cutoff=1020), include_oil=True,
                                keep_extra=["gdp_growth_lag1", "gdp_growth_roll3_mean"])
    return ev.with_shock_proxies(sp.chrono_split(ds)), feats


def test_run_all_models_small(spark):
    split, feats = synthetic_split(spark)
    cfg = RunConfig(tag="run_test", include_oil=True)
    res = runs.run_all_models(spark, split, feats, cfg,
                              rf_params=dict(numTrees=10, maxDepth=3, minInstancesPerNode=2),
                              gb_params=dict(maxIter=10, stepSize=0.1, maxDepth=2, minInstancesPerNode=5))
    m = {r["model"]: r for r in res.metrics.collect()}
    assert set(m) == {"baseline_mean_train", "baseline_last_year", "baseline_roll3_mean",
                      "linear_regression", "ridge", "random_forest", "gradient_boosting"}
    for r in m.values():
        assert r["n_train"] + r["n_test"] == split.count()
        assert r["n_nonfinite_pred_test"] == 0 and r["tag"] == "run_test" and r["n_features"] == len(feats)
    # fitted models beat the train mean on train rows
    assert m["linear_regression"]["train_RMSE"] <= m["baseline_mean_train"]["train_RMSE"]
    assert m["ridge"]["train_RMSE"] <= m["baseline_mean_train"]["train_RMSE"] + 1e-9
    cv = res.cv.collect()
    k = len({r["fold"] for r in cv})
    assert k >= 2 and all(r["status"] == "ok" for r in cv) and len(cv) == 4 * k
    imp = runs.importance_for(res, split, "ridge", n_repeats=3).collect()
    assert {r["feature"] for r in imp} == set(feats)
    ex = runs.export_predictions(res.predictions, "ridge").collect()
    assert all(abs(r["error"] - (r["actual"] - r["pred"])) < 1e-12 for r in ex)


def test_seed_stable_trees(spark):
    split, feats = synthetic_split(spark)
    cfg = RunConfig(tag="run_seed")
    kw = dict(models=("random_forest",), cv=False, rf_params=dict(numTrees=5, maxDepth=3, minInstancesPerNode=1))
    a = runs.run_all_models(spark, split, feats, cfg, **kw).metrics.filter("model='random_forest'").first()
    b = runs.run_all_models(spark, split, feats, cfg, **kw).metrics.filter("model='random_forest'").first()
    assert a["test_RMSE"] == b["test_RMSE"]


def test_config_from_metrics(spark):
    m = spark.createDataFrame([("run_x", "nowcast", "true", "0", "yes", "23964", "0.25")],
                              "tag string, mode string, include_covid string, include_macro string, "
                              "include_oil string, start_year string, test_ratio string")
    c = config_from_metrics(m, "run_x")
    assert (c.mode, c.include_covid, c.include_macro, c.include_oil, c.start, c.test_ratio) == \
        ("nowcast", True, False, True, 23964, 0.25)
    c2 = config_from_metrics(m, "run_nowcast_ex_post_restricted_oil")      # no row: from the tag text
    assert c2.mode == "nowcast" and c2.include_covid and c2.include_oil and c2.start is not None


def test_written_run_and_failed_fold(spark, tmp_path):
    """A run's tables under its tag, tuned parameters read back, and a model that fails on its folds."""
    from panelcast.operators import trees as tr
    from panelcast.sources import results as rs
    split, feats = synthetic_split(spark)
    cfg = RunConfig(tag="run_written")
    grid = {"maxIter": [2, 4], "stepSize": [0.1], "maxDepth": [1, 2], "l2": [0.0], "minInstancesPerNode": [5]}
    res = runs.run_all_models(spark, split, feats, cfg, models=("gradient_boosting",), tune_gb=True, gb_grid=grid,
                              gb_params=dict(maxIter=2, stepSize=0.1, maxDepth=1, minInstancesPerNode=5))
    imp = runs.importance_for(res, split, "gradient_boosting", n_repeats=2)
    paths = runs.write_run(spark, res, str(tmp_path), imp)
    assert set(paths) == {"model_metrics", "cv_scores", "predictions", "best_params_gradient_boosting", "search_gradient_boosting", "feature_importance"}
    back = {name: rs.read_tagged(spark, path, "run_written", missing="error").collect() for name, path in paths.items()}
    assert {r["model"] for r in back["model_metrics"]} >= {"gradient_boosting", "baseline_mean_train"}
    assert len(back["predictions"]) == split.filter("side = 'test'").count() and len(back["feature_importance"]) == len(feats)
    params = rs.read_best_params(spark, paths["best_params_gradient_boosting"], "run_written", "gradient_boosting")
    assert tr.with_params(dict(maxIter=99), params)["maxIter"] in (2, 4)
    assert {k: v for k, v in tr.with_params({}, params).items()} == res.best_params["gradient_boosting"]

    real = tr.fit_units
    def broken(spark, table, units):        # folds get a rule that no tree can grow by
        return real(spark, table, [u if u.last is None else tr.Unit(u.kind, u.params | {"l2": -1.0}, u.fill, u.last, u.until) for u in units])
    tr.fit_units = broken
    try:
        res = runs.run_all_models(spark, split, feats, cfg, models=("gradient_boosting", "ridge"),
                                  gb_params=dict(maxIter=2, stepSize=0.1, maxDepth=1, minInstancesPerNode=5))
        rows = res.cv.collect()
    finally:
        tr.fit_units = real
    assert {r["status"] for r in rows if r["model"] == "gradient_boosting"} == {"fail:ValueError"}
    assert {r["status"] for r in rows if r["model"] == "ridge"} == {"ok"}

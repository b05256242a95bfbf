import numpy as np

from panelcast.operators import report as rp


def metrics(spark, rows):
    return spark.createDataFrame(rows, "tag string, model string, test_RMSE double, test_R2 double")


def test_best_model_ties_and_nulls(spark):
    m = metrics(spark, [("a", "ridge", 1.0, 0.1), ("a", "linear_regression", 1.0, 0.2), ("a", "rf", None, None),
                        ("b", "baseline_roll3_mean", 2.0, 0.0), ("b", "rf", None, None)])
    best = {r["tag"]: r["model"] for r in rp.best_model(m).collect()}
    assert best == {"a": "linear_regression", "b": "baseline_roll3_mean"}
    nb = {r["tag"]: r["model"] for r in rp.best_model(m, exclude_prefix="baseline").collect()}
    assert nb["b"] == "rf"


def test_run_comparison(spark):
    m = metrics(spark, [("a", "ridge", 1.5, 0.1), ("a", "baseline_roll3_mean", 2.0, 0.0),
                        ("b", "ridge", 3.0, 0.0)])
    out = {r["tag"]: r for r in rp.run_comparison(m).collect()}
    assert out["a"]["rmse_gain_vs_roll3"] == 0.5
    assert out["b"]["baseline_roll3_test_RMSE"] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.lognormal(10, 2, 500), np.zeros(100)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "total_damage double")
    for transform, x in (("raw", vals), ("log1p", np.log1p(vals))):
        out = rp.histogram(df, "total_damage", transform=transform).orderBy("bin").collect()
        counts, edges = np.histogram(x, bins=30)
        assert [r["count"] for r in out] == counts.tolist()
        np.testing.assert_allclose([r["lo"] for r in out], edges[:-1], rtol=1e-12)


def test_histogram_needs_six_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "total_damage double")
    assert rp.histogram(df, "total_damage").count() == 0


def test_top_k(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 5.0), (4, 1.0)], "t int, abs_error double")
    assert [r["t"] for r in rp.top_k(df, "abs_error", 2, ["t"]).collect()] == [2, 3]

import numpy as np
import pytest

from panelcast.operators.linear import fit_linear, fit_linear_folds


def numpy_fit(X, y, alpha):
    med = np.array([0.0 if np.all(np.isnan(c)) else np.nanmedian(c) for c in X.T])
    Xf = np.where(np.isnan(X), med, X)
    mu, sd = Xf.mean(0), Xf.std(0)
    sd[sd == 0] = 1.0
    Z = (Xf - mu) / sd
    yc = y - y.mean()
    if alpha > 0:
        w = np.linalg.solve(Z.T @ Z + alpha * np.eye(Z.shape[1]), Z.T @ yc)
    else:
        w = np.linalg.lstsq(Z, yc, rcond=None)[0]
    return lambda Xn: y.mean() + ((np.where(np.isnan(Xn), med, Xn) - mu) / sd) @ w


def frame(spark, X, y):
    cols = [f"x{j}" for j in range(X.shape[1])]
    rows = [(100 + i, float(y[i]), *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "t int, y double, " + ", ".join(f"{c} double" for c in cols)), cols


def predict(spark, fit, X, y):
    df, cols = frame(spark, X, y)
    return np.array([r["p"] for r in df.withColumn("p", fit.predict_col()).orderBy("t").collect()])


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_matches_numpy_with_missing_and_empty(spark, alpha):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 4)) * [1, 10, 100, 1] + [0, 5, 2e4, 0]
    X[rng.random((40, 4)) < 0.2] = np.nan
    X[:, 3] = np.nan                               # all-NULL column in train
    y = rng.normal(size=40)
    df, cols = frame(spark, X, y)
    fit = fit_linear(df, cols, alpha)
    ref = numpy_fit(X, y, alpha)
    np.testing.assert_allclose(predict(spark, fit, X, y), ref(X), rtol=1e-8, atol=1e-8)


def test_min_norm_rank_deficient(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 3))
    X = np.concatenate([base, base[:, :1], rng.normal(size=(5, 4))], axis=1)   # 8 cols, 5 rows, a duplicate
    y = rng.normal(size=5)
    df, cols = frame(spark, X, y)
    fit = fit_linear(df, cols, 0.0)
    ref = numpy_fit(X, y, 0.0)
    p = predict(spark, fit, X, y)
    np.testing.assert_allclose(p, ref(X), atol=1e-7)
    np.testing.assert_allclose(p, y, atol=1e-7)        # interpolates: train RMSE ~ 0


def test_folds_from_one_scan(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(30, 3))
    X[rng.random((30, 3)) < 0.15] = np.nan
    y = rng.normal(size=30)
    df, cols = frame(spark, X, y)
    ends = [109, 119]
    fits = fit_linear_folds(df, cols, ends, {"ols": 0.0, "ridge": 5.0})
    for f, e in enumerate(ends):
        n = e - 100 + 1
        for name, a in (("ols", 0.0), ("ridge", 5.0)):
            ref = numpy_fit(X[:n], y[:n], a)
            np.testing.assert_allclose(predict(spark, fits[(name, f)], X, y), ref(X), rtol=1e-7, atol=1e-7)


def test_nearly_collinear_features_keep_their_digits(spark):
    """Condition 1e8: the factors agree with lstsq on the rows; a Gram matrix would lose all of it."""
    rng = np.random.default_rng(8)
    t = np.arange(23000.0, 23200.0)
    X = np.stack([t, t * t, rng.normal(size=200)], axis=1)
    X = np.concatenate([X, X[:, 2:] + 1e-8 * rng.normal(size=(200, 1))], axis=1)
    Z = (X - X.mean(0)) / X.std(0)
    assert np.linalg.cond(Z) > 5e7
    y = 0.3 * Z[:, 0] + 2 * Z[:, 2] + rng.normal(size=200)
    df, cols = frame(spark, X, y)
    for parts in (1, 7):
        fit = fit_linear(df.repartition(parts), cols, 0.0)
        ref = numpy_fit(X, y, 0.0)
        np.testing.assert_allclose(predict(spark, fit, X, y), ref(X), rtol=1e-6, atol=1e-6)


def test_factors_of_well_conditioned_rows_match_to_nine_digits(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 5)) * [1, 1e3, 1e-3, 1, 5] + [0, 1e6, 0, 2, 0]
    y = X @ [1, 1e-3, 1e3, -2, 0.1] + rng.normal(size=300)
    df, cols = frame(spark, X, y)
    for alpha in (0.0, 5.0):
        np.testing.assert_allclose(predict(spark, fit_linear(df.repartition(9), cols, alpha), X, y), numpy_fit(X, y, alpha)(X), rtol=1e-9, atol=1e-9)


def test_no_rows_is_an_error(spark):
    df, cols = frame(spark, np.ones((2, 1)), np.ones(2))
    with pytest.raises(ValueError):
        fit_linear(df.limit(0), cols)

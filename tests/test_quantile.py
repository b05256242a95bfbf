import numpy as np
from pyspark.sql import functions as F

from panelcast.operators.quantile import grouped_quantile, wide_medians


def q(spark, vals, p, **kw):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    return grouped_quantile(df, "x", p, **kw).first()["quantile"]


def test_small_known_values(spark):
    assert q(spark, [1, 2, 10, 20], 0.5) == 6.0
    assert abs(q(spark, [1, 2, 10, 20], 0.85) - 15.5) < 1e-12


def test_matches_numpy_with_ties(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.zeros(2000), rng.integers(0, 5, 1000)])
    for p in (0.0, 0.1, 0.5, 0.75, 0.85, 1.0):
        got = q(spark, vals, p, accuracy=1000)
        assert abs(got - float(np.quantile(vals, p))) < 1e-12, p


def test_grouped_and_nulls(spark):
    rows = [("a", float(i)) for i in range(11)] + [("b", None), ("b", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: (r["n"], r["quantile"]) for r in grouped_quantile(df, "x", 0.5, ["g"]).collect()}
    assert out == {"a": (11, 5.0), "b": (1, 5.0)}          # all-NULL group absent


def test_wide_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (10.0, None), (20.0, 8.0)], "a double, b double")
    m = {r["feature"]: r["median"] for r in wide_medians(df, ["a", "b"]).collect()}
    assert m == {"a": 6.0, "b": 6.0}


def test_fallback_path_is_exact(spark):
    rng = np.random.default_rng(11)
    vals = rng.normal(0, 1, 2001)
    for p in (0.3, 0.5, 0.85):
        got = q(spark, vals, p, bracket=0.0)       # zero-width bracket misses: full fallback
        assert abs(got - float(np.quantile(vals, p))) < 1e-12, p


def test_approx_option_close(spark):
    rng = np.random.default_rng(13)
    vals = rng.normal(0, 1, 5000)
    got = q(spark, vals, 0.5, exact=False, accuracy=10000)
    assert abs(got - float(np.quantile(vals, 0.5))) < 0.01

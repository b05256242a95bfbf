import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcast.operators import features as fe
from panelcast.operators import trees as tr
from panelcast.operators.linear import fit_linear


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = [(e, 100 + i, float(rng.normal()), int(rng.integers(0, 3)), float(rng.exponential(5)), 1.0 + i)
            for e in (1, 2, 3) for i in range(20)]
    schema = "entity int, t int, gdp_growth double, n_events bigint, total_damage double, oil_price_usd double"
    a = fe.add_features(spark.createDataFrame(rows, schema)).orderBy("entity", "t").toPandas()
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    b = fe.add_features(spark.createDataFrame(shuffled, schema).repartition(7)).orderBy("entity", "t").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_boosting_collapses_to_train_mean(spark):
    # with fewer than 2 * minInstancesPerNode rows no split is possible: constant = mean
    rng = np.random.default_rng(10)
    rows = [(float(rng.normal()), float(rng.normal()), float(rng.normal(3, 1))) for _ in range(25)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fit = tr.fit_tree(df, ["a", "b"], {"a": 0.0, "b": 0.0}, "gradient_boosting",
                      dict(maxIter=20, stepSize=0.1, maxDepth=3, minInstancesPerNode=20))
    p = [r["p"] for r in fit.transform(df).collect()]
    assert max(p) - min(p) < 1e-12
    assert abs(p[0] - np.mean([r[2] for r in rows])) < 1e-9


def test_ridge_equals_mllib_normal_solver(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(12)
    n, alpha = 60, 5.0
    X = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2]
    y = X @ [1.0, -0.5, 2.0] + rng.normal(size=n)
    rows = [(100 + i, float(y[i]), *map(float, X[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "t int, y double, x0 double, x1 double, x2 double")
    fit = fit_linear(df, ["x0", "x1", "x2"], alpha)
    ours = np.array([r["p"] for r in df.withColumn("p", fit.predict_col()).orderBy("t").collect()])
    # MLlib on standardised features: regParam = alpha / n * std_pop(y), label scaled inside
    mu, sd = X.mean(0), X.std(0)
    zrows = [(100 + i, float(y[i]), *map(float, (X[i] - mu) / sd)) for i in range(n)]
    zdf = VectorAssembler(inputCols=["z0", "z1", "z2"], outputCol="features").transform(
        spark.createDataFrame(zrows, "t int, y double, z0 double, z1 double, z2 double"))
    lr = LinearRegression(labelCol="y", elasticNetParam=0.0, solver="normal", standardization=False,
                          regParam=alpha / n * float(np.std(y)))
    theirs = np.array([r["prediction"] for r in lr.fit(zdf).transform(zdf).orderBy("t").collect()])
    np.testing.assert_allclose(ours, theirs, rtol=1e-9, atol=1e-9)

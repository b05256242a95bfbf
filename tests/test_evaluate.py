import math

from pyspark.sql import functions as F

from panelcast.operators import evaluate as ev


def preds(spark, rows):
    return spark.createDataFrame(rows, "model string, side string, entity int, t int, y double, p double, "
                                       "n_ev double, dmg double")


def test_subset_rules_and_r2(spark):
    rows = [("m", "train", 1, i, float(i), float(i) + 0.5, 0.0, 0.0) for i in range(6)]
    # test rows: 1 'any' row, 4 'multi' rows, none severe-positive beyond threshold
    rows += [("m", "test", 1, 10, 1.0, 2.0, 1.0, 0.0)]
    rows += [("m", "test", 1, 11 + i, float(i), float(i) + 1.0, 2.0, 0.0) for i in range(4)]
    m = ev.metrics_table(preds(spark, rows)).first()
    assert m["test_count_any_disaster"] == 5 and m["test_count_multi_event"] == 4
    assert m["test_RMSE_multi_event"] == 1.0 and m["test_R2_multi_event"] is None   # 4 rows < 5
    assert m["test_R2_any_disaster"] is not None                                    # 5 rows
    assert abs(m["train_RMSE"] - 0.5) < 1e-12
    thr = ev.severe_threshold(spark.createDataFrame([("train", 0.0)], "side string, dmg double")).first()
    assert thr["threshold"] == 0.0 and thr["n_pos"] == 0


def test_zero_rows_subset_is_null(spark):
    rows = [("m", "train", 1, 0, 1.0, 1.0, 0.0, 0.0), ("m", "train", 1, 1, 2.0, 2.0, 0.0, 0.0),
            ("m", "test", 1, 2, 3.0, 2.0, 0.0, 0.0)]
    m = ev.metrics_table(preds(spark, rows)).first()
    assert m["test_count_any_disaster"] == 0 and m["test_RMSE_any_disaster"] is None
    assert m["test_R2"] is None                       # one test row
    assert m["train_R2"] == 1.0                       # perfect fit


def test_constant_target_r2(spark):
    rows = [("m", "test", 1, i, 2.0, 3.0, 0.0, 0.0) for i in range(3)]
    rows += [("m", "train", 1, 9, 2.0, 2.0, 0.0, 0.0)]
    assert ev.metrics_table(preds(spark, rows)).first()["test_R2"] == 0.0


def test_nonfinite_counted_then_replaced(spark):
    rows = [("m", "train", 1, 0, 1.0, 1.0, 0.0, 0.0), ("m", "train", 1, 1, 3.0, 3.0, 0.0, 0.0),
            ("m", "test", 1, 2, 2.0, float("nan"), 0.0, 0.0), ("m", "test", 1, 3, 2.0, float("inf"), 0.0, 0.0),
            ("m", "test", 1, 4, 2.0, None, 0.0, 0.0)]
    m = ev.metrics_table(preds(spark, rows)).first()
    assert m["n_nonfinite_pred_test"] == 3 and m["n_nonfinite_pred_train"] == 0
    assert m["test_RMSE"] == 0.0                      # replaced by the train mean 2.0


def split_rows(spark, dmg_values):
    rows = [("train", float(v)) for v in dmg_values] + [("test", 0.5)]
    return spark.createDataFrame(rows, "side string, dmg double")


def test_threshold_fallbacks(spark):
    assert ev.severe_threshold(split_rows(spark, [0, 1.0, 2.0])).first()["threshold"] == 0.0      # 2 positives
    r = ev.severe_threshold(split_rows(spark, [1.0, 2.0, 10.0]), 0.5).first()
    assert r["threshold"] == 2.0 and r["n_pos"] == 3
    r = ev.severe_threshold(split_rows(spark, [1, 2, 10, 20, 30]), 0.85).first()
    import numpy as np
    assert abs(r["threshold"] - np.quantile([1, 2, 10, 20, 30], 0.85)) < 1e-12
    r = ev.severe_threshold(split_rows(spark, [0, 0, 1.0, 2.0]), 0.75, fallback="all", min_pos=5).first()
    assert abs(r["threshold"] - np.quantile([0, 0, 1.0, 2.0], 0.75)) < 1e-12
    assert ev.severe_threshold(split_rows(spark, [1.0]), fallback="none").first()["threshold"] is None


def test_baselines(spark):
    rows = [("train", 1, 0, 1.0, None, None), ("train", 1, 1, 3.0, 1.0, None), ("test", 1, 2, 5.0, 3.0, 2.0)]
    s = spark.createDataFrame(rows, "side string, entity int, t int, y double, gdp_growth_lag1 double, "
                                    "gdp_growth_roll3_mean double")
    p = {(r["model"], r["t"]): r["p"] for r in ev.baseline_predictions(s).collect()}
    assert p[("baseline_mean_train", 2)] == 2.0
    assert p[("baseline_last_year", 2)] == 3.0
    assert p[("baseline_roll3_mean", 2)] == 2.0 and p[("baseline_roll3_mean", 1)] == 1.0

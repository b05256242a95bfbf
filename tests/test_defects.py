"""Cases that the test tables do not reach: text measures, tags, flags, absent blocks."""

import pytest
from pyspark.sql import functions as F

from panelcast.functions import scalar as fs
from panelcast.operators import evaluate as ev
from panelcast.operators import features as fe
from panelcast.operators import importance as im
from panelcast.operators import panel as pn
from panelcast.plans.standard import config_from_metrics


def test_text_measures_become_unknown(spark):
    e = spark.createDataFrame([("A", 1, "3", "..", "x"), ("A", 1, "n/a", "2.5", "1")],
                              "entity string, t int, deaths string, damage_usd_thousands string, magnitude string")
    for scale in (None, 6):
        r = pn.aggregate_events(e, decimal_scale=scale).first()
        assert (r["n_events"], r["total_deaths"], r["total_damage"], r["avg_magnitude"]) == (2, 3.0, 2500.0, 0.5)


def test_flags_read_numbers_tokens_and_other_text(spark):
    rows = [("1.0", True), ("2", True), ("0.0", False), ("yes", True), ("N", False), ("perhaps", False), (None, True), (" t ", True)]
    df = spark.createDataFrame(rows, "v string, want boolean")
    for r in df.select("want", fs.tolerant_bool("v", default=True).alias("got")).collect():
        assert r["got"] == r["want"]
    assert spark.range(1).select(fs.safe_int(F.lit("-1.5"))).first()[0] == -1


def test_metrics_keep_tags_apart(spark):
    rows = [("a", "m", s, 1.0, 1.0) for s in ("train", "test")] + [("b", "m", s, 1.0, 2.0) for s in ("train", "test")]
    p = spark.createDataFrame(rows, "tag string, model string, side string, y double, p double").withColumns(
        {"entity": F.lit("A"), "t": F.lit(1), "n_ev": F.lit(0.0), "dmg": F.lit(0.0)})
    assert {r["tag"]: r["test_RMSE"] for r in ev.metrics_table(p).collect()} == {"a": 0.0, "b": 1.0}


def test_non_finite_predictions_take_the_train_mean(spark):
    rows = [("train", 2.0, 2.0), ("train", 4.0, 4.0), ("test", 3.0, float("nan")), ("test", 5.0, None)]
    p = spark.createDataFrame(rows, "side string, y double, p double").withColumns(
        {"model": F.lit("m"), "entity": F.lit("A"), "t": F.lit(1), "n_ev": F.lit(0.0), "dmg": F.lit(0.0)})
    r = ev.metrics_table(p).first()
    assert (r["n_nonfinite_pred_test"], r["test_MAE"]) == (2, 1.0)


def test_absent_blocks_are_reported(spark):
    ds = spark.createDataFrame([(1, 1.0)], "t int, gdp_growth_lag1 double")
    got = {r["feature"]: r["coverage"] for r in fe.feature_coverage(ds, fe.requested_features(include_macro=True)).collect()}
    assert got["t"] == 1.0 and all(got[c] == 0.0 for c in fe.MACRO_FEATURES)
    with pytest.raises(ValueError):
        fe.requested_features(mode="backcast")


def test_configuration_from_the_tag_alone(spark):
    empty = spark.createDataFrame([], "tag string, mode string")
    cfg = config_from_metrics(empty, "run_nowcast_ex_post_restricted_macro_oil")
    assert (cfg.mode, cfg.include_covid, cfg.include_macro, cfg.include_oil) == ("nowcast", True, True, True) and cfg.start
    plain = config_from_metrics(empty, "run_forecast_strict_main")
    assert (plain.mode, plain.include_macro, plain.start) == ("forecast", False, None)


def test_global_rank_is_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7919 % 503).alias("k"))
    got = {}
    for r in im.global_rank(df, "g", ["k"]).collect():
        got.setdefault(r["g"], []).append((r["k"], r["rank"]))
    for rows in got.values():
        assert [k for _, k in sorted(rows)] == list(range(1, len(rows) + 1))


def test_merge_multiplies_repeated_keys_as_joins_do(spark):
    from panelcast.operators.panel import merge_series
    a = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (1, 2, None), (None, 1, 9.0), (None, 1, 9.0)], "entity int, t int, a double")
    b = spark.createDataFrame([(1, 1, 5.0), (1, 1, 6.0), (1, 1, 6.0), (2, 1, 7.0), (None, 1, 8.0)], "entity int, t int, b double")
    c = spark.createDataFrame([(1, 1, 3.0), (3, 3, None)], "entity int, t int, c double")

    def rows(df):
        return sorted(map(repr, df.select("entity", "t", "a", "b", "c").collect()))

    assert rows(merge_series([a, b, c])) == rows(merge_series([a, b, c], how="join"))
    assert merge_series([a, b, c]).filter("entity = 1 and t = 1").count() == 6
    assert merge_series([a.limit(0), b.limit(0), c.limit(0)]).count() == 0

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcast.operators import features as fe
from panelcast.operators import panel as pn


def panel_frame(spark, rows):
    return spark.createDataFrame(rows, "entity int, t int, gdp_growth double, n_events bigint, "
                                       "total_damage double, oil_price_usd double")


def test_lags_and_rolling_match_pandas(spark):
    rng = np.random.default_rng(3)
    ys = rng.normal(1, 2, 15)
    rows = [(1, 100 + i, float(ys[i]), int(i % 3), float(i * 10), float(50 + i)) for i in range(15)]
    out = fe.add_features(panel_frame(spark, rows)).orderBy("t").toPandas()
    s = pd.Series(ys).shift(1)
    np.testing.assert_allclose(out["gdp_growth_lag1"], s, equal_nan=True)
    np.testing.assert_allclose(out["gdp_growth_lag2"], pd.Series(ys).shift(2), equal_nan=True)
    np.testing.assert_allclose(out["gdp_growth_roll3_mean"], s.rolling(3).mean(), equal_nan=True, rtol=1e-12)
    np.testing.assert_allclose(out["gdp_growth_roll5_mean"], s.rolling(5).mean(), equal_nan=True, rtol=1e-12)
    np.testing.assert_allclose(out["gdp_growth_roll5_std"], s.rolling(5).std(), equal_nan=True, rtol=1e-9)
    oil = pd.Series([50.0 + i for i in range(15)])
    np.testing.assert_allclose(out["oil_price_usd_change"], oil.diff(), equal_nan=True)
    np.testing.assert_allclose(out["oil_price_usd_change_lag1"], oil.diff().shift(1), equal_nan=True)
    assert list(out["t2"]) == [(100 + i) ** 2 for i in range(15)]


def test_gap_positional_vs_calendar(spark):
    rows = [(1, 100, 1.0, 0, 0.0, 1.0), (1, 101, 2.0, 0, 0.0, 1.0), (1, 103, 4.0, 0, 0.0, 1.0)]
    df = panel_frame(spark, rows)
    out = fe.add_features(df).orderBy("t").collect()
    assert out[2]["gdp_growth_lag1"] == 2.0                      # previous row
    cal = fe.calendar_lag(df, "gdp_growth", 1).orderBy("t").collect()
    assert cal[2]["gdp_growth_clag1"] is None                    # t-1 = 102 absent


def test_start_filter_keeps_lags_before_start(spark):
    rows = [(1, 100 + i, float(i), 0, 0.0, 1.0) for i in range(10)]
    ft = fe.add_features(panel_frame(spark, rows))
    ds, feats = fe.make_dataset(ft, start=105)
    first = ds.orderBy("t").first()
    assert first["t"] == 105 and first["gdp_growth_lag1"] == 4.0 and first["gdp_growth_roll5_mean"] == 2.0


def test_metamorphic_future_rows_and_second_entity(spark):
    rows = [(1, 100 + i, float(i * i % 7), i % 2, float(i), 1.0 + i) for i in range(12)]
    base = fe.add_features(panel_frame(spark, rows)).filter("t < 110").orderBy("t").toPandas()
    more = rows + [(1, 112 + i, 99.0, 5, 1e6, 7.0) for i in range(3)] + \
        [(2, 100 + i, -float(i), 1, 3.0, 2.0) for i in range(12)]
    again = fe.add_features(panel_frame(spark, more)).filter("entity = 1 AND t < 110").orderBy("t").toPandas()
    pd.testing.assert_frame_equal(base, again)


def test_feature_sets(spark):
    cols = ["t", "t2", "covid_dummy", *fe.BASE_FEATURES, *fe.MACRO_FEATURES, *fe.OIL_FEATURES,
            *fe.NOWCAST_FEATURES, *fe.NOWCAST_OIL]
    size = lambda **kw: len(fe.feature_list(cols, **kw))
    assert size() == 12
    assert size(include_covid=True) == 13
    assert fe.feature_list(cols, include_covid=True)[2] == "covid_dummy"
    assert size(include_macro=True) == 17
    assert size(include_oil=True) == 14
    assert size(mode="nowcast") == 18
    assert size(mode="nowcast", include_oil=True) == 22
    assert size(mode="nowcast", include_oil=True, include_macro=True, include_covid=True) == 28


def test_event_aggregation_rules(spark):
    ev = spark.createDataFrame([(1, 5, 2.0, 1000.0, None), (1, 5, None, None, 4.0), (1, 6, 1.0, 10.0, 3.0)],
                               "entity int, t int, deaths double, damage_usd double, magnitude double")
    out = {r["t"]: r for r in pn.aggregate_events(ev).collect()}
    assert out[5]["n_events"] == 2 and out[5]["total_deaths"] == 2.0 and out[5]["total_damage"] == 1000.0
    assert out[5]["avg_magnitude"] == 2.0            # unknown counted as 0 before the mean
    known = {r["t"]: r for r in pn.aggregate_events(ev, known_only=True).collect()}
    assert known[5]["avg_magnitude"] == 4.0


def test_merge_series_equals_join_chain(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "entity int, t int, a double")
    b = spark.createDataFrame([(1, 2, 20.0), (1, 3, 30.0)], "entity int, t int, b double")
    c = spark.createDataFrame([(2, 1, 5.0)], "entity int, t int, c double")
    m1 = sorted(tuple(r) for r in pn.merge_series([a, b, c]).select("entity", "t", "a", "b", "c").collect())
    m2 = sorted(tuple(r) for r in pn.merge_series([a, b, c], how="join").select("entity", "t", "a", "b", "c").collect())
    assert m1 == m2 and len(m1) == 4

from pyspark.sql import functions as F

from panelcast.functions import scalar as fs


def test_safe_double_dirty_tokens(spark):
    vals = ["..", "1,234", "NaN", "", "12d", "1.0f", " 3.5 ", "-2e3", "inf", None, ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(fs.safe_double("s")).collect()]
    assert got == [None, None, None, None, None, None, 3.5, -2000.0, None, None, 0.5]


def test_tolerant_and_format(spark):
    df = spark.createDataFrame([("Yes",), ("0",), ("maybe",), (None,)], "s string")
    assert [r[0] for r in df.select(fs.tolerant_bool("s")).collect()] == [True, False, False, False]
    nums = spark.createDataFrame([(1.23456,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in nums.select(fs.format_number3("x")).collect()] == ["1.235", "", "", ""]


def test_guarded_ratio_and_flags(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0), (10.0, 4.0, 2), (None, 5.0, None)], "d double, g double, n int")
    out = df.select(fs.guarded_ratio("d", "g").alias("r"), fs.presence_flag("n").alias("f"),
                    fs.log1p_zero("d").alias("l")).collect()
    assert [r["r"] for r in out] == [0.0, 2.5, 0.0]
    assert [r["f"] for r in out] == [0, 1, 0]
    assert out[2]["l"] == 0.0


def test_tag_flags(spark):
    df = spark.createDataFrame([("run_nowcast_ex_post_restricted_macro_oil",), ("run_forecast_strict_main",)], "tag string")
    f = fs.tag_flags("tag")
    rows = df.select(*[v.alias(k) for k, v in f.items()]).collect()
    assert rows[0].asDict() == {"mode": "nowcast", "include_covid": True, "include_macro": True,
                                "include_oil": True, "restricted": True}
    assert rows[1].asDict() == {"mode": "forecast", "include_covid": False, "include_macro": False,
                                "include_oil": False, "restricted": False}

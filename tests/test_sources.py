import os
import tempfile
import time

from pyspark.sql import functions as F

from panelcast.sources import extracts as ex
from panelcast.sources import results as rs


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_wide_indicator_with_preamble(spark):
    d = tempfile.mkdtemp(prefix="pc-src-")
    p = os.path.join(d, "gdp.csv")
    write(p, "Data Source,Indicators\n\nLast Updated,2024\n"
             "Country Name,Country Code,Indicator Name,Indicator Code,1990,1991,1992\n"
             "Country A,AAA,GDP,NY.GDP,100,,x\nOther,OTH,GDP,NY.GDP,5,6,7\n")
    out = ex.load_wide_indicator(spark, p, "gdp", ["AAA"]).orderBy("t").collect()
    assert [(r["entity"], r["t"], r["gdp"]) for r in out] == [("AAA", 1990, 100.0)]


def test_coded_extract_both_header_styles(spark):
    d = tempfile.mkdtemp(prefix="pc-src-")
    body = ("Series Code,Country Code,1990 [YR1990],1991 [YR1991]\n"
            "FP.CPI,AAA,3.1,..\nFP.CPI,OTH,1,2\n,,,\n")
    write(os.path.join(d, "a.csv"), body)
    write(os.path.join(d, "b.csv"), "x\ny\nz\n" + body)
    for name in ("a.csv", "b.csv"):
        out = ex.load_coded_extract(spark, os.path.join(d, name), "inflation", ["AAA"]).collect()
        assert [(r["t"], r["inflation"]) for r in out] == [(1990, 3.1)]
    m = ex.load_macros(spark, {"inflation": os.path.join(d, "a.csv"), "fx": os.path.join(d, "b.csv")})
    assert m.count() == 3


def test_event_list_and_dated_series(spark):
    d = tempfile.mkdtemp(prefix="pc-src-")
    p = os.path.join(d, "ev.csv")
    write(p, "Disaster Type,Disaster Subtype,Event Name,Magnitude,Magnitude Scale,Total Deaths,"
             "\"Total Damage ('000 US$)\",Start Year,Extra\n"
             "Flood,Riverine,A,5.5,km2,10,200,1995,z\nStorm,Trop,B,,kph,,-3,1996,z\nQuake,G,C,7,R,1,5,,z\n")
    ev = ex.load_event_list(spark, p, "AAA").orderBy("t").collect()
    assert len(ev) == 2
    assert ev[0]["damage_usd"] == 200000.0 and ev[1]["damage_usd"] is None and ev[1]["damage_usd_thousands"] is None
    q = os.path.join(d, "oil.csv")
    write(q, "observation_date,POILAPSPUSDA\n1990-01-01,22.5\n1991-01-01,.\n")
    assert [(r["t"], r["oil_price_usd"]) for r in ex.load_dated_series(spark, q).collect()] == [(1990, 22.5)]


def test_result_tables_round_trip(spark):
    d = tempfile.mkdtemp(prefix="pc-res-")
    path = os.path.join(d, "model_metrics")
    a = spark.createDataFrame([("ridge", 1.0, "run_a")], "model string, test_RMSE double, tag string")
    b = spark.createDataFrame([("ridge", 2.0, "run_b")], "model string, test_RMSE double, tag string")
    rs.write_tagged(a, path)
    time.sleep(1.1)
    rs.write_tagged(b, path)
    assert rs.read_tagged(spark, path).count() == 2                     # b did not replace a
    assert rs.read_tagged(spark, path, "run_a").first()["test_RMSE"] == 1.0
    assert rs.latest_tag(spark, path) == "run_b"
    assert rs.read_tagged(spark, os.path.join(d, "missing"), missing="none") is None
    try:
        rs.read_tagged(spark, path, "nope", missing="error")
        raise AssertionError("expected error")
    except rs.MissingResultError:
        pass
    bp = os.path.join(d, "best_params")
    rs.write_tagged(spark.createDataFrame([("random_forest", 5.0, None, "run_a")],
                                          "model string, model__max_depth double, model__n_estimators double, tag string"), bp)
    params = rs.read_best_params(spark, bp, "run_a", "random_forest")
    assert params == {"maxDepth": 5.0}
    from pyspark.ml.regression import RandomForestRegressor
    est = rs.apply_params(RandomForestRegressor(), params)
    assert est.getMaxDepth() == 5


def test_scan_runs(spark):
    d = tempfile.mkdtemp(prefix="pc-scan-")
    write(os.path.join(d, "model_metrics_run_x.csv"), "model,test_RMSE\nridge,1.5\n")
    write(os.path.join(d, "model_metrics_run_y.csv"), "model,test_RMSE\nridge,2.5\n")
    out = {r["tag"]: r["test_RMSE"] for r in rs.scan_runs(spark, os.path.join(d, "model_metrics_*.csv")).collect()}
    assert out == {"run_x": 1.5, "run_y": 2.5}


def test_write_runs_scan_and_latest(spark):
    d = tempfile.mkdtemp(prefix="pc-runs-")
    m = spark.createDataFrame([("ridge", 1.5, "run_a"), ("ols", 2.5, "run_a"), ("ridge", 0.5, "run_b")],
                              "model string, test_RMSE double, tag string")
    runs = rs.write_runs(m.filter("tag = 'run_b'"), d)
    time.sleep(1.1)
    assert rs.write_runs(m.filter("tag = 'run_a'"), d, mode="append") == runs
    got = sorted(tuple(r) for r in rs.scan_runs(spark, runs, schema="model string, test_RMSE double")
                                      .select("tag", "model", "test_RMSE").collect())
    assert got == [("run_a", "ols", 2.5), ("run_a", "ridge", 1.5), ("run_b", "ridge", 0.5)]
    assert rs.latest_run(spark, runs).first()["tag"] == "run_a"


def test_run_files_are_read_by_name(spark):
    d = tempfile.mkdtemp(prefix="pc-wide-")
    write(os.path.join(d, "model_metrics_run_x.csv"),
          "model,train_MAE,train_RMSE,test_MAE,test_RMSE,n_test\nridge,0.1,0.2,0.3,0.4,12\n")
    write(os.path.join(d, "model_metrics_run_y.csv"), "n_test,model,note\n7,\"ols, plain\",x\nbad,mean,y\n")
    out = rs.scan_runs(spark, os.path.join(d, "model_metrics_*.csv"), schema="model string, test_RMSE double, n_test bigint")
    got = sorted((r["tag"], r["model"], r["test_RMSE"], r["n_test"]) for r in out.collect())
    assert got == [("run_x", "ridge", 0.4, 12), ("run_y", "mean", None, None), ("run_y", "ols, plain", None, 7)]


def test_every_file_loses_its_own_preamble(spark):
    d = tempfile.mkdtemp(prefix="pc-two-")
    write(os.path.join(d, "a.csv"), "Source,x\n\nUpdated\nCountry Name,Country Code,Indicator Name,Indicator Code,1960,1961\nA,AAA,G,N,1,2\n")
    write(os.path.join(d, "b.csv"), "Other,y\nz\n\nCountry Code,Country Name,Indicator Name,Indicator Code,1960,1961\nBBB,B,G,N,3,..\n")
    out = ex.load_wide_indicator(spark, d, "gdp").collect()
    assert sorted((r["entity"], r["t"], r["gdp"]) for r in out) == [("AAA", 1960, 1.0), ("AAA", 1961, 2.0), ("BBB", 1960, 3.0)]
    write(os.path.join(d, "c.csv"), "one\ntwo\n")
    try:
        ex.load_wide_indicator(spark, d, "gdp")
        raise AssertionError("expected error")
    except ValueError:
        pass

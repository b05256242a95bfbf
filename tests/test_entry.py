import __spark_entry__ as E


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 30


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert {"model", "test_RMSE", "test_R2", "tag"} <= set(df.columns)

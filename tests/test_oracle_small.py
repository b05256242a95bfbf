"""A few registered queries against their DuckDB oracle on the smallest tables."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["c1_master_panel", "c2_feature_table", "w8_fold_rows", "c4_baseline_metrics_main",
         "a10_damage_histogram", "p4_dirty_text_cast"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted(repr(tuple(norm(r[i]) for i in idx)) for r in res.fetchall())
    assert got == want

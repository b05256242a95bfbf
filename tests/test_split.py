import pytest
from pyspark.sql import functions as F

from panelcast.operators import split as sp
from conftest import series_frame


def sides(df):
    rows = df.groupBy("side").count().collect()
    return {r["side"]: r["count"] for r in rows}


def test_split_62_periods(spark):
    s = sp.chrono_split(series_frame(spark, 62))
    assert sides(s) == {"train": 49, "test": 13}
    fb = sp.fold_bounds(s.filter("side='train'")).orderBy("fold").collect()
    assert len(fb) == 5
    # block 8, first fold trains on 49 - 5*8 = 9 periods
    assert fb[0]["train_end_t"] == 100 + 9 - 1
    assert [r["val_end_t"] - r["train_end_t"] for r in fb] == [8] * 5
    assert fb[-1]["val_end_t"] == 100 + 49 - 1


def test_split_32_periods(spark):
    s = sp.chrono_split(series_frame(spark, 32))
    assert sides(s) == {"train": 25, "test": 7}
    fb = sp.fold_bounds(s.filter("side='train'")).orderBy("fold").collect()
    assert len(fb) == 4 and fb[0]["train_end_t"] == 100 + 5 - 1


def test_split_guards(spark):
    with pytest.raises(ValueError):
        sp.chrono_split(series_frame(spark, 10), test_ratio=0.0)
    with pytest.raises(ValueError):
        sp.chrono_split(series_frame(spark, 10), test_ratio=1.0)
    with pytest.raises(Exception):
        sp.chrono_split(series_frame(spark, 4)).collect()
    # n = 5 is the smallest legal size
    assert sides(sp.chrono_split(series_frame(spark, 5))) == {"train": 4, "test": 1}
    # ratio 0.9 on 10 periods: floor(10 * 0.1) = 0 in doubles -> clamped to 1
    assert sides(sp.chrono_split(series_frame(spark, 10), test_ratio=0.9)) == {"train": 1, "test": 9}


def test_panel_split_is_calendar_wide(spark):
    a = series_frame(spark, 20, entity=1, start=100)
    b = series_frame(spark, 10, entity=2, start=110)
    s = sp.chrono_split(a.unionByName(b))
    chk = sp.chronology_check(s).first()
    assert chk["chronological"]
    # every entity is cut at the same period
    cut = s.filter("side='train'").agg(F.max("t")).first()[0]
    assert s.filter((F.col("side") == "test") & (F.col("t") <= cut)).count() == 0


def test_fold_rows_expanding(spark):
    s = sp.chrono_split(series_frame(spark, 62))
    rows = sp.assign_folds(s.filter("side='train'"))
    c = {(r["fold"], r["role"]): r["count"] for r in rows.groupBy("fold", "role").count().collect()}
    assert c[(0, "train")] == 9 and c[(4, "train")] == 41
    assert all(c[(f, "val")] == 8 for f in range(5))


def test_split_with_folds_one_aggregate(spark):
    for n in (62, 32, 11):
        ds = series_frame(spark, n)
        s1, bounds = sp.chrono_split_with_folds(ds)
        s2 = sp.chrono_split(ds)
        assert sides(s1) == sides(s2)
        fb = sp.fold_bounds(s2.filter("side='train'")).orderBy("fold").collect()
        assert bounds == [(r["fold"], r["train_end_t"], r["val_end_t"]) for r in fb]

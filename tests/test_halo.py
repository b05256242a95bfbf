"""Windows over cut series against the plain window, row by row."""

import numpy as np
import pytest

from panelcast.operators import halo
from panelcast.operators.features import add_features

SCHEMA = "entity string, t int, gdp_growth double, n_events int, oil_price_usd double"


def panel(spark, sizes, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for entity, n in sizes.items():
        for t in np.sort(rng.choice(10 * n + 10, n, replace=False)):
            y = None if rng.random() < 0.1 else round(float(rng.normal()), 4)
            rows.append((entity, int(t), y, int(rng.integers(5)), round(float(rng.random()), 4)))
    return spark.createDataFrame(rows, SCHEMA).repartition(7)



def keyed(df):
    return {(r.entity, r.t): [None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()}


@pytest.mark.parametrize("rows_per_window", [None, 3, 40, 700])
def test_one_entity_with_most_rows(spark, rows_per_window):
    df = panel(spark, {"hot": 4500, "b": 60, "c": 2, None: 130})
    got = halo.add_features_long(df, rows_per_window=rows_per_window)
    want = add_features(df)
    assert got.columns == want.columns and got.count() == df.count()
    assert keyed(got) == keyed(want)


def test_pieces_are_even_and_halos_short(spark):
    df = panel(spark, {"hot": 5000, "b": 300})
    n = {(r.entity, r[halo.PIECE], r[halo.HALO]): r["count"]
         for r in halo.with_halo(df, 5, rows_per_window=250).groupBy("entity", halo.PIECE, halo.HALO).count().collect()}
    own = {k: v for k, v in n.items() if not k[2]}
    assert sum(own.values()) == 5300 and max(own.values()) <= 300 and sum(k[0] == "hot" for k in own) == 20
    assert all(n[(e, p, True)] == 5 for e, p, _ in own if p > 0) and not any(h and p == 0 for _, p, h in n)


def test_empty_and_null_times(spark):
    assert halo.add_features_long(panel(spark, {"a": 5}).limit(0)).count() == 0
    df = panel(spark, {"a": 400}).unionByName(spark.createDataFrame([("a", None, 1.0, 1, 2.0)], SCHEMA))
    assert keyed(halo.add_features_long(df, rows_per_window=50)) == keyed(add_features(df))

"""The registered tree queries run the reference's sizes; searches, folds and both ways to grow trees
agree with fits of their own."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import growth as gr
from panelcast.operators import importance as im
from panelcast.operators import trees as tr
from panelcast.plans import queries as q


def test_registered_tree_queries_are_the_whole_job(spark, monkeypatch):
    seen = []

    def run(spark, d, cfg, feats=None, **kw):
        seen.append(kw)
        frame = spark.range(1).select(F.lit("m").alias("model"), F.lit("s").alias("subset"))
        best = {"random_forest": {"maxDepth": 5}, "gradient_boosting": {"maxDepth": 2}}
        return SimpleNamespace(metrics=frame, cv=frame, best_params=best), None

    monkeypatch.setattr(q, "_run", run)
    for name in ("m6_m7_all_model_metrics", "m10_cv_report", "m8_rf_grid_search", "m9_gb_grid_search"):
        q.REGISTRY[name][0](spark, "")
    assert all("rf_params" not in kw and "gb_params" not in kw for kw in seen)
    assert seen[2]["rf_grid"] == tr.RF_GRID and seen[3]["gb_grid"] == tr.GB_GRID


def fold_table(spark, n=90):
    rng = np.random.default_rng(0)
    rows = [(1, k, float(a) if k % 11 else None, float(b), float(a * b + a)) for k, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "entity int, t int, a double, b double, y double").coalesce(3).cache()


BOUNDS = [(0, 29, 44), (1, 44, 59), (2, 59, 89)]
FILL = {f: {"a": 0.1 * f, "b": 0.0} for f in (-1, 0, 1, 2)}


@pytest.mark.parametrize("kind, grid", [
    ("gradient_boosting", {"maxIter": [2, 4], "stepSize": [0.1, 0.3], "maxDepth": [2], "l2": [0.0, 3.0], "minInstancesPerNode": [1]}),
    ("random_forest", {"numTrees": [3, 7], "maxDepth": [None, 2], "minSplit": [2, 9], "minInstancesPerNode": [1, 2]})])
def test_search_scores_equal_fits_of_their_own(spark, kind, grid):
    """Prefixes and truncations give what a fit of each candidate gives."""
    df = fold_table(spark)
    best, table = tr.grid_search(df, ["a", "b"], BOUNDS, FILL, kind, grid)
    cands = tr.expand_grid(grid)
    got = {(r.candidate, r.fold): r.val_RMSE for r in table.collect()}
    assert len(got) == len(cands) * len(BOUNDS)
    bins = tr.bin_table(df, ["a", "b"], tr.period_ends(BOUNDS))
    units = [u for c in cands for u in tr.fold_units(kind, c, BOUNDS, FILL, tr.period_ends(BOUNDS))]
    pdf = df.toPandas()
    for k, fit in enumerate(tr.fit_units(spark, bins, units)):
        ci, (fold, te, ve) = k // len(BOUNDS), BOUNDS[k % len(BOUNDS)]
        val = pdf[(pdf["t"] > te) & (pdf["t"] <= ve)]
        want = np.sqrt(np.mean((val["y"].to_numpy() - fit.predict(val[["a", "b"]].to_numpy())) ** 2))
        assert got[(ci, fold)] == pytest.approx(want, rel=1e-9)
    means = {c: np.mean([got[(c, f)] for f, _, _ in BOUNDS]) for c in range(len(cands))}
    assert best == cands[min(means, key=lambda c: (means[c], c))]


@pytest.mark.parametrize("kind, params", [
    ("gradient_boosting", dict(maxIter=23, stepSize=0.3, maxDepth=3, l2=0.5, minInstancesPerNode=2)),
    ("gradient_boosting", dict(maxIter=3, stepSize=0.3, maxDepth=None, maxLeaves=6, minInstancesPerNode=2)),
    ("random_forest", dict(numTrees=3, maxDepth=4, minInstancesPerNode=2))])
def test_rows_that_stay_where_they_lie_give_the_same_trees(spark, monkeypatch, kind, params):
    df = fold_table(spark)
    ends = tr.period_ends(BOUNDS)
    units = tr.fold_units(kind, params, BOUNDS[1:], FILL, ends) + [tr.Unit(kind, params, FILL[-1])]
    table = tr.bin_table(df, ["a", "b"], ends)
    near = tr.fit_units(spark, table, units)
    monkeypatch.setattr(tr, "LOCAL_BYTES", 0)
    monkeypatch.setattr(tr, "ROUNDS_HELD", 7)
    assert not table.local
    far = tr.fit_units(spark, table, units)
    x = df.select("a", "b").toPandas().to_numpy()
    for a, b in zip(near, far, strict=True):
        assert len(a.trees) == len(b.trees)
        np.testing.assert_allclose(a.predict(x), b.predict(x), rtol=1e-9, atol=1e-12)
        if kind == "gradient_boosting":
            assert all((s.feature == t.feature).all() and (s.cut == t.cut).all() for s, t in zip(a.trees, b.trees, strict=True))


def test_search_over_rows_that_stay(spark, monkeypatch):
    df = fold_table(spark)
    grid = {"maxIter": [1, 3], "stepSize": [0.3], "maxDepth": [2], "minInstancesPerNode": [2]}
    forest = {"numTrees": [2, 3], "maxDepth": [None, 2], "minInstancesPerNode": [3]}
    near = [tr.grid_search(df, ["a", "b"], BOUNDS, FILL, k, g) for k, g in (("gradient_boosting", grid), ("random_forest", forest))]
    monkeypatch.setattr(tr, "LOCAL_BYTES", 0)
    far = [tr.grid_search(df, ["a", "b"], BOUNDS, FILL, k, g) for k, g in (("gradient_boosting", grid), ("random_forest", forest))]
    for (a, ta), (b, tb) in zip(near, far, strict=True):
        assert a == b
        assert [r.val_RMSE for r in ta.orderBy("candidate", "fold").collect()] == pytest.approx(
            [r.val_RMSE for r in tb.orderBy("candidate", "fold").collect()], rel=1e-9)


def slow_boost(x, y, rounds, step, depth, leaf, l2):
    """Boosting by trying every value of every feature, in plain Python."""
    def tree(rows, target, d):
        s, n = target[rows].sum(), len(rows)
        best = None
        if d:
            for j in range(x.shape[1]):
                for c in np.unique(x[rows, j])[:-1]:
                    left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if min(len(left), len(right)) >= leaf:
                        g = target[left].sum() ** 2 / (len(left) + l2) + target[right].sum() ** 2 / (len(right) + l2) - s * s / (n + l2)
                        if g > 1e-9 and (best is None or g > best[0] + 1e-9):
                            best = (g, left, right)
        if best is None:
            out[rows] = s / (n + l2)
        else:
            tree(best[1], target, d - 1)
            tree(best[2], target, d - 1)

    p = np.full(len(y), y.mean())
    for _ in range(rounds):
        out = np.zeros(len(y))
        tree(np.arange(len(y)), y - p, depth)
        p = p + step * out
    return p


def test_boosting_matches_a_plain_booster(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, size=(80, 3)).astype(float)
    y = x[:, 0] * (x[:, 1] > 4) + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    fit = tr.fit_tree(df, ["a", "b", "c"], {}, "gradient_boosting", dict(maxIter=12, stepSize=0.2, maxDepth=3, l2=0.7, minInstancesPerNode=4))
    np.testing.assert_allclose(fit.predict(x), slow_boost(x, y, 12, 0.2, 3, 4, 0.7), rtol=1e-9)


def test_leaf_wise_growth_takes_the_best_leaf_first():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 40, size=(400, 3)).astype(np.uint8)
    y = rng.normal(size=400) + 3 * (bins[:, 0] > 20) * (bins[:, 1] > 10)
    whole = gr.grow(bins, np.ones(400), y, gr.Rule(min_leaf=5))
    by_gain = gr.grow(bins, np.ones(400), y, gr.Rule(min_leaf=5, max_leaves=6))
    assert (by_gain.feature < 0).sum() == 6 and len(whole.feature) > len(by_gain.feature)

    def loss(tree):
        return ((y - tree.predict(bins)) ** 2).sum()

    # a tree of six leaves found by hand: always the leaf whose split gains most
    leaves, one = [np.arange(400)], gr.Rule(max_depth=1, min_leaf=5)
    while len(leaves) < 6:
        parts = [(rows, gr.grow(bins[rows], np.ones(len(rows)), y[rows], one)) for rows in leaves]
        gains = [((y[r] - y[r].mean()) ** 2).sum() - ((y[r] - t.predict(bins[r])) ** 2).sum() for r, t in parts]
        k = int(np.argmax(gains))
        rows, tree = parts[k]
        side = tree.leaves(bins[rows])
        leaves[k:k + 1] = [rows[side == i] for i in (1, 2)]
    assert loss(by_gain) == pytest.approx(sum(((y[r] - y[r].mean()) ** 2).sum() for r in leaves))


def test_errors_of_a_model_keep_its_row(spark):
    df = fold_table(spark)
    bins = tr.bin_table(df, ["a", "b"], tr.period_ends(BOUNDS))
    bad = tr.fold_units("gradient_boosting", dict(maxIter=2, stepSize=0.1, l2=-1.0), BOUNDS, FILL, tr.period_ends(BOUNDS))
    good = tr.fold_units("random_forest", dict(numTrees=2), BOUNDS, FILL, tr.period_ends(BOUNDS))
    out = tr.fit_units(spark, bins, bad + good)
    assert [isinstance(f, tr.Failed) for f in out] == [True] * 3 + [False] * 3 and str(out[0]) == "ValueError"
    with pytest.raises(ValueError):
        tr.grid_search(df, ["a", "b"], BOUNDS, FILL, "gradient_boosting", {"maxIter": [2], "stepSize": [0.1], "l2": [-1.0]})
    with pytest.raises(ValueError):
        tr.fit_tree(df.limit(0), ["a", "b"], {}, "random_forest", dict(numTrees=2))


@pytest.mark.parametrize("kind, params", [("gradient_boosting", dict(maxIter=5, stepSize=0.3, maxDepth=2, minInstancesPerNode=3)),
                                          ("random_forest", dict(numTrees=4, maxDepth=3))])
def test_importance_of_trees_scored_in_part(spark, kind, params):
    """The trees that test a feature, followed again, give what scoring all of them gives."""
    df = fold_table(spark)
    fit = tr.fit_tree(df, ["a", "b"], FILL[-1], kind, params)
    part = {r.feature: r for r in im.tree_importance(df, fit, n_repeats=3).collect()}
    whole = {r.feature: r for r in im.permutation_importance(df, ["a", "b"], fit.transform, n_repeats=3).collect()}
    assert set(part) == set(whole) == {"a", "b"}
    for name, r in whole.items():
        assert part[name].importance == pytest.approx(r.importance, rel=1e-9) and part[name].std == pytest.approx(r.std, rel=1e-6)

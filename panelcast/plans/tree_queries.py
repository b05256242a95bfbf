"""Registered queries of trees, searches and run outputs whose results SQL can state: trees of one
split (stumps) on one feature, in one and two rounds, over folds and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import trees as tr
from panelcast.operators.importance import tree_importance
from panelcast.plans import oracle as O
from panelcast.plans import runs
from panelcast.plans.queries import (
    _FOLD_SQL,
    _MAIN_PRED_SQL,
    _X,
    MAIN,
    _metrics_query,
    _part_scores,
    _results_root,
    _run,
    _run_sql_prefix,
    register,
)
from panelcast.plans.standard import rounded
from panelcast.sources import results as rs

_LEAF, _STEPS, _L2S, _ROUNDS = 20, (0.1, 0.3), (0.0, 25.0), (1, 2)
STUMP_GRID = {"maxIter": list(_ROUNDS), "stepSize": list(_STEPS), "maxDepth": [1], "l2": list(_L2S), "minInstancesPerNode": [_LEAF]}
STUMP = dict(maxIter=1, stepSize=_STEPS[0], maxDepth=1, l2=_L2S[1], minInstancesPerNode=_LEAF)
GB = "gradient_boosting"


def _values(name: str, values: tuple) -> str:
    return f"{name}s AS (SELECT * FROM (VALUES {', '.join(f'({v}::DOUBLE)' for v in values)}) v({name}))"


def _round_sql(k: int, rows: str, groups: str, score: str) -> str:
    """CTEs b<k> (the best split of each group) and p<k> (scores after it) from ``rows`` with ``score``."""
    gain = "sl * sl / (nl + l2) + (s - sl) * (s - sl) / (n - nl + l2) - s * s / (n + l2)"
    return f"""
c{k} AS (SELECT {groups}, c, count_if(x <= c) AS nl, sum(CASE WHEN x <= c THEN y - {score} ELSE 0.0{O.D} END) AS sl, count(*) AS n, sum(y - {score}) AS s
  FROM {rows}, cuts WHERE role = 'train' GROUP BY {groups}, c HAVING count_if(x <= c) >= {_LEAF} AND count(*) - count_if(x <= c) >= {_LEAF}),
b{k} AS (SELECT {groups}, c, sl / (nl + l2) AS vl, (s - sl) / (n - nl + l2) AS vr
  FROM (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY round({gain}, 9) DESC, c) AS place FROM c{k}) WHERE place = 1)"""


# cuts: the values at ranks ceil(n k / 255) of all training rows, but the greatest
_STUMP_SQL = _run_sql_prefix(MAIN) + _FOLD_SQL + f""",
rk AS (SELECT {_X} AS x, row_number() OVER (ORDER BY {_X}) AS place, count(*) OVER () AS n FROM sp WHERE side = 'train'),
cuts AS (SELECT DISTINCT x AS c FROM rk, range(1, 255) q(k)
  WHERE place = greatest(1, CAST(ceil((k::DOUBLE / 255.0::DOUBLE) * n) AS BIGINT)) AND x < (SELECT max(x) FROM rk)),
{_values('step', _STEPS)}, {_values('l2', _L2S)},
sets AS (
  SELECT f.fold, CASE WHEN s.t <= f.train_end_t THEN 'train' ELSE 'val' END AS role, s.entity, s.t, s.y, s.{_X} AS x
  FROM sp s JOIN folds f ON s.t <= f.val_end_t WHERE s.side = 'train'
  UNION ALL SELECT -1, side, entity, t, y, {_X} FROM sp),
r0 AS MATERIALIZED (SELECT sets.*, m, l2 FROM sets JOIN (SELECT fold, avg(y) AS m FROM sets WHERE role = 'train' GROUP BY fold) USING (fold), l2s),
{_round_sql(1, 'r0', 'fold, l2', 'm')},
r1 AS MATERIALIZED (SELECT r0.*, step, m + step * (CASE WHEN x <= c THEN vl ELSE vr END) AS p1 FROM r0 JOIN b1 USING (fold, l2), steps),
{_round_sql(2, 'r1', 'fold, l2, step', 'p1')},
r2 AS MATERIALIZED (SELECT r1.*, p1 + step * (CASE WHEN x <= c THEN vl ELSE vr END) AS p2 FROM r1 JOIN b2 USING (fold, l2, step)),
long AS (SELECT fold, role, entity, t, y, x, l2, step, 1 AS rounds, p1 AS p FROM r2
         UNION ALL SELECT fold, role, entity, t, y, x, l2, step, 2, p2 FROM r2),
scored AS (
  SELECT CAST((rounds - 1) * 4 + (CASE WHEN step > 0.2 THEN 2 ELSE 0 END) + (CASE WHEN l2 > 1 THEN 1 ELSE 0 END) AS INTEGER) AS candidate,
         fold, l2, step, rounds, sqrt(avg((y - p) * (y - p))) AS rmse
  FROM long WHERE role = 'val' GROUP BY fold, l2, step, rounds),
best AS (SELECT candidate, any_value(l2) AS l2, any_value(step) AS step, any_value(rounds) AS rounds FROM scored
         GROUP BY candidate ORDER BY avg(rmse), candidate LIMIT 1)"""
_ONE = "rounds = 1 AND step < 0.2 AND l2 > 1"


def _stump_search(spark, d):
    split, _, bounds = runs.prepare_run(spark, d, MAIN)
    train = split.filter(F.col("side") == "train")
    fill = {f: {} for f, _, _ in bounds}        # the feature has no nulls: rows without it are no rows of the dataset
    return split, bounds, tr.grid_search(train, [_X], bounds, fill, GB, STUMP_GRID)


@register("m7_boosting_stump", _STUMP_SQL + f"""
SELECT CASE WHEN role = 'test' THEN 'test' ELSE 'train' END AS side, entity, t, {O.r('p')} AS p FROM long WHERE fold = -1 AND {_ONE}""")
def q_stump(spark, d):
    """M7: one round of one split, with an L2 penalty."""
    res, _ = _run(spark, d, MAIN, [_X], models=(GB,), gb_params=STUMP, cv=False)
    return rounded(res.predictions.filter(F.col("model") == GB).select("side", "entity", "t", "p"))


@register("m9_grid_stumps", _STUMP_SQL + f"""
SELECT s.candidate, s.fold, {O.r('s.rmse')} AS val_RMSE, s.candidate = b.candidate AS best FROM scored s, best b""")
def q_stump_grid(spark, d):
    """Every candidate (rounds, step, L2) on every fold, and the best."""
    _, _, (best, table) = _stump_search(spark, d)
    number = tr.expand_grid(STUMP_GRID).index(best)
    return rounded(table.select("candidate", "fold", "val_RMSE", (F.col("candidate") == number).alias("best")))


@register("m10_cv_stumps", _STUMP_SQL + f"""
SELECT CAST(fold AS INTEGER) AS fold, '{GB}' AS model, {_part_scores('train')}, {_part_scores('val')}, 'ok' AS status, '{MAIN.tag}' AS tag
FROM (SELECT *, y - p AS e FROM long WHERE fold >= 0 AND {_ONE}) GROUP BY fold""")
def q_stump_cv(spark, d):
    """A boosted stump for each expanding fold."""
    return rounded(_run(spark, d, MAIN, [_X], models=(GB,), gb_params=STUMP)[0].cv)


_REPEATS = 5


@register("m11_importance_stump", _STUMP_SQL + f""",
te AS (SELECT entity, t, y, p, x FROM long WHERE fold = -1 AND role = 'test' AND {_ONE}),
own AS (SELECT r, y, row_number() OVER (PARTITION BY r ORDER BY entity, t) AS k FROM te, range(0, {_REPEATS}) q(r)),
other AS (SELECT r, p, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || entity || ':' || t), entity, t) AS k
          FROM te, range(0, {_REPEATS}) q(r)),
shuffled AS (SELECT r, sqrt(avg((y - p) * (y - p))) AS rmse FROM own JOIN other USING (r, k) GROUP BY r),
plain AS (SELECT sqrt(avg((y - p) * (y - p))) AS rmse FROM te)
SELECT '{_X}' AS feature, {O.r('avg(s.rmse - p.rmse)')} AS importance, {O.r('stddev_pop(s.rmse - p.rmse)')} AS std FROM shuffled s, plain p""")
def q_stump_importance(spark, d):
    """M11 for a tree ensemble: with one feature, the prediction goes where the value goes."""
    res, split = _run(spark, d, MAIN, [_X], models=(GB,), gb_params=STUMP, cv=False)
    return rounded(runs.importance_for(res, split, GB, n_repeats=_REPEATS))


@register("m11_tree_importance", None)
def q_tree_importance(spark, d):
    """M11 for boosting at the library's defaults: all features, 30 repeats."""
    res, split = _run(spark, d, MAIN, models=(GB,), cv=False)
    return rounded(tree_importance(split.filter(F.col("side") == "test"), res.fits[(GB, tr.ALL)], n_repeats=30))


@register("s11_tuned_run_predictions", _STUMP_SQL + f"""
SELECT CASE WHEN role = 'test' THEN 'test' ELSE 'train' END AS side, entity, t, {O.r('p')} AS p
FROM long JOIN best USING (l2, step, rounds) WHERE fold = -1""")
def q_tuned(spark, d):
    """The best parameters of a search, written under the run's tag, read back and used."""
    split, bounds, (best, _) = _stump_search(spark, d)
    path = _results_root(spark, "s11") + f"/best_params_{GB}"
    rs.write_tagged(tr.best_params_frame(spark, best).withColumn("tag", F.lit(MAIN.tag)), path)
    params = tr.with_params(STUMP, rs.read_best_params(spark, path, MAIN.tag, GB))
    res = runs.run_all_models(spark, split, [_X], MAIN, models=(GB,), gb_params=params, cv=False, checkpoint=False, bounds=bounds)
    return rounded(res.predictions.filter(F.col("model") == GB).select("side", "entity", "t", "p"))


def _written_run(spark, d):
    res, split = _run(spark, d, MAIN, models=())
    return runs.write_run(spark, res, _results_root(spark, "c4"))


@register("c4_run_written_metrics", _metrics_query(MAIN)[1])
def q_written_metrics(spark, d):
    """A run writes its tables under its tag; its metrics, read back."""
    return rounded(rs.read_tagged(spark, _written_run(spark, d)["model_metrics"], MAIN.tag, missing="error"))


@register("c4_run_written_predictions", "WITH mx AS (" + _metrics_query(MAIN)[1] + "), pr AS (" + _MAIN_PRED_SQL + """
SELECT model, entity, t, y, p FROM preds WHERE side = 'test')
SELECT model, entity, t, """ + ", ".join(f"{O.r(e)} AS {n}" for e, n in (("y", "actual"), ("p", "pred"), ("y - p", "error"), ("abs(y - p)", "abs_error"))) + """
FROM pr WHERE model = (SELECT model FROM mx ORDER BY test_RMSE NULLS LAST, model LIMIT 1)""")
def q_written_predictions(spark, d):
    """The best model's predictions that a run wrote, read back."""
    return rounded(rs.read_tagged(spark, _written_run(spark, d)["predictions"], MAIN.tag, missing="error").drop("tag"))

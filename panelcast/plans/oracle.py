"""DuckDB SQL for the registered queries (the correctness oracle).

Each function returns one SQL string over the pre-registered views (orders,
customer, lineitem, ...).  The SQL is written independently of the Spark plan: the
same semantics, expressed as plain CTEs.  Double outputs are rounded to 6 places and
``+ 0.0`` turns a negative zero into zero, exactly as ``standard.rounded`` does.
"""

from __future__ import annotations

from panelcast.operators import features as fe
from panelcast.sources import tpch_panel as tp

D = "::DOUBLE"

MASTER_COLUMNS = ["entity", "t", "gdp", "gdp_growth", "n_events", "total_deaths", "total_damage",
                  "avg_magnitude", *tp.MACRO_COLUMNS, tp.GLOBAL_COLUMN, "log_total_damage",
                  "damage_share_gdp", "has_disaster"]
NEW_FEATURE_COLUMNS = ["t2", "covid_dummy", "gdp_growth_lag1", "gdp_growth_lag2",
                       "gdp_growth_roll3_mean", "gdp_growth_roll5_mean", "gdp_growth_roll5_std",
                       "oil_price_usd_change"] + [f"{c}_lag1" for c in fe.TO_LAG]
FEATURE_COLUMNS = MASTER_COLUMNS + NEW_FEATURE_COLUMNS
MASTER_DOUBLES = {"gdp", "gdp_growth", "total_deaths", "total_damage", "avg_magnitude",
                  *tp.MACRO_COLUMNS, tp.GLOBAL_COLUMN, "log_total_damage", "damage_share_gdp"}


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}){D}, {digits}) + 0.0{D})"


def month(col: str) -> str:
    return f"CAST(year({col}) * 12 + month({col}) - 1 AS INTEGER)"


def base_ctes() -> str:
    """Order facts, level, growth, events, event aggregates, macro block, global series,
    master panel."""
    macro_parts = []
    defs = [("mlines", tp.MACRO_COLUMNS[0], f"CAST(sd AS DOUBLE) / nl"),
            ("mlines", tp.MACRO_COLUMNS[1], f"CAST(sq AS DOUBLE) / nl"),
            ("morders", tp.MACRO_COLUMNS[2], f"CAST(n_urgent AS DOUBLE) / n_orders"),
            ("morders", tp.MACRO_COLUMNS[3], f"CAST(sum_bal AS DOUBLE) / n_orders"),
            ("morders", tp.MACRO_COLUMNS[4], f"CAST(n_orders AS DOUBLE)")]
    for src, name, expr in defs:
        macro_parts.append(f"SELECT entity, t, '{name}' AS series, {expr} AS value FROM {src}")
    macro_long = "\n    UNION ALL ".join(macro_parts)
    macro_cols = ",\n    ".join(f"MAX(CASE WHEN series = '{c}' THEN value END) AS {c}" for c in tp.MACRO_COLUMNS)
    return f"""
ofacts AS (
  SELECT o.o_orderkey, c.c_nationkey AS entity, {month('o.o_orderdate')} AS t,
         o.o_totalprice, o.o_orderpriority, c.c_acctbal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
lvl AS (
  SELECT entity, t, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp
  FROM ofacts GROUP BY entity, t),
gr AS (
  SELECT entity, t, gdp_growth FROM (
    SELECT entity, t, 100.0{D} * (gdp / lag(gdp, 1) OVER (PARTITION BY entity ORDER BY t) - 1.0{D}) AS gdp_growth
    FROM lvl) WHERE gdp_growth IS NOT NULL),
ev_raw AS (
  SELECT c.c_nationkey AS entity, {month('l.l_shipdate')} AS t, l.l_quantity AS deaths,
         CASE WHEN l.l_tax = 0 THEN -(l.l_extendedprice / 1000.0{D}) ELSE l.l_extendedprice / 1000.0{D} END
           AS damage_usd_thousands,
         CASE WHEN l.l_discount <> 0 THEN l.l_discount END AS magnitude
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE l.l_returnflag = 'R'),
ev AS (
  SELECT entity, t, deaths, magnitude,
         CASE WHEN damage_usd_thousands >= 0 THEN damage_usd_thousands END AS damage_usd_thousands,
         CASE WHEN damage_usd_thousands * 1000.0{D} >= 0 THEN damage_usd_thousands * 1000.0{D} END AS damage_usd
  FROM ev_raw),
evagg AS (
  SELECT entity, t, COUNT(*) AS n_events,
    CAST(SUM(CAST(COALESCE(deaths, 0.0{D}) AS DECIMAL(38,6))) AS DOUBLE) AS total_deaths,
    CAST(SUM(CAST(COALESCE(damage_usd, 0.0{D}) AS DECIMAL(38,6))) AS DOUBLE) AS total_damage,
    COALESCE(CAST(SUM(CAST(COALESCE(magnitude, 0.0{D}) AS DECIMAL(38,6))) AS DOUBLE) / COUNT(*), 0.0{D}) AS avg_magnitude
  FROM ev GROUP BY entity, t),
mlines AS (
  SELECT c.c_nationkey AS entity, {month('l.l_shipdate')} AS t, SUM(CAST(l.l_discount AS DECIMAL(18,2))) AS sd,
         SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS sq, COUNT(*) AS nl
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2),
morders AS (
  SELECT entity, t, COUNT(*) AS n_orders, COUNT_IF(o_orderpriority = '1-URGENT') AS n_urgent,
         SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS sum_bal
  FROM ofacts GROUP BY entity, t),
macro_long AS (
    {macro_long}),
macro AS (
  SELECT entity, t,
    {macro_cols}
  FROM macro_long GROUP BY entity, t),
oil AS (
  SELECT {month('l_shipdate')} AS t,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS {tp.GLOBAL_COLUMN}
  FROM lineitem GROUP BY 1),
master AS (
  SELECT l.entity, l.t, l.gdp, g.gdp_growth,
    COALESCE(e.n_events, 0) AS n_events,
    COALESCE(e.total_deaths, 0.0{D}) AS total_deaths,
    COALESCE(e.total_damage, 0.0{D}) AS total_damage,
    COALESCE(e.avg_magnitude, 0.0{D}) AS avg_magnitude,
    {", ".join('m.' + c for c in tp.MACRO_COLUMNS)},
    o.{tp.GLOBAL_COLUMN},
    ln(1.0{D} + COALESCE(e.total_damage, 0.0{D})) AS log_total_damage,
    CASE WHEN COALESCE(l.gdp, 0.0{D}) > 0 THEN COALESCE(e.total_damage, 0.0{D}) / l.gdp ELSE 0.0{D} END
      AS damage_share_gdp,
    CAST(COALESCE(e.n_events, 0) > 0 AS INTEGER) AS has_disaster
  FROM lvl l JOIN gr g ON l.entity = g.entity AND l.t = g.t
  LEFT JOIN evagg e ON l.entity = e.entity AND l.t = e.t
  LEFT JOIN macro m ON l.entity = m.entity AND l.t = m.t
  LEFT JOIN oil o ON l.t = o.t)"""


def feat_cte(src: str = "master", cutoff: int = tp.REGIME_CUTOFF, lag_cols=None) -> str:
    cols = [c for c in (lag_cols or fe.TO_LAG) if c != "oil_price_usd_change"]
    lags = ",\n    ".join(f"lag({c}, 1) OVER w AS {c}_lag1" for c in cols)
    return f"""
feat AS (
  SELECT *,
    CAST(t AS BIGINT) * CAST(t AS BIGINT) AS t2,
    CAST(t >= {cutoff} AS INTEGER) AS covid_dummy,
    lag(gdp_growth, 1) OVER w AS gdp_growth_lag1,
    lag(gdp_growth, 2) OVER w AS gdp_growth_lag2,
    CASE WHEN count(gdp_growth) OVER w3 = 3 THEN avg(gdp_growth) OVER w3 END AS gdp_growth_roll3_mean,
    CASE WHEN count(gdp_growth) OVER w5 = 5 THEN avg(gdp_growth) OVER w5 END AS gdp_growth_roll5_mean,
    CASE WHEN count(gdp_growth) OVER w5 = 5 THEN stddev_samp(gdp_growth) OVER w5 END AS gdp_growth_roll5_std,
    oil_price_usd - lag(oil_price_usd, 1) OVER w AS oil_price_usd_change,
    {lags},
    lag(oil_price_usd, 1) OVER w - lag(oil_price_usd, 2) OVER w AS oil_price_usd_change_lag1
  FROM {src}
  WINDOW w AS (PARTITION BY entity ORDER BY t),
         w3 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         w5 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


def ds_cte(feats: list[str], start: int | None) -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats if c not in ("entity", "t"))
    where = "gdp_growth IS NOT NULL AND gdp_growth_lag1 IS NOT NULL"
    if start is not None:
        where += f" AND t >= {int(start)}"
    return f"""
ds AS (
  SELECT entity, t, CAST(gdp_growth AS DOUBLE) AS y, {cols}
  FROM feat WHERE {where})"""


def split_ctes(test_ratio: float = 0.2) -> str:
    keep = repr(1.0 - float(test_ratio))
    return f"""
per AS (
  SELECT t, row_number() OVER (ORDER BY t) AS pidx, count(*) OVER () AS n
  FROM (SELECT DISTINCT t FROM ds)),
cut AS (
  SELECT max(t) AS train_end_t FROM per
  WHERE pidx <= greatest(1, least(CAST(floor(n * {keep}{D}) AS BIGINT), n - 1))),
sp AS (
  SELECT ds.*, CASE WHEN t <= (SELECT train_end_t FROM cut) THEN 'train' ELSE 'test' END AS side,
         COALESCE(CAST(n_events_lag1 AS DOUBLE), 0.0{D}) AS n_ev,
         COALESCE(CAST(damage_share_gdp_lag1 AS DOUBLE), 0.0{D}) AS dmg
  FROM ds)"""


def preds_cte() -> str:
    return f"""
preds AS (
  SELECT 'baseline_mean_train' AS model, side, entity, t, y,
         (SELECT avg(y) FROM sp WHERE side = 'train') AS p, n_ev, dmg FROM sp
  UNION ALL
  SELECT 'baseline_last_year', side, entity, t, y, gdp_growth_lag1, n_ev, dmg FROM sp
  UNION ALL
  SELECT 'baseline_roll3_mean', side, entity, t, y, COALESCE(gdp_growth_roll3_mean, gdp_growth_lag1), n_ev, dmg
  FROM sp)"""


def thr_cte(q: float = 0.85, min_pos: int = 3, fallback: str = "zero") -> str:
    fb = {"zero": f"0.0{D}",
          "all": f"greatest(COALESCE((SELECT quantile_cont(dmg, {q!r}) FROM sp WHERE side = 'train' "
                 f"AND isfinite(dmg)), 0.0{D}), 0.0{D})",
          "none": "CAST(NULL AS DOUBLE)"}[fallback]
    return f"""
thr AS (
  SELECT CASE WHEN count(*) >= {min_pos} THEN greatest(quantile_cont(dmg, {q!r}), 0.0{D}) ELSE {fb} END
           AS threshold,
         count(*) AS n_pos
  FROM sp WHERE side = 'train' AND dmg > 0 AND isfinite(dmg))"""


def _r2(cond: str) -> str:
    n = f"count_if({cond})"
    sse = f"sum(CASE WHEN {cond} THEN e * e END)"
    sst = f"(var_pop(CASE WHEN {cond} THEN y END) * {n})"
    return (f"CASE WHEN {n} < 2 THEN NULL WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0{D} ELSE 0.0{D} END "
            f"ELSE 1.0{D} - {sse} / {sst} END")


SUBSETS = {"any_disaster": "m_any", "severe_disaster": "m_severe", "multi_event": "m_multi"}


def metrics_select(meta: dict | None, q: float = 0.85, r2_min_n: int = 5, subset_min_n: int = 1,
                   preds: str = "preds", raw: bool = False) -> str:
    """Final metrics SELECT over ``preds`` and ``thr`` (doubles rounded unless ``raw``)."""
    r = (lambda e: f"({e})") if raw else globals()["r"]
    tr, te = "side = 'train'", "side = 'test'"
    cols = [
        ("train_MAE", f"avg(CASE WHEN {tr} THEN abs(e) END)", True),
        ("train_RMSE", f"sqrt(avg(CASE WHEN {tr} THEN e * e END))", True),
        ("train_R2", _r2(tr), True),
        ("test_MAE", f"avg(CASE WHEN {te} THEN abs(e) END)", True),
        ("test_RMSE", f"sqrt(avg(CASE WHEN {te} THEN e * e END))", True),
        ("test_R2", _r2(te), True),
        ("n_nonfinite_pred_train", f"CAST(count_if({tr} AND NOT COALESCE(isfinite(p), false)) AS BIGINT)", False),
        ("n_nonfinite_pred_test", f"CAST(count_if({te} AND NOT COALESCE(isfinite(p), false)) AS BIGINT)", False),
    ]
    for name, m in SUBSETS.items():
        cond = f"{te} AND {m}"
        cnt = f"count_if({cond})"
        cols += [
            (f"test_count_{name}", f"CAST({cnt} AS BIGINT)", False),
            (f"test_RMSE_{name}", f"CASE WHEN {cnt} >= {subset_min_n} THEN sqrt(avg(CASE WHEN {cond} THEN e * e END)) END", True),
            (f"test_MAE_{name}", f"CASE WHEN {cnt} >= {subset_min_n} THEN avg(CASE WHEN {cond} THEN abs(e) END) END", True),
            (f"test_R2_{name}", f"CASE WHEN {cnt} >= {max(r2_min_n, subset_min_n)} THEN {_r2(cond)} END", True),
        ]
    cols += [
        ("test_count_positive_damage_share", f"CAST(count_if({te} AND dmg > 0) AS BIGINT)", False),
        ("n_train", f"CAST(count_if({tr}) AS BIGINT)", False),
        ("n_test", f"CAST(count_if({te}) AS BIGINT)", False),
    ]
    sel = ",\n  ".join(f"{r(e) if dbl else e} AS {n}" for n, e, dbl in cols)
    extra = [f"{r(repr(float(q)) + D)} AS severe_quantile_used",
             f"{r('(SELECT threshold FROM thr)')} AS severe_threshold_damage_share_train",
             "(SELECT n_pos FROM thr) AS train_count_positive_damage_share"]
    for k, v in (meta or {}).items():
        if isinstance(v, bool):
            extra.append(f"{'true' if v else 'false'} AS {k}")
        elif isinstance(v, int):
            extra.append(f"CAST({v} AS INTEGER) AS {k}")
        elif isinstance(v, float):
            extra.append(f"{r(repr(v) + D)} AS {k}")
        else:
            extra.append(f"'{v}' AS {k}")
    return f"""
mt AS (SELECT model, avg(y) AS mean_train FROM {preds} WHERE side = 'train' GROUP BY model),
pe AS (
  SELECT pr.*, y - CASE WHEN isfinite(p) THEN p ELSE mt.mean_train END AS e,
         n_ev > 0 AS m_any, n_ev > 0 AND dmg >= (SELECT threshold FROM thr) AS m_severe, n_ev >= 2 AS m_multi
  FROM {preds} pr LEFT JOIN mt USING (model)),
met AS (
  SELECT model,
  {sel}
  FROM pe GROUP BY model)
SELECT met.*, {", ".join(extra)} FROM met"""


def select_rounded(cols: list[str], doubles: set[str], src: str, where: str = "") -> str:
    items = ", ".join(f"{r(c)} AS {c}" if c in doubles else c for c in cols)
    return f"SELECT {items} FROM {src}{(' WHERE ' + where) if where else ''}"


def speed_base_ctes() -> str:
    """Supplier x month panel (no macro block)."""
    return f"""
lvl AS (
  SELECT l_suppkey AS entity, {month('l_shipdate')} AS t,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp
  FROM lineitem GROUP BY 1, 2),
gr AS (
  SELECT entity, t, gdp_growth FROM (
    SELECT entity, t, 100.0{D} * (gdp / lag(gdp, 1) OVER (PARTITION BY entity ORDER BY t) - 1.0{D}) AS gdp_growth
    FROM lvl) WHERE gdp_growth IS NOT NULL),
ev AS (
  SELECT l_suppkey AS entity, {month('l_shipdate')} AS t, l_quantity AS deaths,
         CASE WHEN l_tax <> 0 THEN l_extendedprice / 1000.0{D} * 1000.0{D} END AS damage_usd,
         CASE WHEN l_discount <> 0 THEN l_discount END AS magnitude
  FROM lineitem WHERE l_returnflag = 'R'),
evagg AS (
  SELECT entity, t, COUNT(*) AS n_events,
    CAST(SUM(CAST(COALESCE(deaths, 0.0{D}) AS DECIMAL(38,6))) AS DOUBLE) AS total_deaths,
    CAST(SUM(CAST(COALESCE(damage_usd, 0.0{D}) AS DECIMAL(38,6))) AS DOUBLE) AS total_damage,
    COALESCE(CAST(SUM(CAST(COALESCE(magnitude, 0.0{D}) AS DECIMAL(38,6))) AS DOUBLE) / COUNT(*), 0.0{D}) AS avg_magnitude
  FROM ev GROUP BY entity, t),
oil AS (
  SELECT {month('l_shipdate')} AS t,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS {tp.GLOBAL_COLUMN}
  FROM lineitem GROUP BY 1),
master AS (
  SELECT l.entity, l.t, l.gdp, g.gdp_growth,
    COALESCE(e.n_events, 0) AS n_events,
    COALESCE(e.total_deaths, 0.0{D}) AS total_deaths,
    COALESCE(e.total_damage, 0.0{D}) AS total_damage,
    COALESCE(e.avg_magnitude, 0.0{D}) AS avg_magnitude,
    o.{tp.GLOBAL_COLUMN},
    ln(1.0{D} + COALESCE(e.total_damage, 0.0{D})) AS log_total_damage,
    CASE WHEN COALESCE(l.gdp, 0.0{D}) > 0 THEN COALESCE(e.total_damage, 0.0{D}) / l.gdp ELSE 0.0{D} END
      AS damage_share_gdp,
    CAST(COALESCE(e.n_events, 0) > 0 AS INTEGER) AS has_disaster
  FROM lvl l JOIN gr g ON l.entity = g.entity AND l.t = g.t
  LEFT JOIN evagg e ON l.entity = e.entity AND l.t = e.t
  LEFT JOIN oil o ON l.t = o.t)"""

"""Registered queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Every builder reads the driver's tables under ``sf_dir`` in full (no key subsets, no
row caps) and returns a DataFrame whose columns match the oracle by name.  Builders of
runs run jobs while they build: they write the split dataset once and fit models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import evaluate as ev
from panelcast.operators import features as fe
from panelcast.operators import panel as pn
from panelcast.operators import split as sp
from panelcast.plans import oracle as O
from panelcast.plans import standard as st
from panelcast.plans.standard import RunConfig, rounded
from panelcast.sources import tpch_panel as tp

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

MAIN = RunConfig()
# nowcast, ex-post regime dummy, macro and oil blocks, restricted start
FULL = RunConfig(tag="run_nowcast_ex_post_restricted_macro_oil", mode="nowcast", include_covid=True,
                 include_macro=True, include_oil=True, start=tp.RESTRICTED_START, test_ratio=0.25)


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _cfg_feats(cfg: RunConfig) -> list[str]:
    return fe.feature_list(O.FEATURE_COLUMNS, include_oil=cfg.include_oil, include_macro=cfg.include_macro,
                           include_covid=cfg.include_covid, mode=cfg.mode)


def _requested(cfg: RunConfig) -> list[tuple[str, str]]:
    return fe.requested_features(include_oil=cfg.include_oil, include_macro=cfg.include_macro,
                                 include_covid=cfg.include_covid, mode=cfg.mode)


def _meta(cfg: RunConfig) -> dict:
    return ev.run_metadata(cfg.tag, cfg.mode, cfg.include_macro, cfg.include_oil, cfg.include_covid,
                           cfg.start, cfg.test_ratio, len(_cfg_feats(cfg)))


def _run_sql_prefix(cfg: RunConfig) -> str:
    return _with(O.base_ctes(), O.feat_cte(), O.ds_cte(_cfg_feats(cfg), cfg.start), O.split_ctes(cfg.test_ratio))


# ---------------------------------------------------------------- panel (C1, A1, J*, S3)

@register("c1_master_panel",
          _with(O.base_ctes()) + "\n" + O.select_rounded(O.MASTER_COLUMNS, O.MASTER_DOUBLES, "master"))
def q_master(spark, d):
    return rounded(st.master_panel(spark, d))


@register("c1_master_panel_join_chain",
          _with(O.base_ctes()) + "\n" + O.select_rounded(O.MASTER_COLUMNS, O.MASTER_DOUBLES, "master"))
def q_master_joins(spark, d):
    return rounded(st.master_panel_joins(spark, d))


@register("s3_clean_events", _with(O.base_ctes()) + "\n" + O.select_rounded(
    ["entity", "t", "deaths", "damage_usd_thousands", "damage_usd", "magnitude"],
    {"deaths", "damage_usd_thousands", "damage_usd", "magnitude"}, "ev"))
def q_events(spark, d):
    return rounded(st.event_list(spark, d).select(
        "entity", "t", "deaths", "damage_usd_thousands", "damage_usd", "magnitude"))


@register("a1_event_aggregates", _with(O.base_ctes()) + "\n" + O.select_rounded(
    ["entity", "t", "n_events", "total_deaths", "total_damage", "avg_magnitude"],
    {"total_deaths", "total_damage", "avg_magnitude"}, "evagg"))
def q_evagg(spark, d):
    return rounded(pn.aggregate_events(st.event_list(spark, d), decimal_scale=st.DECIMAL_SCALE))


@register("j3_macro_block", _with(O.base_ctes()) + "\n" + O.select_rounded(
    ["entity", "t", *tp.MACRO_COLUMNS], set(tp.MACRO_COLUMNS), "macro"))
def q_macro(spark, d):
    return rounded(pn.merge_series(tp.macro_series(spark, d)))


@register("j5_global_series", _with(O.base_ctes()) + "\n" + O.select_rounded(
    ["t", tp.GLOBAL_COLUMN], {tp.GLOBAL_COLUMN}, "oil"))
def q_oil(spark, d):
    return rounded(tp.global_series(spark, d))


def _j3_parts(spark, d):
    """Three keyed series; the first two repeat (entity, t): one row for each order status, one for
    each order priority."""
    orders = spark.read.parquet(f"{d}/orders.parquet").join(
        spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity")), "o_custkey")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    rows = orders.withColumn("t", month)
    return [rows.groupBy("entity", "t", "o_orderstatus").agg(price.alias("by_status")).drop("o_orderstatus"),
            rows.groupBy("entity", "t", "o_orderpriority").agg(price.alias("by_priority")).drop("o_orderpriority"),
            rows.groupBy("entity", (F.col("t") + 1).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("before"))]


@register("j3_repeated_keys", """
WITH o AS (SELECT c_nationkey AS entity, """ + O.month("o_orderdate") + """ AS t, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus, o_orderpriority
           FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT entity, t, CAST(sum(price) AS DOUBLE) AS by_status FROM o GROUP BY entity, t, o_orderstatus),
b AS (SELECT entity, t, CAST(sum(price) AS DOUBLE) AS by_priority FROM o GROUP BY entity, t, o_orderpriority),
c AS (SELECT entity, t + 1 AS t, CAST(count(*) AS DOUBLE) AS before FROM o GROUP BY entity, t)
SELECT entity, t, """ + ", ".join(f"{O.r(c)} AS {c}" for c in ("by_status", "by_priority", "before")) + """
FROM a FULL JOIN b USING (entity, t) FULL JOIN c USING (entity, t)""")
def q_repeated_keys(spark, d):
    """J3 with keys that series repeat: rows multiply as in the chain of joins."""
    return rounded(pn.merge_series(_j3_parts(spark, d)))


@register("a13_key_quality", _with(O.base_ctes()) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count_if(entity IS NULL OR t IS NULL) AS BIGINT) AS n_null_keys,
       CAST(count_if(n_events < 0) AS BIGINT) AS n_negative_n_events,
       CAST(count_if(total_deaths < 0) AS BIGINT) AS n_negative_total_deaths,
       CAST(count_if(total_damage < 0) AS BIGINT) AS n_negative_total_damage,
       (SELECT count(*) FROM (SELECT entity, t FROM master GROUP BY entity, t HAVING count(*) > 1))
         AS n_duplicate_keys
FROM master""")
def q_quality(spark, d):
    return pn.key_quality(st.master_panel(spark, d))


# ---------------------------------------------------------------- features

_FEAT_DOUBLES = O.MASTER_DOUBLES | {"gdp_growth_lag1", "gdp_growth_lag2", "gdp_growth_roll3_mean",
                                    "gdp_growth_roll5_mean", "gdp_growth_roll5_std", "oil_price_usd_change"} \
    | {f"{c}_lag1" for c in fe.TO_LAG if c != "n_events"}


@register("c2_feature_table", _with(O.base_ctes(), O.feat_cte()) + "\n"
          + O.select_rounded(O.FEATURE_COLUMNS, _FEAT_DOUBLES, "feat"))
def q_features(spark, d):
    return rounded(st.feature_table(spark, d).select(*O.FEATURE_COLUMNS))


def _ds_query(cfg: RunConfig):
    feats = _cfg_feats(cfg)
    cols = ["entity", "t", "y", *[c for c in feats if c not in ("entity", "t")]]
    sql = _with(O.base_ctes(), O.feat_cte(), O.ds_cte(feats, cfg.start)) + "\n" + \
        O.select_rounded(cols, set(cols) - {"entity", "t"}, "ds")

    def build(spark, d):
        ds, _ = st.dataset(spark, d, cfg)
        return rounded(ds.select(*cols))
    return build, sql


for _name, _cfg in [("c3_dataset_forecast_main", MAIN), ("c3_dataset_nowcast_full", FULL)]:
    _b, _s = _ds_query(_cfg)
    register(_name, _s)(_b)


@register("p12_feature_coverage", _with(O.base_ctes(), O.feat_cte(), O.ds_cte(_cfg_feats(FULL), FULL.start))
          + "\nSELECT feature, block, " + O.r("n_present / n") + " AS coverage FROM (SELECT count(*) AS n, "
          + ", ".join(f"count({c}) AS c_{c}" for c in _cfg_feats(FULL)) + " FROM ds) s, LATERAL (VALUES "
          + ", ".join(f"('{c}', '{b}', s.c_{c})" for c, b in [
              (c, "macro" if c in fe.MACRO_FEATURES else "oil" if c in fe.OIL_FEATURES + fe.NOWCAST_OIL
               else "covid" if c == "covid_dummy" else "nowcast" if c in fe.NOWCAST_FEATURES else "base")
              for c in _cfg_feats(FULL)]) + ") v(feature, block, n_present)")
def q_coverage(spark, d):
    ds, _ = st.dataset(spark, d, FULL)
    return rounded(fe.feature_coverage(ds, _requested(FULL)))


@register("p12_coverage_absent_block", _with(O.base_ctes(), O.feat_cte(), O.ds_cte(_cfg_feats(FULL), FULL.start))
          + "\nSELECT feature, block, " + O.r("n_present / n") + " AS coverage FROM (SELECT count(*) AS n, "
          + ", ".join(f"count({c}) AS c_{c}" for c in _cfg_feats(FULL)) + " FROM ds) s, LATERAL (VALUES "
          + ", ".join(f"('{c}', '{b}', {'0' if b == 'macro' else 's.c_' + c})" for c, b in _requested(FULL))
          + ") v(feature, block, n_present)")
def q_coverage_absent(spark, d):
    """The macro block is asked for and the panel has none: reported with coverage 0."""
    ft = st.feature_table(spark, d)
    gone = [c for c in ft.columns if c in tp.MACRO_COLUMNS or c in fe.MACRO_FEATURES]
    ds, _ = st.dataset(spark, d, FULL, ft.drop(*gone))
    return rounded(fe.feature_coverage(ds, _requested(FULL)))


# ---------------------------------------------------------------- split and folds

@register("w7_chrono_split", _run_sql_prefix(MAIN) + "\nSELECT entity, t, side FROM sp")
def q_split(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN)
    return s.select("entity", "t", "side")


@register("a12_chronology", _run_sql_prefix(FULL) + """
SELECT max(CASE WHEN side = 'train' THEN t END) AS max_train_t,
       min(CASE WHEN side = 'test' THEN t END) AS min_test_t,
       CAST(count_if(side = 'train') AS BIGINT) AS n_train,
       CAST(count_if(side = 'test') AS BIGINT) AS n_test,
       count(*) AS n_rows,
       max(CASE WHEN side = 'train' THEN t END) < min(CASE WHEN side = 'test' THEN t END) AS chronological
FROM sp""")
def q_chrono(spark, d):
    s, _ = st.split_dataset(spark, d, FULL, checkpoint=True)
    return sp.chronology_check(s)


_FOLD_SQL = """,
tp AS (
  SELECT t, row_number() OVER (ORDER BY t) AS pidx, count(*) OVER () AS n
  FROM (SELECT DISTINCT t FROM sp WHERE side = 'train')),
kb AS (
  SELECT n, least(5, greatest(2, CAST(floor(n / 6) AS BIGINT))) AS k FROM (SELECT max(n) AS n FROM tp)),
kb2 AS (SELECT n, k, CAST(floor(n / (k + 1)) AS BIGINT) AS block FROM kb),
folds AS (
  SELECT CAST(i AS INTEGER) AS fold,
         (SELECT t FROM tp WHERE pidx = kb2.n - (kb2.k - i) * kb2.block) AS train_end_t,
         (SELECT t FROM tp WHERE pidx = kb2.n - (kb2.k - i) * kb2.block + kb2.block) AS val_end_t,
         kb2.n AS n_train_periods, CAST(kb2.k AS INTEGER) AS k
  FROM kb2, range(0, 5) r(i) WHERE i < kb2.k)"""


@register("w8_fold_table", _run_sql_prefix(MAIN) + _FOLD_SQL + "\nSELECT * FROM folds")
def q_folds(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    return sp.fold_bounds(s.filter(F.col("side") == "train"))


@register("w8_fold_rows", _run_sql_prefix(MAIN) + _FOLD_SQL + """
SELECT f.fold, CASE WHEN s.t <= f.train_end_t THEN 'train' ELSE 'val' END AS role, s.entity, s.t
FROM sp s JOIN folds f ON s.t <= f.val_end_t WHERE s.side = 'train'""")
def q_fold_rows(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    return sp.assign_folds(s.filter(F.col("side") == "train")).select("fold", "role", "entity", "t")


# ---------------------------------------------------------------- baselines and metrics

@register("m1_m3_baseline_predictions", _run_sql_prefix(MAIN) + ",\n" + O.preds_cte()
          + "\n" + O.select_rounded(["model", "side", "entity", "t", "y", "p"], {"y", "p"}, "preds"))
def q_preds(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    return rounded(ev.baseline_predictions(s).select("model", "side", "entity", "t", "y", "p"))


@register("a5_severe_threshold", _run_sql_prefix(MAIN) + ",\n" + O.thr_cte()
          + "\nSELECT " + O.r("threshold") + " AS threshold, n_pos FROM thr")
def q_thr(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    return rounded(ev.severe_threshold(s, 0.85))


def _metrics_query(cfg: RunConfig, raw: bool = False):
    sql = _run_sql_prefix(cfg) + ",\n" + O.preds_cte() + ",\n" + \
        O.thr_cte(cfg.severe_q, cfg.min_pos, cfg.fallback) + "," + \
        O.metrics_select(_meta(cfg), cfg.severe_q, subset_min_n=cfg.subset_min_n, raw=raw)

    def build(spark, d):
        return rounded(st.baseline_metrics(spark, d, cfg))
    return build, sql


# side B of the reference: q = 0.75, quantile of all train values below 5 positives,
# subset metrics only from 2 rows on
SIDE_B = RunConfig(tag="run_forecast_strict_main_side_b", severe_q=0.75, fallback="all", min_pos=5,
                   subset_min_n=2)

for _name, _cfg in [("c4_baseline_metrics_main", MAIN), ("c4_baseline_metrics_full", FULL),
                    ("c4_baseline_metrics_side_b", SIDE_B)]:
    _b, _s = _metrics_query(_cfg)
    register(_name, _s)(_b)


# ---------------------------------------------------------------- sources from wide extracts

@register("s4_coded_extract_long", """
WITH y AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS entity, CAST(year(o.o_orderdate) AS INTEGER) AS t,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT entity, t, """ + O.r("value") + """ AS value FROM y""")
def q_coded(spark, d):
    from panelcast.operators.reshape import coded_extract_to_long
    return rounded(coded_extract_to_long(tp.wide_coded_extract(spark, d), "value"))


@register("s1_plain_extract_long", """
WITH y AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS entity, CAST(year(o.o_orderdate) AS INTEGER) AS t,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT entity, t, """ + O.r("gdp") + """ AS gdp FROM y""")
def q_plain(spark, d):
    from panelcast.operators.reshape import wide_extract_to_long
    wide = tp.wide_plain_extract(spark, d)
    return rounded(wide_extract_to_long(wide, "Country Code", "gdp",
                                        id_cols=["Country Name", "Country Code", "Indicator Name", "Indicator Code"]))


@register("s6_dated_series", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS t,
       """ + O.r("CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)") + """ AS oil_price_usd
FROM lineitem GROUP BY 1""")
def q_dated(spark, d):
    from panelcast.sources.extracts import dated_series_to_annual
    li = tp.read_table(spark, d, "lineitem")
    dated = (li.groupBy(F.year("l_shipdate").alias("y"))
               .agg((F.sum(F.col("l_extendedprice").cast(tp.DEC)).cast("double") / F.count(F.lit(1))).alias("POILAPSPUSDA"))
               .select(F.make_date("y", F.lit(1), F.lit(1)).alias("observation_date"), "POILAPSPUSDA"))
    return rounded(dated_series_to_annual(dated))


_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DIRTY_TXT = "CASE " + " ".join(f"WHEN o_orderkey % 97 = {k} THEN '{v}'" for k, v in tp.DIRTY_TOKENS.items()) \
    + " ELSE CAST(o_totalprice AS VARCHAR) END"


@register("p4_dirty_text_cast", f"""
WITH d AS (SELECT o_orderkey, {_DIRTY_TXT} AS txt, CAST(year(o_orderdate) AS VARCHAR) AS ytxt FROM orders),
c AS (SELECT o_orderkey,
        CASE WHEN regexp_matches(txt, '{_NUM}') THEN TRY_CAST(trim(txt) AS DOUBLE) END AS v,
        CASE WHEN regexp_matches(ytxt, '{_NUM}') THEN TRY_CAST(trim(ytxt) AS DOUBLE) END AS yv FROM d)
SELECT o_orderkey,
       {O.r("CASE WHEN isfinite(v) THEN v END")} AS totalprice,
       CAST(trunc(CASE WHEN isfinite(yv) THEN yv END) AS INTEGER) AS year,
       {O.r("COALESCE(CASE WHEN isfinite(v) THEN v END, 0.0::DOUBLE)")} AS totalprice_or_zero
FROM c""")
def q_dirty(spark, d):
    from panelcast.functions.scalar import safe_double, safe_int, tolerant_float
    t = tp.dirty_orders_text(spark, d)
    return rounded(t.select("o_orderkey", safe_double("totalprice_text").alias("totalprice"),
                            safe_int("year_text").alias("year"),
                            tolerant_float("totalprice_text", 0.0).alias("totalprice_or_zero")))


@register("w1_calendar_lag", _with(O.base_ctes()) + """
SELECT m.entity, m.t, """ + O.r("m.gdp_growth") + """ AS gdp_growth,
       """ + O.r("lag(m.gdp_growth, 1) OVER (PARTITION BY m.entity ORDER BY m.t)") + """ AS gdp_growth_lag1,
       """ + O.r("p.gdp_growth") + """ AS gdp_growth_clag1
FROM master m LEFT JOIN master p ON p.entity = m.entity AND p.t + 1 = m.t""")
def q_clag(spark, d):
    m = st.master_panel(spark, d).select("entity", "t", "gdp_growth")
    w = fe.entity_window()
    out = fe.calendar_lag(m.withColumn("gdp_growth_lag1", F.lag("gdp_growth", 1).over(w)), "gdp_growth", 1)
    return rounded(out.select("entity", "t", "gdp_growth", "gdp_growth_lag1", "gdp_growth_clag1"))


@register("c9_eda_events", _with(O.base_ctes()) + """
SELECT entity, t, n_events, """ + O.r("ln(1.0::DOUBLE + greatest(COALESCE(total_damage, 0.0::DOUBLE), 0.0::DOUBLE))") + """
  AS log_total_damage, """ + O.r("gdp_growth") + """ AS target FROM master""")
def q_eda(spark, d):
    from panelcast.operators import report as rp
    m = st.master_panel(spark, d)
    return rounded(rp.eda_events(m).join(rp.eda_target(m), ["entity", "t"]))


def _hist_sql(src: str, expr: str, scale: str, bins: int = 30) -> str:
    return f"""
SELECT * FROM (
WITH v AS (SELECT {expr} AS x FROM {src} WHERE total_damage IS NOT NULL),
s0 AS (SELECT min(x) AS mn0, max(x) AS mx0, count(*) AS n FROM v),
s AS (SELECT CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn,
             CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM s0 WHERE n >= 6),
st AS (SELECT mn, mx, (mx - mn) / {bins}.0::DOUBLE AS step, {bins}.0::DOUBLE / (mx - mn) AS norm FROM s),
b0 AS (SELECT x, CASE WHEN CAST(trunc((x - mn) * norm) AS INTEGER) >= {bins} THEN {bins - 1}
                      ELSE CAST(trunc((x - mn) * norm) AS INTEGER) END AS i0 FROM v, st),
b1 AS (SELECT x, CASE WHEN x < (CASE WHEN i0 >= {bins} THEN (SELECT mx FROM st) ELSE i0 * (SELECT step FROM st) + (SELECT mn FROM st) END)
                      THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT CASE WHEN x >= (CASE WHEN i1 + 1 >= {bins} THEN (SELECT mx FROM st) ELSE (i1 + 1) * (SELECT step FROM st) + (SELECT mn FROM st) END)
                        AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin FROM b1),
c AS (SELECT bin, count(*) AS cnt FROM b2 GROUP BY bin),
g AS (SELECT CAST(i AS INTEGER) AS bin FROM st, range(0, {bins}) r(i))
SELECT '{scale}' AS scale, g.bin,
       {O.r(f"CASE WHEN g.bin >= {bins} THEN st.mx ELSE g.bin * st.step + st.mn END")} AS lo,
       {O.r(f"CASE WHEN g.bin + 1 >= {bins} THEN st.mx ELSE (g.bin + 1) * st.step + st.mn END")} AS hi,
       COALESCE(c.cnt, 0) AS count
FROM g CROSS JOIN st LEFT JOIN c ON g.bin = c.bin)"""


@register("a10_damage_histogram", _with(O.base_ctes()) + _hist_sql(
    "master", "greatest(COALESCE(total_damage, 0.0::DOUBLE), 0.0::DOUBLE)", "raw") + "\nUNION ALL" + _hist_sql(
    "master", "ln(1.0::DOUBLE + greatest(COALESCE(total_damage, 0.0::DOUBLE), 0.0::DOUBLE))", "log1p"))
def q_hist(spark, d):
    from panelcast.operators import report as rp
    m = st.master_panel(spark, d)
    return rounded(rp.histogram(m, "total_damage").unionByName(rp.histogram(m, "total_damage", transform="log1p")))


# ---------------------------------------------------------------- suite of runs and reports (C5, U2, H, C6, R3, F8-F13)

SUITE = st.suite_configs()


def _suite_sql(raw: bool = False) -> str:
    parts = []
    for cfg in SUITE:
        _, sql = _metrics_query(cfg, raw)
        parts.append(f"SELECT * FROM ({sql})")
    return "\nUNION ALL\n".join(parts)


def _suite_spark(spark, d):
    from panelcast.session import materialize
    ft = materialize(st.feature_table(spark, d))      # built once, read by the four runs
    out = None
    for cfg in SUITE:
        # each dataset is a filter / projection of the checkpointed feature table
        m = st.baseline_metrics(spark, d, cfg, ft, checkpoint=False)
        out = m if out is None else out.unionByName(m)
    return out


@register("c5_suite_baseline_metrics", _suite_sql())
def q_suite(spark, d):
    return rounded(_suite_spark(spark, d))


_SUITE_CTE = "WITH suite AS (" + _suite_sql() + ")\n"
_RAW_SUITE_CTE = "WITH suite AS (" + _suite_sql(raw=True) + ")\n"      # rank first, round last


@register("h2_best_model_per_tag", _RAW_SUITE_CTE + """
SELECT tag, model, """ + O.r("test_RMSE") + """ AS test_RMSE FROM (
  SELECT tag, model, test_RMSE,
         row_number() OVER (PARTITION BY tag ORDER BY test_RMSE ASC NULLS LAST, model) AS rn FROM suite)
WHERE rn = 1""")
def q_best(spark, d):
    from panelcast.operators import report as rp
    return rounded(rp.best_model(_suite_spark(spark, d)).select("tag", "model", "test_RMSE"))


@register("h3_leaderboard", _RAW_SUITE_CTE + "SELECT tag, model, " + ", ".join(
    f"{O.r(c)} AS {c}" for c in ("test_RMSE", "test_MAE", "test_R2")) + " FROM suite")
def q_board(spark, d):
    from panelcast.operators import report as rp
    return rounded(rp.leaderboard(_suite_spark(spark, d)))


@register("c6_run_comparison", _RAW_SUITE_CTE + """,
best AS (
  SELECT tag, model AS best_model, test_RMSE AS best_test_RMSE, test_R2 AS best_test_R2 FROM (
    SELECT *, row_number() OVER (PARTITION BY tag ORDER BY test_RMSE ASC NULLS LAST, model) AS rn
    FROM suite WHERE NOT starts_with(model, 'baseline_mean')) WHERE rn = 1),
ref AS (SELECT tag, first(test_RMSE) AS baseline_roll3_test_RMSE FROM suite
        WHERE model = 'baseline_roll3_mean' GROUP BY tag)
SELECT best.tag, best_model, """ + O.r("best_test_RMSE") + """ AS best_test_RMSE, """ + O.r("best_test_R2") + """ AS best_test_R2,
       """ + O.r("ref.baseline_roll3_test_RMSE") + """ AS baseline_roll3_test_RMSE,
       """ + O.r("ref.baseline_roll3_test_RMSE - best.best_test_RMSE") + """ AS rmse_gain_vs_roll3
FROM best LEFT JOIN ref USING (tag)""")
def q_cmp(spark, d):
    from panelcast.operators import report as rp
    return rounded(rp.run_comparison(_suite_spark(spark, d), exclude_prefix="baseline_mean"))


_MODELS3 = ["baseline_last_year", "baseline_mean_train", "baseline_roll3_mean"]


@register("r3_pivot_suite_rmse", _SUITE_CTE + "SELECT tag, " + ", ".join(
    f"{O.r(f'avg(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN test_RMSE END)')} AS {m}" for m in _MODELS3)
    + " FROM suite GROUP BY tag")
def q_pivot(spark, d):
    from panelcast.operators.reshape import pivot_mean
    return rounded(pivot_mean(q_suite(spark, d), "tag", "model", "test_RMSE", _MODELS3))


@register("f8_f13_config_from_metrics", _SUITE_CTE + """
SELECT tag, model,
  CASE WHEN contains(lower(tag), 'nowcast') THEN 'nowcast' ELSE 'forecast' END AS tag_mode,
  contains(lower(tag), 'ex_post') AS tag_covid,
  contains(lower(tag), 'macro') AS tag_macro,
  contains(lower(tag), 'oil') AS tag_oil,
  contains(lower(tag), 'restricted') AS tag_restricted,
  CASE WHEN start_year >= 0 THEN start_year END AS start,
  CASE WHEN isfinite(test_RMSE) THEN printf('%.3f', test_RMSE) ELSE '' END AS test_RMSE_text,
  concat_ws('_', 'run', mode, CASE WHEN include_covid THEN 'ex_post' ELSE 'strict' END) AS tag_prefix,
  lower(trim(CAST(include_macro AS VARCHAR))) IN ('1', 'true', 't', 'yes', 'y') AS macro_flag
FROM suite""")
def q_cfg(spark, d):
    from panelcast.functions import scalar as fs
    m = q_suite(spark, d)
    fl = fs.tag_flags("tag")
    return m.select("tag", "model", fl["mode"].alias("tag_mode"), fl["include_covid"].alias("tag_covid"),
                    fl["include_macro"].alias("tag_macro"), fl["include_oil"].alias("tag_oil"),
                    fl["restricted"].alias("tag_restricted"), fs.sentinel_to_null("start_year").alias("start"),
                    fs.format_number3("test_RMSE").alias("test_RMSE_text"),
                    fs.config_tag(F.lit("run"), "mode",
                                  F.when(F.col("include_covid"), "ex_post").otherwise("strict")).alias("tag_prefix"),
                    fs.tolerant_bool(F.col("include_macro").cast("string")).alias("macro_flag"))


_RESTRICTED_TAG = SUITE[1].tag


def _results_root(spark, name: str) -> str:
    """Where a query puts its result tables: the session's warehouse, by application."""
    import uuid
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/panelcast_results/{spark.sparkContext.applicationId}/{name}_{uuid.uuid4().hex[:8]}"


@register("s7_s8_results_round_trip", _SUITE_CTE + f"""
SELECT model, test_RMSE, test_MAE, test_R2, n_train, n_test, tag FROM suite WHERE tag = '{_RESTRICTED_TAG}'""")
def q_results(spark, d):
    """S7 + S8: the suite's metrics written as a tag-partitioned table (dynamic
    partition overwrite), then one tag read back (partition pruning: only that tag's
    files are listed and read)."""
    from panelcast.sources import results as rs
    path = _results_root(spark, "s7_s8") + "/model_metrics"
    rs.write_tagged(q_suite(spark, d).select("model", "test_RMSE", "test_MAE", "test_R2", "n_train",
                                             "n_test", "tag"), path)
    return rs.read_tagged(spark, path, _RESTRICTED_TAG, missing="error")


@register("s10_scan_runs", _SUITE_CTE + """
SELECT tag, model, test_RMSE, n_test FROM suite""")
def q_scan(spark, d):
    """Every run's metrics (all columns) written to a folder of its own, then all runs
    read back by one glob: three columns by name, the tag from the path."""
    from panelcast.sources import results as rs
    runs = rs.write_runs(q_suite(spark, d), _results_root(spark, "s10"))
    return rs.scan_runs(spark, runs, schema="test_RMSE double, model string, n_test bigint") \
             .select("tag", "model", "test_RMSE", "n_test")


_NOTE_SQL = "concat(c_name, chr(10), '\"', c_mktsegment, '\", ', c_nationkey)"


@register("s3_quoted_line_ends", f"SELECT c_custkey, {_NOTE_SQL} AS note, {O.r('c_acctbal')} AS c_acctbal FROM customer")
def q_quoted(spark, d):
    """S1, S3, S4's reader: customers with a note of two lines, quotes and a comma, written to
    several CSV files and read back record by record."""
    from panelcast.sources.headed import headed_files
    path = _results_root(spark, "s3") + "/customers"
    note = F.concat("c_name", F.lit("\n\""), "c_mktsegment", F.lit("\", "), F.col("c_nationkey").cast("string"))
    (spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", note.alias("note"), "c_acctbal").repartition(4, "c_custkey")
     .write.csv(path, header=True, quoteAll=True, escape='"'))
    (_, rows), = headed_files(spark, path)
    return rounded(rows.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "note", F.col("c_acctbal").cast("double").alias("c_acctbal")))


@register("s9_latest_run", _SUITE_CTE + "SELECT min(tag) AS tag FROM suite")
def q_latest(spark, d):
    """The run whose tag sorts first is written after the others; the newest file names
    the latest run."""
    from panelcast.session import materialize
    from panelcast.sources import results as rs
    root = _results_root(spark, "s9")
    suite = materialize(q_suite(spark, d).select("model", "test_RMSE", "tag"))
    last = F.col("tag") == suite.agg(F.min("tag")).first()[0]
    rs.write_runs(suite.filter(~last), root)
    return rs.latest_run(spark, rs.write_runs(suite.filter(last), root, mode="append"))


# ---------------------------------------------------------------- single-run reports

_MAIN_PRED_SQL = _run_sql_prefix(MAIN) + ",\n" + O.preds_cte()


_MX_CTE = "WITH mx AS (" + _metrics_query(MAIN)[1] + ")\n"


@register("c7_shock_table", _MX_CTE + " UNION ALL ".join(
    f"SELECT model, severe_threshold_damage_share_train AS threshold, '{n}' AS subset, test_count_{n} AS n, "
    f"test_RMSE_{n} AS RMSE, test_MAE_{n} AS MAE, test_R2_{n} AS R2 FROM mx" for n in ev.SUBSETS))
def q_shock(spark, d):
    return ev.shock_table(rounded(st.baseline_metrics(spark, d, MAIN)))


@register("c8_model_summary", _MX_CTE + "SELECT model, train_RMSE, test_RMSE, train_MAE, test_MAE, train_R2, test_R2 FROM mx")
def q_summary(spark, d):
    return ev.model_summary(rounded(st.baseline_metrics(spark, d, MAIN)))


@register("h4_top_abs_errors", _MAIN_PRED_SQL + """
SELECT entity, t, """ + O.r("y") + """ AS actual, """ + O.r("p") + """ AS pred, """ + O.r("y - p") + """ AS error,
       """ + O.r("abs(y - p)") + """ AS abs_error
FROM preds WHERE model = 'baseline_roll3_mean' AND side = 'test'
ORDER BY abs(y - p) DESC NULLS LAST, entity, t LIMIT 10""")
def q_top(spark, d):
    from panelcast.operators import report as rp
    from panelcast.plans.runs import export_predictions
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    ex = export_predictions(ev.baseline_predictions(s), "baseline_roll3_mean")
    return rounded(rp.top_k(ex, "abs_error", 10, ["entity", "t"]))


@register("m12_predictions_export", _MAIN_PRED_SQL + """
SELECT entity, t, """ + O.r("y") + """ AS actual, """ + O.r("p") + """ AS pred, """ + O.r("y - p") + """ AS error,
       """ + O.r("abs(y - p)") + """ AS abs_error
FROM preds WHERE model = 'baseline_roll3_mean' AND side = 'test'""")
def q_export(spark, d):
    from panelcast.plans.runs import export_predictions
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    return rounded(export_predictions(ev.baseline_predictions(s), "baseline_roll3_mean"))


@register("c10_error_vs_proxy", _MAIN_PRED_SQL + """
SELECT p.entity, p.t, """ + O.r("p.y - p.p") + """ AS error, """ + O.r("f.damage_share_gdp_lag1") + """ AS damage_share_gdp_lag1
FROM preds p LEFT JOIN feat f ON p.entity = f.entity AND p.t = f.t
WHERE p.model = 'baseline_roll3_mean' AND p.side = 'test'""")
def q_proxy(spark, d):
    from panelcast.operators import report as rp
    from panelcast.plans.runs import export_predictions
    ft = st.feature_table(spark, d)
    s, _ = st.split_dataset(spark, d, MAIN, ft)
    ex = export_predictions(ev.baseline_predictions(s), "baseline_roll3_mean")
    return rounded(rp.error_vs_proxy(ex, ft))


@register("m4_ols_one_feature", _run_sql_prefix(MAIN) + """
SELECT entity, """ + O.r("regr_slope(y, gdp_growth_lag1)") + """ AS slope,
       """ + O.r("regr_intercept(y, gdp_growth_lag1)") + """ AS intercept,
       CAST(regr_count(y, gdp_growth_lag1) AS BIGINT) AS n
FROM sp WHERE side = 'train' GROUP BY entity""")
def q_ols1(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN)
    tr_ = s.filter(F.col("side") == "train")
    return rounded(tr_.groupBy("entity").agg(F.regr_slope("y", "gdp_growth_lag1").alias("slope"),
                                             F.regr_intercept("y", "gdp_growth_lag1").alias("intercept"),
                                             F.regr_count("y", "gdp_growth_lag1").alias("n")))


@register("a3b_scores_by_model_side", _MAIN_PRED_SQL + """
SELECT model, side, count(*) AS n, """ + O.r("sqrt(avg((y - p) * (y - p)))") + """ AS RMSE,
       """ + O.r("avg(abs(y - p))") + """ AS MAE,
       """ + O.r("CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) * count(*) = 0 THEN "
                 "CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
                 "ELSE 1.0::DOUBLE - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END") + """ AS R2
FROM preds GROUP BY model, side""")
def q_scores(spark, d):
    s, _ = st.split_dataset(spark, d, MAIN, checkpoint=True)
    return rounded(ev.simple_scores(ev.baseline_predictions(s)))


def _stats_sql(cfg: RunConfig) -> str:
    feats = _cfg_feats(cfg)
    meds = ", ".join(f"COALESCE(median({c}), 0.0::DOUBLE) AS med_{c}" for c in feats)
    parts = []
    for c in feats:
        x = f"COALESCE({c}, (SELECT med_{c} FROM med))"
        parts.append(f"SELECT '{c}' AS feature, {O.r(f'(SELECT med_{c} FROM med)')} AS median, "
                     f"{O.r(f'avg({x})')} AS mean, {O.r(f'stddev_pop({x})')} AS std, "
                     f"{O.r(f'CASE WHEN stddev_pop({x}) = 0 THEN 1.0::DOUBLE ELSE stddev_pop({x}) END')} AS scale "
                     f"FROM sp WHERE side = 'train'")
    return _run_sql_prefix(cfg) + f",\nmed AS (SELECT {meds} FROM sp WHERE side = 'train')\n" + \
        "\nUNION ALL\n".join(parts)


@register("a8_a9_imputer_scaler_stats", _stats_sql(FULL))
def q_imp_stats(spark, d):
    from panelcast.operators.linear import imputer_scaler_stats
    s, feats = st.split_dataset(spark, d, FULL, checkpoint=True)
    return rounded(imputer_scaler_stats(s.filter(F.col("side") == "train"),
                                        [c for c in feats]))


# ---------------------------------------------------------------- supplier-scale panel (speed runs)

SPEED_LAGS = [c for c in fe.TO_LAG if c not in tp.MACRO_COLUMNS]
SPEED_FEAT_COLUMNS = [c for c in O.FEATURE_COLUMNS if c not in tp.MACRO_COLUMNS
                      and c not in {f"{m}_lag1" for m in tp.MACRO_COLUMNS}]


def _speed_sql(cfg: RunConfig) -> str:
    feats = fe.feature_list(SPEED_FEAT_COLUMNS, include_oil=cfg.include_oil, include_macro=cfg.include_macro,
                            include_covid=cfg.include_covid, mode=cfg.mode)
    meta = ev.run_metadata(cfg.tag, cfg.mode, cfg.include_macro, cfg.include_oil, cfg.include_covid,
                           cfg.start, cfg.test_ratio, len(feats))
    return (_with(O.speed_base_ctes(), O.feat_cte(lag_cols=SPEED_LAGS), O.ds_cte(feats, cfg.start),
                  O.split_ctes(cfg.test_ratio)) + ",\n" + O.preds_cte() + ",\n" + O.thr_cte(cfg.severe_q) + ","
            + O.metrics_select(meta, cfg.severe_q))


SPEED = RunConfig(tag="speed_supplier_forecast_oil", include_oil=True)


def speed_features(spark, d):
    return fe.add_features(st.speed_master_panel(spark, d), regime_cutoff=tp.REGIME_CUTOFF)


@register("speed_supplier_baseline_metrics", _speed_sql(SPEED))
def q_speed(spark, d):
    return rounded(st.baseline_metrics(spark, d, SPEED, speed_features(spark, d)))


_SPEED_FEAT_DOUBLES = (_FEAT_DOUBLES - set(tp.MACRO_COLUMNS)) - {f"{m}_lag1" for m in tp.MACRO_COLUMNS}


@register("speed_supplier_feature_table",
          _with(O.speed_base_ctes(), O.feat_cte(lag_cols=SPEED_LAGS)) + "\n"
          + O.select_rounded(SPEED_FEAT_COLUMNS, _SPEED_FEAT_DOUBLES, "feat"))
def q_speed_features(spark, d):
    return rounded(speed_features(spark, d).select(*SPEED_FEAT_COLUMNS))


_LINE_LAGS = ["total_deaths", "oil_price_usd"]
_LINE_COLUMNS = ["entity", "t", "gdp_growth", *_LINE_LAGS, "t2", "covid_dummy", "gdp_growth_lag1", "gdp_growth_lag2",
                 "gdp_growth_roll3_mean", "gdp_growth_roll5_mean", "gdp_growth_roll5_std", "oil_price_usd_change",
                 "total_deaths_lag1", "oil_price_usd_lag1"]
_LINE_DOUBLES = set(_LINE_COLUMNS) - {"entity", "t", "t2", "covid_dummy"}


@register("w1_w6_long_series", """WITH lines AS (
  SELECT l_returnflag AS entity, l_orderkey * 8 + l_linenumber AS t, max(l_discount) * 100.0::DOUBLE AS gdp_growth,
         max(l_quantity) AS total_deaths, max(l_extendedprice) AS oil_price_usd FROM lineitem GROUP BY 1, 2),""" + O.feat_cte("lines", lag_cols=_LINE_LAGS)
          + "\n" + O.select_rounded(_LINE_COLUMNS, _LINE_DOUBLES, "feat"))
def q_long_series(spark, d):
    """The window features of three series that hold all lines (the largest values of each line
    number): each is cut into pieces with halos."""
    from panelcast.operators import halo
    lines = tp.read_table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("entity"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t")).agg(
        (F.max("l_discount") * 100.0).alias("gdp_growth"), F.max("l_quantity").alias("total_deaths"),
        F.max("l_extendedprice").alias("oil_price_usd"))
    return rounded(halo.add_features_long(lines, regime_cutoff=tp.REGIME_CUTOFF).select(*_LINE_COLUMNS))


@register("speed_supplier_linear_metrics", None)
def q_speed_linear(spark, d):
    from panelcast.plans import runs
    split, feats, bounds = runs.prepare_run(spark, d, SPEED, speed_features(spark, d), checkpoint=True)
    res = runs.run_all_models(spark, split, feats, SPEED, models=("linear_regression", "ridge"),
                              checkpoint=False, bounds=bounds)
    return rounded(res.metrics)


# ---------------------------------------------------------------- linear models with one feature (closed forms in SQL)

_X = "gdp_growth_lag1"
_ALPHAS = (0.0, 1.0, 5.0, 25.0, 125.0)
# Least squares and ridge on one standardised feature: the slope is n cov / sd / (n + alpha).
_LINE = "AVG(y) AS my, AVG(" + _X + ") AS mx, STDDEV_POP(" + _X + ") AS sx, COVAR_POP(" + _X + ", y) AS cxy, COUNT(*) AS n"
_FIT = "my + (n * cxy / sx / (n + alpha)) * ((" + _X + " - mx) / sx)"
_TWO = "(VALUES ('linear_regression', 0.0::DOUBLE), ('ridge', 5.0::DOUBLE)) m(model, alpha)"
_FOLD_FITS = _FOLD_SQL + f""",
fold_rows AS (
  SELECT f.fold, CASE WHEN s.t <= f.train_end_t THEN 'train' ELSE 'val' END AS role, s.y, s.{_X}
  FROM sp s JOIN folds f ON s.t <= f.val_end_t WHERE s.side = 'train'),
fits AS (SELECT fold, {_LINE} FROM fold_rows WHERE role = 'train' GROUP BY fold)"""


@register("m4_m5_one_feature_predictions", _run_sql_prefix(MAIN) + f""",
st AS (SELECT {_LINE} FROM sp WHERE side = 'train')
SELECT model, side, entity, t, {O.r(_FIT)} AS p FROM sp, st, {_TWO}""")
def q_line_predictions(spark, d):
    """M4, M5: our Gram solve with one feature."""
    res, _ = _run(spark, d, MAIN, [_X], models=LINEAR, cv=False)
    p = res.predictions.filter(F.col("model").isin(*LINEAR))
    return rounded(p.select("model", "side", "entity", "t", "p"))


_Z = "gdp_growth_lag2"


@register("m4_m5_two_feature_predictions", _run_sql_prefix(MAIN) + f""",
med AS (SELECT median({_X}) AS m1, median({_Z}) AS m2 FROM sp WHERE side = 'train'),
fl AS (SELECT side, entity, t, y, coalesce({_X}, m1) AS a, coalesce({_Z}, m2) AS b FROM sp, med),
st AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n,
  covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, covar_pop(a, b) AS cab FROM fl WHERE side = 'train'),
eq AS (SELECT *, n + alpha AS d, n * cab / (sa * sb) AS o, n * cay / sa AS u, n * cby / sb AS v FROM st, {_TWO})
SELECT model, side, entity, t, {O.r('my + (u * d - v * o) / (d * d - o * o) * ((a - ma) / sa) + (v * d - u * o) / (d * d - o * o) * ((b - mb) / sb)')} AS p
FROM fl, eq""")
def q_plane_predictions(spark, d):
    """M4, M5 with two correlated features, one of them imputed."""
    res, _ = _run(spark, d, MAIN, [_X, _Z], models=LINEAR, cv=False)
    p = res.predictions.filter(F.col("model").isin(*LINEAR))
    return rounded(p.select("model", "side", "entity", "t", "p"))


def _part_scores(role: str) -> str:
    c = f"role = '{role}'"
    sse, sst = f"sum(CASE WHEN {c} THEN e * e END)", f"(var_pop(CASE WHEN {c} THEN y END) * count_if({c}))"
    return (f"{O.r(f'sqrt(avg(CASE WHEN {c} THEN e * e END))')} AS {role}_RMSE, "
            f"{O.r(f'CASE WHEN count_if({c}) < 2 THEN NULL ELSE 1.0::DOUBLE - {sse} / {sst} END')} AS {role}_R2")


@register("m10_cv_one_feature", _run_sql_prefix(MAIN) + _FOLD_FITS + f"""
SELECT fold, model, {_part_scores('train')}, {_part_scores('val')}, 'ok' AS status, '{MAIN.tag}' AS tag
FROM (SELECT fold, model, role, y, y - ({_FIT}) AS e FROM fold_rows JOIN fits USING (fold), {_TWO})
GROUP BY fold, model""")
def q_line_cv(spark, d):
    """Train and validation scores of every fold, one-feature models."""
    return rounded(_run(spark, d, MAIN, [_X], models=LINEAR)[0].cv)


@register("a11_alpha_search", _run_sql_prefix(MAIN) + _FOLD_FITS + f""",
scored AS (
  SELECT alpha, fold, sqrt(avg((y - ({_FIT})) * (y - ({_FIT})))) AS rmse
  FROM fold_rows JOIN fits USING (fold), (VALUES {', '.join(f'({a}::DOUBLE)' for a in _ALPHAS)}) m(alpha)
  WHERE role = 'val' GROUP BY alpha, fold),
means AS (SELECT alpha, avg(rmse) AS mean_rmse FROM scored GROUP BY alpha),
ranked AS (SELECT alpha, mean_rmse, row_number() OVER (ORDER BY mean_rmse, alpha) = 1 AS best FROM means)
SELECT alpha, fold, {O.r('rmse')} AS val_RMSE, {O.r('mean_rmse')} AS mean_val_RMSE, best FROM scored JOIN ranked USING (alpha)""")
def q_alpha_search(spark, d):
    """The score table of a search over expanding folds, every candidate and fold."""
    from panelcast.plans import runs
    split, _, bounds = runs.prepare_run(spark, d, MAIN)
    return rounded(runs.alpha_search(split.filter(F.col("side") == "train"), [_X], bounds, _ALPHAS))


_REPEATS = 5


@register("m11_importance_one_feature", _run_sql_prefix(MAIN) + f""",
st AS (SELECT {_LINE} FROM sp WHERE side = 'train'),
te AS (SELECT entity, t, y, {_X}, 5.0::DOUBLE AS alpha FROM sp WHERE side = 'test'),
own AS (SELECT r, entity, t, y, row_number() OVER (PARTITION BY r ORDER BY entity, t) AS k FROM te, range(0, {_REPEATS}) q(r)),
other AS (SELECT r, {_X}, alpha, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || entity || ':' || t), entity, t) AS k
          FROM te, range(0, {_REPEATS}) q(r)),
shuffled AS (SELECT r, sqrt(avg((y - ({_FIT})) * (y - ({_FIT})))) AS rmse FROM own JOIN other USING (r, k), st GROUP BY r),
plain AS (SELECT sqrt(avg((y - ({_FIT})) * (y - ({_FIT})))) AS rmse FROM te, st)
SELECT '{_X}' AS feature, {O.r('avg(s.rmse - p.rmse)')} AS importance, {O.r('stddev_pop(s.rmse - p.rmse)')} AS std
FROM shuffled s, plain p""")
def q_line_importance(spark, d):
    """M11 for the ridge with one feature."""
    from panelcast.plans import runs
    res, split = _run(spark, d, MAIN, [_X], models=LINEAR, cv=False)
    return rounded(runs.importance_for(res, split, "ridge", n_repeats=_REPEATS))


# ---------------------------------------------------------------- models (rows-only checks: no exact SQL)

LINEAR = ("linear_regression", "ridge")


def _run(spark, d, cfg: RunConfig, feats: list[str] | None = None, **kw):
    """(result, split) of one run, computed afresh."""
    from panelcast.plans import runs
    split, own, bounds = runs.prepare_run(spark, d, cfg)
    return runs.run_all_models(spark, split, feats or own, cfg, checkpoint=False, bounds=bounds, **kw), split


def _linear_run(spark, d):
    return _run(spark, d, MAIN, models=LINEAR)


def _all_run(spark, d, **kw):
    """All models at the reference presets, the library's defaults."""
    return _run(spark, d, MAIN, **kw)


@register("m4_m5_linear_metrics", None)
def q_linear(spark, d):
    return rounded(_linear_run(spark, d)[0].metrics)


@register("m4_m5_linear_metrics_full", None)
def q_linear_full(spark, d):
    return rounded(_run(spark, d, FULL, models=LINEAR)[0].metrics)


@register("m6_m7_all_model_metrics", None)
def q_all_models(spark, d):
    return rounded(_all_run(spark, d, cv=False)[0].metrics)


@register("m10_cv_report", None)
def q_cv(spark, d):
    return rounded(_all_run(spark, d)[0].cv)


@register("r3_cv_stability_pivot", None)
def q_cv_pivot(spark, d):
    from panelcast.operators import report as rp
    return rounded(rp.cv_stability(_all_run(spark, d)[0].cv,
                                   ["linear_regression", "ridge", "random_forest", "gradient_boosting"]))


@register("c6_run_comparison_models", None)
def q_cmp_models(spark, d):
    from panelcast.operators import report as rp
    return rounded(rp.run_comparison(_all_run(spark, d, cv=False)[0].metrics))


@register("m11_permutation_importance", None)
def q_importance(spark, d):
    from panelcast.plans import runs
    res, split = _linear_run(spark, d)
    return rounded(runs.importance_for(res, split, "ridge", n_repeats=30))


@register("m12_model_predictions", None)
def q_model_preds(spark, d):
    from panelcast.plans import runs
    return rounded(runs.export_predictions(_linear_run(spark, d)[0].predictions, "ridge"))


@register("m8_rf_grid_search", None)
def q_rf_grid(spark, d):
    from panelcast.operators import trees as tr
    res, _ = _run(spark, d, MAIN, models=("random_forest",), tune_rf=True, cv=False, rf_grid=tr.RF_GRID)
    return tr.best_params_frame(spark, res.best_params["random_forest"]).withColumn("tag", F.lit(MAIN.tag))


@register("m9_gb_grid_search", None)
def q_gb_grid(spark, d):
    from panelcast.operators import trees as tr
    res, _ = _run(spark, d, MAIN, models=("gradient_boosting",), tune_gb=True, cv=False, gb_grid=tr.GB_GRID)
    return tr.best_params_frame(spark, res.best_params["gradient_boosting"]).withColumn("tag", F.lit(MAIN.tag))


from panelcast.plans import tree_queries  # noqa: E402, F401  (registers its queries)


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

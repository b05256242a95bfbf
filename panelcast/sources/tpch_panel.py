"""Panel inputs derived from the star-schema test tables.

The reference reads country spreadsheets; our inputs are the driver's parquet tables.
This module maps them onto the same roles (see FIXTURES.md part 2):

* entity  = nation of the order's customer, ``t`` = month index ``year*12+month-1``
* level   = monthly sum of ``o_totalprice``           (role of the GDP level)
* growth  = percent change of the level              (role of GDP growth, the target)
* events  = returned order lines                     (role of the disaster list)
* macro   = five monthly nation aggregates: two by ship month, three by order month, so
            that their spans differ as the data's do
* global  = monthly mean extended price, no entity   (role of the oil price)
* wide    = yearly level pivoted to ``YYYY [YRYYYY]`` columns (role of the coded indicator extracts)

Everything is a lazy DataFrame; sums go through ``decimal`` so the values do not
depend on the order in which partitions are combined.

Scale notes: lineitem meets orders once; every measure that lines carry (events, line
means, the global series) comes from one aggregate of that join per (entity, ship
month), and the panel joins see (entity, t) rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.functions.scalar import month_index
from panelcast.operators.clean import fill_zero

# Names of the five macro controls and of the global series, as in the
# reference's master table (kept so feature names match its model matrix).
MACRO_COLUMNS = ["inflation_cpi", "exports_pct_gdp", "unemployment_rate",
                 "investment_pct_gdp", "fx_jpy_per_usd"]
GLOBAL_COLUMN = "oil_price_usd"

REGIME_CUTOFF = 24000         # January 2000: role of the 2020 regime dummy
RESTRICTED_START = 23964      # January 1997: role of the 1992 restricted sample

DEC = "decimal(18,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer -> (o_orderkey, entity, t, o_totalprice, o_orderpriority, c_acctbal)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"), "c_acctbal")
    return (o.join(c, "o_custkey", "inner")
             .select("o_orderkey", "entity", month_index("o_orderdate").alias("t"),
                     "o_totalprice", "o_orderpriority", "c_acctbal"))


def level_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, t, gdp): monthly sum of order value per customer nation."""
    return (order_facts(spark, sf_dir)
            .groupBy("entity", "t")
            .agg(F.sum(F.col("o_totalprice").cast(DEC)).cast("double").alias("gdp")))


def growth_series(spark: SparkSession, sf_dir: str, level: DataFrame | None = None) -> DataFrame:
    """(entity, t, gdp_growth) = 100 * (level / previous level - 1); the first period
    of each entity has no growth and is dropped (the loader's ``dropna``)."""
    lv = level if level is not None else level_series(spark, sf_dir)
    w = Window.partitionBy("entity").orderBy("t")
    g = F.lit(100.0) * (F.col("gdp") / F.lag("gdp", 1).over(w) - F.lit(1.0))
    return (lv.select("entity", "t", g.alias("gdp_growth"))
              .dropna(subset=["gdp_growth"]))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event list in the reference's cleaned-event schema, one row per event.

    Event = every returned line.  deaths = quantity,
    damage in thousands = price / 1000, negative when the line has no tax (dirty
    value that P7 must null), magnitude = discount, unknown when 0.
    """
    li = (read_table(spark, sf_dir, "lineitem")
          .filter(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_shipdate", "l_returnflag"))
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    dmg_k = F.col("l_extendedprice") / F.lit(1000.0)
    return (li.join(o, "l_orderkey").join(c, "o_custkey")
              .select(
                  "entity",
                  month_index("l_shipdate").alias("t"),
                  F.col("l_returnflag").alias("disaster_type"),
                  F.lit("returned line").alias("disaster_subtype"),
                  F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("event_name"),
                  F.lit("discount").alias("magnitude_scale"),
                  F.col("l_quantity").alias("deaths"),
                  F.when(F.col("l_tax") == 0, -dmg_k).otherwise(dmg_k).alias("damage_usd_thousands"),
                  F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("magnitude"),
              ))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the nation of their customer (NULL when unknown) and ship month."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        month_index("l_shipdate").alias("t"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    return li.join(o, "l_orderkey", "left").join(c, "o_custkey", "left")


def ship_month_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate per (entity, ship month): sums of lines (discount, quantity, price),
    and the event aggregates of A1 over returned lines as conditional sums."""
    event = F.col("l_returnflag") == "R"
    exact = "decimal(38,6)"
    damage = F.col("l_extendedprice") / F.lit(1000.0) * F.lit(1000.0)
    known = F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(damage)   # negative values are unknown (P7)
    n = F.count_if(event)
    magnitude = F.sum(F.when(event, F.coalesce("l_discount", F.lit(0.0)).cast(exact))).cast("double")
    return (line_facts(spark, sf_dir).groupBy("entity", "t")
            .agg(F.sum(F.col("l_discount").cast(DEC)).alias("sd"),
                 F.sum(F.col("l_quantity").cast(DEC)).alias("sq"),
                 F.sum(F.col("l_extendedprice").cast(DEC)).alias("sp"),
                 F.count(F.lit(1)).alias("nl"),
                 n.alias("n_events"),
                 F.sum(F.when(event, F.coalesce("l_quantity", F.lit(0.0)).cast(exact))).cast("double").alias("total_deaths"),
                 F.sum(F.when(event, F.coalesce(known, F.lit(0.0)).cast(exact))).cast("double").alias("total_damage"),
                 F.when(n > 0, magnitude / n).alias("avg_magnitude")))


def order_month_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate per (entity, order month): the level and counts of orders."""
    return (order_facts(spark, sf_dir).groupBy("entity", "t")
            .agg(F.sum(F.col("o_totalprice").cast(DEC)).cast("double").alias("gdp"),
                 F.count(F.lit(1)).alias("n_orders"),
                 F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
                 F.sum(F.col("c_acctbal").cast(DEC)).alias("sum_bal")))


def macro_formulas() -> tuple[dict, dict]:
    """(by ship month, by order month): name -> expression over the aggregate's columns.

    inflation_cpi      = mean line discount        exports_pct_gdp  = mean line quantity
    unemployment_rate  = share of urgent orders    fx_jpy_per_usd   = number of orders
    investment_pct_gdp = mean account balance of ordering customers
    """
    ship = {MACRO_COLUMNS[0]: F.col("sd").cast("double") / F.col("nl"),
            MACRO_COLUMNS[1]: F.col("sq").cast("double") / F.col("nl")}
    order = {MACRO_COLUMNS[2]: F.col("n_urgent") / F.col("n_orders"),
             MACRO_COLUMNS[3]: F.col("sum_bal").cast("double") / F.col("n_orders"),
             MACRO_COLUMNS[4]: F.col("n_orders").cast("double")}
    return ship, order


def macro_series(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Five (entity, t, value) series, each over its own months."""
    ship, order = macro_formulas()
    lines = ship_month_facts(spark, sf_dir).filter(F.col("entity").isNotNull())
    orders = order_month_facts(spark, sf_dir)
    return ([lines.select("entity", "t", e.alias(name)) for name, e in ship.items()]
            + [orders.select("entity", "t", e.alias(name)) for name, e in order.items()])


def wide_level_panel(spark: SparkSession, sf_dir: str, ship: DataFrame | None = None) -> DataFrame:
    """(entity, t, gdp, gdp_growth, event aggregates, five macro columns) from two
    aggregates, one of orders and one of lines.

    Level and target come from the same table, so J1 (inner join level x growth) reduces
    to the growth window plus dropping rows without growth; the event aggregates (J2) and
    the macro block (J3 + J4) are one left join of the line aggregate.  Same rows as the
    join chain."""
    ship = ship_month_facts(spark, sf_dir) if ship is None else ship
    by_ship, by_order = macro_formulas()
    events = ["n_events", "total_deaths", "total_damage", "avg_magnitude"]
    lines = ship.select("entity", "t", *events, *[e.alias(name) for name, e in by_ship.items()])
    w = Window.partitionBy("entity").orderBy("t")
    g = F.lit(100.0) * (F.col("gdp") / F.lag("gdp", 1).over(w) - F.lit(1.0))
    own = (order_month_facts(spark, sf_dir)
           .select("entity", "t", "gdp", g.alias("gdp_growth"), *[e.alias(name) for name, e in by_order.items()])
           .filter(F.col("gdp_growth").isNotNull()))
    joined = own.join(lines, ["entity", "t"], "left")
    return fill_zero(joined, events[1:], int_columns=events[:1]).select(
        "entity", "t", "gdp", "gdp_growth", *events, *MACRO_COLUMNS)


def global_series(spark: SparkSession, sf_dir: str, ship: DataFrame | None = None) -> DataFrame:
    """(t, oil_price_usd): mean extended price of lines shipped in the month, rolled up
    from the (entity, ship month) aggregate where one is given, else from lines alone."""
    if ship is None:
        ship = (read_table(spark, sf_dir, "lineitem").groupBy(month_index("l_shipdate").alias("t"))
                .agg(F.sum(F.col("l_extendedprice").cast(DEC)).alias("sp"), F.count(F.lit(1)).alias("nl")))
    return ship.groupBy("t").agg((F.sum("sp").cast("double") / F.sum("nl")).alias(GLOBAL_COLUMN))


def yearly_level_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, year, value): yearly order value per nation (long form of the extract)."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    return (o.join(c, "o_custkey")
             .groupBy("entity", F.year("o_orderdate").alias("year"))
             .agg(F.sum(F.col("o_totalprice").cast(DEC)).cast("double").alias("value")))


def wide_coded_extract(spark: SparkSession, sf_dir: str, years=None,
                       series_code: str = "LEVEL.ORDERS") -> DataFrame:
    """Coded wide extract: ``Series Code``, ``Country Code`` and one string column per
    year named ``YYYY [YRYYYY]`` (values as text, as spreadsheets deliver them).
    ``years=None``: every year present (Spark finds the pivot values itself)."""
    labels = None if years is None else [f"{y} [YR{y}]" for y in years]
    long = (yearly_level_long(spark, sf_dir)
            .select(F.col("entity").cast("string").alias("Country Code"),
                    F.concat(F.col("year").cast("string"), F.lit(" [YR"),
                             F.col("year").cast("string"), F.lit("]")).alias("label"),
                    F.col("value").cast("string").alias("value")))
    g = long.groupBy("Country Code")
    g = g.pivot("label") if labels is None else g.pivot("label", labels)
    return g.agg(F.first("value")).select(F.lit(series_code).alias("Series Code"), "*")


def wide_plain_extract(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Plain wide extract: four id columns and one column per year named ``YYYY``
    (every year present when ``years`` is None)."""
    long = yearly_level_long(spark, sf_dir).select(
        F.col("entity").cast("string").alias("Country Code"),
        F.col("year").cast("string").alias("label"),
        F.col("value").cast("string").alias("value"))
    g = long.groupBy("Country Code")
    wide = (g.pivot("label") if years is None else g.pivot("label", [str(y) for y in years])).agg(
        F.first("value"))
    labels = [c for c in wide.columns if c != "Country Code"]
    return wide.select(F.concat(F.lit("nation "), F.col("Country Code")).alias("Country Name"),
                       "Country Code",
                       F.lit("Order value").alias("Indicator Name"),
                       F.lit("LEVEL.ORDERS").alias("Indicator Code"),
                       *[F.col(f"`{c}`") for c in labels])


# Dirty tokens injected into text measures, by order key modulo 97.
DIRTY_TOKENS = {0: "..", 1: "1,234", 2: "NaN", 3: "", 4: "12d"}


def dirty_orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with measures as text, a few keys replaced by dirty tokens (no row dropped)."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 97
    txt = F.col("o_totalprice").cast("string")
    for key, tok in DIRTY_TOKENS.items():
        txt = F.when(k == key, F.lit(tok)).otherwise(txt)
    return o.select("o_orderkey", "o_custkey", txt.alias("totalprice_text"),
                    F.year("o_orderdate").cast("string").alias("year_text"))


def speed_level_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large panel for speed runs: entity = supplier, t from the ship date, level =
    monthly shipped value."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("entity"), month_index("l_shipdate").alias("t"))
              .agg(F.sum(F.col("l_extendedprice").cast(DEC)).cast("double").alias("gdp")))


def speed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the speed panel: returned lines, per supplier."""
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    dmg_k = F.col("l_extendedprice") / F.lit(1000.0)
    return li.select(
        F.col("l_suppkey").alias("entity"), month_index("l_shipdate").alias("t"),
        F.col("l_quantity").alias("deaths"),
        F.when(F.col("l_tax") == 0, -dmg_k).otherwise(dmg_k).alias("damage_usd_thousands"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("magnitude"))

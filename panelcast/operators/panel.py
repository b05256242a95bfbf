"""Panel assembly.

The master panel has one row per ``(entity, t)``.  Event lists are aggregated to
periods *before* any join, so raw event skew (one entity holding a third of the
events) is absorbed by the map-side partial aggregate and never reaches a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import guarded_ratio, log1p_zero, presence_flag
from panelcast.operators.clean import fill_zero, require_columns, to_double

KEYS = ("entity", "t")
EVENT_AGG_COLUMNS = ["n_events", "total_deaths", "total_damage", "avg_magnitude"]


def aggregate_events(events: DataFrame, keys: Sequence[str] = KEYS, *,
                     decimal_scale: int | None = None, known_only: bool = False) -> DataFrame:
    """A1: events to periods.

    n_events = rows, total_deaths / total_damage = sums with unknown read as 0,
    avg_magnitude = mean with unknown read as 0 *before* the mean (reference
    behaviour; ``known_only=True`` averages known magnitudes only), NULL mean -> 0.

    ``decimal_scale`` sums in ``decimal(38, scale)`` so the result does not depend on
    the order partitions are merged in (needed for bit-exact comparisons).
    """
    ev = events
    if "damage_usd" not in ev.columns and "damage_usd_thousands" in ev.columns:
        ev = ev.withColumn("damage_usd", to_double(ev, "damage_usd_thousands") * F.lit(1000.0))
    require_columns(ev, [*keys, "deaths", "damage_usd", "magnitude"], "events")
    ev = ev.dropna(subset=list(keys))

    def total(c):
        x = F.coalesce(to_double(ev, c), F.lit(0.0))
        if decimal_scale is None:
            return F.sum(x)
        return F.sum(x.cast(f"decimal(38,{decimal_scale})")).cast("double")

    if known_only:
        mag = F.avg(to_double(ev, "magnitude"))
    elif decimal_scale is None:
        mag = F.avg(F.coalesce(to_double(ev, "magnitude"), F.lit(0.0)))
    else:
        mag = (F.sum(F.coalesce(to_double(ev, "magnitude"), F.lit(0.0))
                     .cast(f"decimal(38,{decimal_scale})")).cast("double") / F.count(F.lit(1)))
    return (ev.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n_events"),
                   total("deaths").alias("total_deaths"),
                   total("damage_usd").alias("total_damage"),
                   F.coalesce(mag, F.lit(0.0)).alias("avg_magnitude")))


def merge_series(series: Sequence[DataFrame], keys: Sequence[str] = KEYS, how: str = "full") -> DataFrame:
    """Merge several keyed series.

    ``how="full"`` gives the rows of the chain of full outer joins.  Keys that no series
    repeats (as a rule all of them) are merged by one union of long rows and one grouped
    pivot, one shuffle in place of one a join.  The rows of keys that some series repeats,
    which the chain multiplies, go through the chain; rows with a null in their key match
    nothing and stay as they are.  ``how="join"`` runs the literal chain for all rows.
    """
    keys = list(keys)

    def chain(parts: Sequence[DataFrame]) -> DataFrame:
        out = parts[0]
        for s in parts[1:]:
            out = out.join(s, keys, "full")
        return out

    if how == "join":
        return chain(series)
    names = [[c for c in s.columns if c not in keys][0] for s in series]
    series = [s.select(*keys, F.col(n).cast("double").alias(n)) for s, n in zip(series, names, strict=True)]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    long, loose = None, None
    for s, name in zip(series, names, strict=True):
        part = s.filter(known).select(*keys, F.lit(name).alias("series"), F.col(name).alias("value"))
        alone = s.filter(~known).select(*keys, *[(F.col(n) if n == name else F.lit(None).cast("double")).alias(n) for n in names])
        long = part if long is None else long.unionByName(part)
        loose = alone if loose is None else loose.unionByName(alone)
    own = [F.col("series") == n for n in names]
    merged = long.groupBy(*keys).agg(*[F.max(F.when(c, F.col("value"))).alias(n) for c, n in zip(own, names, strict=True)],
                                     F.greatest(*[F.count_if(c) for c in own], F.lit(1)).alias("__most"))
    repeated = merged.filter("__most > 1").select(*keys)
    several = chain([s.join(repeated, keys, "left_semi") for s in series])
    return merged.filter("__most = 1").drop("__most").unionByName(several).unionByName(loose)


def join_target(level: DataFrame, growth: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join level x growth (the target must exist)."""
    return level.join(growth, list(keys), "inner")


def join_events(panel: DataFrame, event_agg: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of period event aggregates, then P9 (no event -> 0)."""
    out = panel.join(event_agg, list(keys), "left")
    return fill_zero(out, ["total_deaths", "total_damage", "avg_magnitude"], int_columns=["n_events"])


def join_block(panel: DataFrame, block: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of a keyed control block (missing controls never delete rows)."""
    return panel.join(block, list(keys), "left")


def join_global(panel: DataFrame, series: DataFrame, time_col: str = "t") -> DataFrame:
    """Left join of a series that has no entity, on time only.  The series has one
    row per period; AQE turns the join into a broadcast once its size is measured."""
    return panel.join(series, time_col, "left")


def add_event_derivations(panel: DataFrame, level_col: str = "gdp") -> DataFrame:
    """F1-F3 on the panel: log damage, damage share of the level, presence flag."""
    return (panel.withColumn("log_total_damage", log1p_zero("total_damage"))
                 .withColumn("damage_share_gdp", guarded_ratio("total_damage", level_col))
                 .withColumn("has_disaster", presence_flag("n_events")))


def build_master_panel(level: DataFrame, growth: DataFrame | None, events: DataFrame | None = None,
                       macro: Sequence[DataFrame] | DataFrame | None = None,
                       global_series: DataFrame | None = None, *,
                       event_aggregates: DataFrame | None = None,
                       decimal_scale: int | None = None,
                       keys: Sequence[str] = KEYS) -> DataFrame:
    """Master panel = level x growth (inner) + event aggregates (left, zeros) +
    macro block (left) + global series (left on time) + F1-F3.

    ``growth=None``: ``level`` already carries the target (and possibly the macro
    columns), e.g. when both come from one aggregate of the same fact table."""
    panel = level if growth is None else join_target(level, growth, keys)
    agg = event_aggregates
    if agg is None and events is not None:
        agg = aggregate_events(events, keys, decimal_scale=decimal_scale)
    if agg is not None:
        panel = join_events(panel, agg, keys)
    else:
        panel = panel.select("*", F.lit(0).cast("bigint").alias("n_events"),
                             *[F.lit(0.0).alias(c) for c in EVENT_AGG_COLUMNS[1:]])
    if macro is not None:
        block = macro if isinstance(macro, DataFrame) else merge_series(list(macro), keys)
        panel = join_block(panel, block, keys)
    if global_series is not None:
        panel = join_global(panel, global_series, keys[-1])
    return add_event_derivations(panel)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a table that has at most one row by construction (a
    global aggregate) to every row of ``df``: inner equi-join on a constant key with the
    one-row side broadcast, so ``df`` is neither shuffled nor skewed.  Rows of ``df``
    are dropped when ``one_row`` is empty."""
    key = "__one"
    return (df.withColumn(key, F.lit(1))
              .join(F.broadcast(one_row.withColumn(key, F.lit(1))), key, "inner")
              .drop(key))


def key_quality(panel: DataFrame, keys: Sequence[str] = KEYS,
                nonneg: Sequence[str] = ("n_events", "total_deaths", "total_damage")) -> DataFrame:
    """One-row data-quality report: rows, NULL keys, duplicated keys, negative
    aggregates.  A valid panel has zeros everywhere except ``n_rows``."""
    dup = (panel.groupBy(*keys).count().filter(F.col("count") > 1)
                .agg(F.count(F.lit(1)).alias("n_duplicate_keys")))
    null_keys = F.count_if(F.greatest(*[F.col(k).isNull() for k in keys])) if len(keys) > 1 \
        else F.count_if(F.col(keys[0]).isNull())
    base = panel.agg(F.count(F.lit(1)).alias("n_rows"),
                     null_keys.alias("n_null_keys"),
                     *[F.count_if(F.col(c) < 0).alias(f"n_negative_{c}") for c in nonneg if c in panel.columns])
    return base.select("*", dup.select("n_duplicate_keys").scalar().alias("n_duplicate_keys"))

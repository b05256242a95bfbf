"""Row windows over series too long for one task.

``Window.partitionBy(entity)`` sorts each entity in one task, which a series with most of
the rows makes the slowest by far.  Here a series of more than ``rows_per_window`` rows is
cut at approximate quantiles of its time, and each piece but the first is given a *halo*:
the last k rows before it.  A frame that looks back k rows at most sees the same rows in
its piece as in the whole series, so results are those of the plain window:

1. one aggregate counts the rows of every entity; another finds the cuts of the long ones;
2. the cuts reach the rows by a broadcast join (without a setting there are at most four
   for every shuffle partition, since only entities beyond half of a task's fair share are cut);
3. the last k rows of each piece (``WindowGroupLimit`` keeps k a piece and task before the
   shuffle) are put in order, and each piece takes the k before its own as its halo;
4. the window runs by (entity, piece), and halo rows are left out of its result.

Rows of equal time stay in one piece.  Null entities are one series, null times come first,
as in a plain window; an empty table gives an empty one.  Times are numbers, dates or
timestamps, unique within an entity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.operators.features import TO_LAG, add_features
from panelcast.session import materialize

#: Rows that the features of a panel look back (five of rolling moments).
LOOK_BACK = 5
#: No series is cut into pieces of fewer rows unless the caller says so.
LEAST_ROWS = 1_000
#: Cuts are searched by groups of so many.
GROUP = 64
#: More cuts than this are joined by a shuffle.
BROADCAST_CUTS = 1_000_000
PIECE, HALO = "__piece", "__halo"


def _cuts(panel: DataFrame, entity: str, time_col: str, rows_per_window: int | None) -> tuple[DataFrame, int]:
    """((__e, __groups) of the long entities: their cuts, ascending, in groups; their number)."""
    sizes = materialize(panel.groupBy(F.col(entity).alias("__e")).agg(F.count(F.lit(1)).alias("__n")))
    total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    if rows_per_window is None:
        tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_window = max(LEAST_ROWS, math.ceil((total or 0) / (2 * tasks)))
    pieces = max(1, math.ceil((most or 0) / rows_per_window))
    long = sizes.where(F.col("__n") > rows_per_window)
    # the longest series takes every one of these shares, a shorter one each stride-th
    shares = [i / pieces for i in range(1, pieces)] or [0.5]
    own = panel.select(F.col(entity).alias("__k"), F.col(time_col).alias("__t"))
    at = (own.join(F.broadcast(long) if rows_per_window >= LEAST_ROWS else long, F.col("__k").eqNullSafe(F.col("__e")))
          .groupBy("__e", "__n").agg(F.percentile_approx("__t", shares, max(10_000, 10 * pieces)).alias("__at")))
    stride = F.greatest(F.lit(1), F.floor(F.lit(pieces) * F.lit(rows_per_window) / F.col("__n"))).cast("int")
    kept = F.array_distinct(F.filter("__at", lambda _, i: (i + 1) % stride == 0))
    cuts = materialize(at.select("__e", kept.alias("__at")).where(F.size("__at") > 0))
    number = cuts.agg(F.sum(F.size("__at"))).first()[0] or 0
    starts = F.sequence(F.lit(1), F.size("__at"), F.lit(GROUP))
    return cuts.select("__e", F.transform(starts, lambda s: F.slice("__at", s, GROUP)).alias("__groups")), number


def with_halo(panel: DataFrame, look_back: int = LOOK_BACK, entity: str = "entity", time_col: str = "t",
              rows_per_window: int | None = None) -> DataFrame:
    """``panel`` with the piece of each row (0 for short series) and, marked by ``__halo``, the
    ``look_back`` rows before each later piece once more."""
    cuts, number = _cuts(panel, entity, time_col, rows_per_window)
    t = F.col(time_col)
    passed = F.size(F.filter("__groups", lambda g: g[0] < t))        # groups begun before t
    inside = F.filter(F.element_at("__groups", passed), lambda c: c < t)
    piece = F.when(F.col("__groups").isNull() | t.isNull() | (passed == 0), 0).otherwise((passed - 1) * GROUP + F.size(inside))
    joined = panel.join(F.broadcast(cuts) if number <= BROADCAST_CUTS else cuts,
                        F.col(entity).eqNullSafe(F.col("__e")), "left")
    rows = joined.select(*panel.columns, piece.cast("int").alias(PIECE), F.col("__groups").isNotNull().alias("__long"))
    back = Window.partitionBy(entity, PIECE).orderBy(F.desc(time_col))
    tails = (rows.where("__long").drop("__long").withColumn("__place", F.row_number().over(back))
             .where(F.col("__place") <= look_back).drop("__place"))
    along = Window.partitionBy(entity).orderBy(PIECE, time_col)
    before = F.collect_list(F.struct(*panel.columns)).over(along.rowsBetween(-look_back, -1))
    halo = (tails.select(PIECE, F.lag(PIECE).over(along).alias("__last"), before.alias("__before"))
            .where(F.col("__last") < F.col(PIECE)).select(PIECE, F.explode("__before").alias("__row"))
            .select(*[F.col("__row")[c].alias(c) for c in panel.columns], PIECE, F.lit(True).alias(HALO)))
    return rows.drop("__long").withColumn(HALO, F.lit(False)).unionByName(halo)


def over_pieces(panel: DataFrame, build: Callable[[DataFrame, WindowSpec], DataFrame], look_back: int,
                entity: str = "entity", time_col: str = "t", rows_per_window: int | None = None) -> DataFrame:
    """``build(rows, window)`` with frames of at most ``look_back`` rows back, for series of any length.
    ``build`` keeps the rows and columns that it is given and adds columns over ``window``."""
    rows = with_halo(panel, look_back, entity, time_col, rows_per_window)
    return build(rows, Window.partitionBy(entity, PIECE).orderBy(time_col)).where(~F.col(HALO)).drop(PIECE, HALO)


def add_features_long(panel: DataFrame, *, target: str = "gdp_growth", entity: str = "entity", time_col: str = "t",
                      regime_cutoff: int = 24000, to_lag=TO_LAG, rows_per_window: int | None = None) -> DataFrame:
    """``features.add_features`` for panels in which a few entities may hold most rows."""
    return over_pieces(panel, lambda rows, w: add_features(rows, target=target, entity=entity, time_col=time_col,
                                                           regime_cutoff=regime_cutoff, to_lag=to_lag, window=w),
                       LOOK_BACK, entity, time_col, rows_per_window)

"""Chronological split and expanding folds.

Positions are ranks of **distinct periods**, so in a panel every entity is cut at the
same calendar period (no calendar leakage across entities in pooled models); with
one entity this is the reference's row split.

Only the distinct-period table (one row per period: bounded by the calendar, not by
the data volume) is ranked; its one-row summaries (cut period, fold bounds) reach the
fact rows as scalar subqueries, so the fact side is never joined or re-shuffled for
the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def period_index(ds: DataFrame, time_col: str = "t") -> DataFrame:
    """(t, pidx, n_periods): 1-based rank of each distinct period."""
    periods = ds.select(time_col).distinct()
    w_all = Window.partitionBy()           # the distinct-period table only
    return periods.select(time_col,
                          F.row_number().over(Window.orderBy(time_col)).alias("pidx"),
                          F.count(F.lit(1)).over(w_all).alias("n_periods"))


def _cut_expr(n: Column, test_ratio: float, min_periods: int) -> Column:
    keep = 1.0 - float(test_ratio)
    cut = F.greatest(F.lit(1), F.least(F.floor(n * F.lit(keep)).cast("bigint"), n - 1))
    return F.when(n < min_periods, F.raise_error(F.lit(
        f"the data cover fewer than {min_periods} periods: too short to hold out a test set"))
    ).otherwise(cut)


def split_summary(ds: DataFrame, test_ratio: float = 0.2, time_col: str = "t",
                  min_periods: int = 5) -> DataFrame:
    """One row: n_periods, n_train_periods, last train period, first test period."""
    if not 0.0 < float(test_ratio) < 1.0:
        raise ValueError(f"the test share must lie between 0 and 1, not {test_ratio}")
    pi = period_index(ds, time_col)
    cut = _cut_expr(F.col("n_periods"), test_ratio, min_periods)
    return (pi.withColumn("cut", cut)
              .agg(F.max("n_periods").alias("n_periods"), F.max("cut").alias("n_train_periods"),
                   F.max(F.when(F.col("pidx") <= F.col("cut"), F.col(time_col))).alias("train_end_t"),
                   F.min(F.when(F.col("pidx") > F.col("cut"), F.col(time_col))).alias("test_start_t")))


def chrono_split(ds: DataFrame, test_ratio: float = 0.2, time_col: str = "t",
                 min_periods: int = 5, side_col: str = "side", lazy: bool = False) -> DataFrame:
    """Add ``side`` = 'train' for the first ``floor(n*(1-ratio))`` periods (clamped
    to [1, n-1]), else 'test'.  Fewer than ``min_periods`` periods raise.

    The cut is one period value computed from the distinct-period table and handed to
    the fact rows as a literal (one bounded value reaches the driver), so no plan built
    on the split nests a subquery.  ``lazy=True`` keeps it as a scalar subquery."""
    summary = split_summary(ds, test_ratio, time_col, min_periods)
    if lazy:
        cut_t = summary.select("train_end_t").scalar()
    else:
        row = summary.first()
        if row is None or row["n_periods"] is None or row["n_periods"] < min_periods:
            raise ValueError(f"the data cover fewer than {min_periods} periods: too short to hold out a test set")
        cut_t = F.lit(row["train_end_t"])
    return ds.withColumn(side_col, F.when(F.col(time_col) <= cut_t, F.lit("train")).otherwise(F.lit("test")))


def chrono_split_with_folds(ds: DataFrame, test_ratio: float = 0.2, n_splits: int = 5, time_col: str = "t",
                            min_periods: int = 5, side_col: str = "side"):
    """W7 + W8 bounds in ONE aggregate over the ranked period table: train periods are
    the first ``cut`` ranks, so their rank among train periods is their global rank.
    Returns (split DataFrame, [(fold, train_end_t, val_end_t), ...]); at most
    ``n_splits`` + 1 values reach the driver."""
    if not 0.0 < float(test_ratio) < 1.0:
        raise ValueError(f"the test share must lie between 0 and 1, not {test_ratio}")
    pi = period_index(ds, time_col)
    keep = 1.0 - float(test_ratio)
    n = F.col("n_periods")
    cut = F.greatest(F.lit(1), F.least(F.floor(n * F.lit(keep)).cast("bigint"), n - 1))
    k = F.least(F.lit(n_splits), F.greatest(F.lit(2), F.floor(F.col("cut") / 6).cast("bigint")))
    staged = (pi.withColumn("cut", cut).withColumn("k", k)
                .withColumn("block", F.floor(F.col("cut") / (F.col("k") + 1)).cast("bigint")))
    aggs = [F.max("n_periods").alias("n_periods"), F.max("k").alias("k"),
            F.max(F.when(F.col("pidx") <= F.col("cut"), F.col(time_col))).alias("train_end_t")]
    for i in range(n_splits):
        te = F.col("cut") - (F.col("k") - i) * F.col("block")
        aggs += [F.max(F.when(F.col("pidx") == te, F.col(time_col))).alias(f"te{i}"),
                 F.max(F.when(F.col("pidx") == te + F.col("block"), F.col(time_col))).alias(f"ve{i}")]
    row = staged.agg(*aggs).first()
    if row is None or row["n_periods"] is None or row["n_periods"] < min_periods:
        raise ValueError(f"the data cover fewer than {min_periods} periods: too short to hold out a test set")
    bounds = [(i, row[f"te{i}"], row[f"ve{i}"]) for i in range(min(int(row["k"]), n_splits))]
    split = ds.withColumn(side_col, F.when(F.col(time_col) <= F.lit(row["train_end_t"]), F.lit("train"))
                                     .otherwise(F.lit("test")))
    return split, bounds


def fold_bounds(train: DataFrame, n_splits: int = 5, time_col: str = "t") -> DataFrame:
    """W8 fold table over the train periods: k = min(n_splits, max(2, n//6)),
    block = n//(k+1); fold i trains on the first n-(k-i)*block periods and validates on
    the next block.  Columns: fold, train_end_t, val_end_t, n_train_periods, k."""
    pi = period_index(train, time_col)
    n = F.col("n_periods")
    k = F.least(F.lit(n_splits), F.greatest(F.lit(2), F.floor(n / 6).cast("bigint")))
    block = F.floor(n / (k + 1)).cast("bigint")
    staged = pi.select(time_col, "pidx", "n_periods", k.alias("k"), block.alias("block"))
    structs = []
    for i in range(n_splits):
        te = F.col("n_periods") - (F.col("k") - i) * F.col("block")
        structs.append(F.struct(
            F.lit(i).alias("fold"),
            F.max(F.when(F.col("pidx") == te, F.col(time_col))).alias("train_end_t"),
            F.max(F.when(F.col("pidx") == te + F.col("block"), F.col(time_col))).alias("val_end_t"),
        ))
    agg = staged.agg(F.max("k").alias("k"), F.max("n_periods").alias("n"), F.array(*structs).alias("folds"))
    return (agg.select("k", "n", F.explode("folds").alias("f"))
               .filter(F.col("f.fold") < F.col("k"))
               .select(F.col("f.fold").cast("int").alias("fold"), F.col("f.train_end_t").alias("train_end_t"),
                       F.col("f.val_end_t").alias("val_end_t"), F.col("n").alias("n_train_periods"),
                       F.col("k").cast("int").alias("k")))


def assign_folds(train: DataFrame, n_splits: int = 5, time_col: str = "t") -> DataFrame:
    """Expand train rows into (fold, role) rows: role 'train' or 'val'.  The fold table
    (at most ``n_splits`` rows) arrives as one scalar-subquery array; each row is
    emitted once per fold it belongs to (expanding window: at most n_splits copies)."""
    fb = fold_bounds(train, n_splits, time_col)
    arr = fb.agg(F.sort_array(F.collect_list(F.struct("fold", "train_end_t", "val_end_t")))).scalar()
    t = F.col(time_col)
    f = F.col("__f")
    role = (F.when(t <= f["train_end_t"], F.lit("train"))
             .when(t <= f["val_end_t"], F.lit("val")))
    return (train.select("*", F.explode(arr).alias("__f"))
                 .select(f["fold"].alias("fold"), role.alias("role"), *[F.col(c) for c in train.columns])
                 .filter(F.col("role").isNotNull()))


def chronology_check(split: DataFrame, time_col: str = "t", side_col: str = "side") -> DataFrame:
    """One row with max train period, min test period, sizes, and the verdict."""
    return split.agg(
        F.max(F.when(F.col(side_col) == "train", F.col(time_col))).alias("max_train_t"),
        F.min(F.when(F.col(side_col) == "test", F.col(time_col))).alias("min_test_t"),
        F.count_if(F.col(side_col) == "train").alias("n_train"),
        F.count_if(F.col(side_col) == "test").alias("n_test"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("chronological", F.col("max_train_t") < F.col("min_test_t"))

"""Joins and places that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import materialize

#: At most so many keys are broadcast by ``spread_join`` (about 5 MB).
HOT_KEYS = 100_000
#: A key of at most so many rows is never a hot one.
LEAST_HOT = 1_000


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], rows_of: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which holds each key once and, as ``rows_of``, how
    many of the ``total`` rows it has.

    A key with more than a 1 / HOT_KEYS part of the rows is hot: there are fewer than
    HOT_KEYS such keys whatever the data are, so they are broadcast and their rows stay
    where they lie.  All others are joined by a shuffle.  ``rows`` is read twice and
    ``table`` three times: give tables.
    """
    keys = list(keys)
    limit = max(LEAST_HOT, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(rows_of) > limit))
    cold = table.where(F.col(rows_of) <= limit)
    return (rows.join(hot, keys)
            .unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)))


def placed(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row (from 0) by ``order``, and ``__part``, the range
    partition that holds it.

    The rows are range-partitioned, sorted there and written once, with the number of the
    partition and of the row in it; the partitions' sizes then give the places.  No task
    sees more than a partition.  Ties fall in any order: end ``order`` with a column that
    tells rows apart.
    """
    at = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    rows = rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the job
    offsets = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return rows.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__before", "__row")
